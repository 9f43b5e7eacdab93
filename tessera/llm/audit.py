"""Audit of how quality filters interact: what each removes, alone, first or after others.

Rows are counted once per part and combination of failures, then a CUBE over the flags and the
part gives, for each subset of filters, the rows that fail none of it: the grouping sets' rows
whose selected flags are all false.  A filter's work at a step of an order is the difference
between two such subsets, so all orders cost no more than the pairs of subsets.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"


def failures(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): numbers of documents by language and failures.

    A: under 200 words.  B: 100 * distinct words < 50 * words.  C: 100 * A-Z > 3 * code points.
    D: one of ``#$%&*|``.  E: the text of a smaller doc_id.  Null text: an empty one; null lang:
    the part ''.  Null doc_id: never fails E, isn't a smaller one and has no labels.  Repeated rows:
    a document each, and none of them smaller than the others.  Labels that contradict each
    other: good and toxic if any row says so.  Other columns are ignored; no documents, no rows.
    Texts are read once, at any length, and only their digests go on."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words")
    )
    distinct = F.size(F.array_distinct("words")).cast("long")
    n = F.size("words").cast("long")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    marks = rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (n < 200).alias("A"), (100 * distinct < 50 * n).alias("B"),
        (100 * capitals > 3 * F.length("text").cast("long")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
    ).join(known, "doc_id", "left")
    marks = common.written(spark, marks.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}), "audit-marks")
    copied = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("own")).where("own > 1")
    later = common.spread_join(marks, common.written(spark, copied, "audit-copied"), "digest", "own").where("doc_id > first")
    by = ["part", *FILTERS[:-1]]
    count = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    every, failed = marks.groupBy(*by).agg(*count), common.written(spark, later.groupBy(*by).agg(*count), "audit-later")
    less = failed.select(*by, *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    cells = every.unionByName(less).withColumn("E", F.lit(False)).unionByName(failed.withColumn("E", F.lit(True)))
    return cells.groupBy("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(spark: SparkSession, cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters (one letter each, also a boolean column of ``cells``)
    and step, from counts by part and failures (n, good, toxic).

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley as sums of rows; zeros included."""
    bits = {f: 1 << k for k, f in enumerate(filters)}
    full = (1 << len(filters)) - 1
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    cube = cells.cube("part", *filters).agg(*sums, F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"any_{f}") for f in filters])
    for f in filters:
        cube = cube.where((F.col(f"any_{f}") == 1) | ~F.col(f))
    mask = sum(((1 - F.col(f"any_{f}")) * bit for f, bit in bits.items()), F.lit(0)).cast("int")
    left = common.written(spark, cube.where("all_parts = 0").select("part", mask.alias("mask"), "n", "good", "toxic"), "audit-survivors")

    pairs = left.where("mask = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(full))).alias("before"), F.lit(list(filters)).alias("all"))
    pairs = pairs.select("part", "before", F.posexplode("all").alias("k", "letter")).withColumn("bit", F.expr("shiftleft(1, k)"))
    pairs = pairs.where(F.col("before").bitwiseAND(F.col("bit")) == 0).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    for at in ("before", "after"):
        side = left.select("part", F.col("mask").alias(at), *[F.col(c).alias(f"{c}_{at}") for c in ("n", "good", "toxic")])
        pairs = pairs.join(side, ["part", at], "left")
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    gone = lambda c: v(f"{c}_before") - v(f"{c}_after")
    pairs = pairs.select("part", "before", "letter", "bit", v("n_after").alias("kept"), gone("n").alias("removed"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"))
    size = F.bit_count("before")
    orders = sum((F.when(size == k, factorial(k) * factorial(len(filters) - 1 - k)).otherwise(0) for k in range(len(filters))), F.lit(0))
    alone = pairs.groupBy("part", "letter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(F.col("before") == full - F.col("bit"), F.col("removed"))).alias("unique_fails"), F.sum(orders * F.col("removed")).alias("shapley")
    )
    steps = [("".join(order), step + 1, order[step], sum(bits[f] for f in order[:step])) for order in permutations(filters) for step in range(len(filters))]
    steps = spark.createDataFrame(steps, "filter_order string, step int, letter string, before int")
    found = pairs.join(alone, ["part", "letter"]).join(steps, ["letter", "before"])
    return found.select(
        "part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed")], (F.col("fails") - F.col("removed")).cast("long").alias("redundant"),
        *[F.col(c).cast("long").alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")],
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over all ``documents``, by language."""
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return interactions(spark, failures(spark, docs, labels))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > first, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN known USING (doc_id)
), cells AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
         || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM docs GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT p.l || q.l || r.l || s.l || u.l AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, u.l])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) AS r(step)
), counted AS (
  SELECT part, filter_order, step, letter, CASE WHEN earlier = '' THEN false ELSE regexp_matches(fails, '[' || earlier || ']') END AS was_removed,
         contains(fails, letter) AS now, fails, n, good, toxic
  FROM cells, steps
), summed AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT was_removed AND NOT now), 0) AS kept,
         coalesce(sum(n) FILTER (NOT was_removed AND now), 0) AS removed, coalesce(sum(n) FILTER (was_removed AND now), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT was_removed AND now), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (NOT was_removed AND now), 0) AS toxic_lost
  FROM counted GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed
"""
