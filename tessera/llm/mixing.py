"""Mixing sources to target weights by systematic sampling.

Each source has a target of words; a document's expected copies are target / source size.
Within a source, documents stand in order of size (then doc_id); the expected copies are
summed up along that order, one offset is added, and a document is emitted once for each
integer that its part of the sum crosses.  As neighbours in the order are of like size, the
taken words differ from the target by about one document's size at most.  The offset is a
hash of the source's name, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, known, source_size, target) of rows (source, known, source_size), one a source.

    Sources by code point, null last, get the weights in turn.  They share ``share`` of all
    sizes by weight; a target stops at ``most`` times its source's size, the excess going to
    the others by weight until none is above.  That level of words per weight is found in
    closed form: sources in order of their stop per weight, stopped ones taken off."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(Window.orderBy(F.col("known").desc(), "source")) - 1) % len(weights)
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("stop", F.lit(most) * F.col("source_size")).withColumn("per", F.col("stop") / F.col("w"))
    before = Window.orderBy("per", F.col("known").desc(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("stopped", F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    rows = rows.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.col("stopped")) / F.col("left_w"))
    level = F.max(F.when(F.col("level") <= F.col("per"), F.col("level"))).over(every)
    target = F.coalesce(F.least(F.col("stop"), F.col("w") * level), F.col("stop"))
    return rows.select("source", "known", "source_size", target.alias("target"))


def _offset(source: Column) -> Column:
    """A number in [0, 1) that depends on the source's name alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), source)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(spark: SparkSession, rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds source_size, target and copies to narrow rows with doc_id, source and size.

    Ranks within a source come from a range partition by (source, size, doc_id), so that a
    source with a third of all rows spreads over many tasks; only one count for each source
    and slice meets in one place.  Sources are a small side while a count shows it; beyond
    that the join shuffles."""
    rows = rows.withColumn("known", F.when(F.col("source").isNull(), 0).otherwise(1)).withColumn("source", F.coalesce("source", F.lit("")))
    order = ["known", "source", "size", "doc_id"]
    spread = [F.xxhash64(*[c for c in rows.columns if c not in ("size",)])]
    rows = rows.repartitionByRange(common.tasks(spark), *order, *spread).withColumn("part", F.spark_partition_id())
    rows = common.written(spark, rows, "mix-slices")
    sizes = common.written(spark, targets(rows.groupBy("source", "known").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    own = ["known", "source"]
    slices = rows.groupBy(*own, "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*own, "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*own, "part").orderBy("size", "doc_id")) - 1
    ranked = rows.withColumn("inside", inside).join(slices, [*own, "part"]).join(common.small_side(sizes), own)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    begin = F.col("base") + F.col("inside")
    crossed = lambda k: F.floor(k * rate + _offset(F.col("source")))
    out = ranked.withColumn("copies", (crossed(begin + 1) - crossed(begin)).cast("long"))
    return out.withColumn("source", F.when(F.col("known") == 1, F.col("source"))).drop("known", "part", "base", "inside")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with size, the number of words of the whole text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all ``documents``.

    Null or empty text: size 0; such a document counts as a place in the order.  Null source:
    a source of its own, last.  Null doc_id: first in its size.  Repeated rows: each has its
    row.  A source without words has target 0.  Empty table: no rows."""
    docs = common.read_table(spark, sf_dir, "documents")
    rows = sized(docs.select("doc_id", "source", "text")).drop("text")
    out = mix(spark, rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
with d as (
  select doc_id, case when source is null then 0 else 1 end as known, coalesce(source, '') as source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents
), s as (
  select known, source, sum(size)::bigint as source_size from d group by 1, 2
), w as (
  select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by known desc, source) - 1) % 3 + 1)::int] as w, 2.0::double * source_size as stop from s
), p as (
  select *, stop / w as per from w
), q as (
  select *, coalesce(sum(stop) over (order by per, known desc, source rows between unbounded preceding and 1 preceding), 0.0) as stopped,
         (select sum(w) from p) - coalesce(sum(w) over (order by per, known desc, source rows between unbounded preceding and 1 preceding), 0.0) as left_w
  from p
), l as (
  select *, (1.5::double * (select sum(source_size)::double from p) - stopped) / left_w as level from q
), t as (
  select *, coalesce(least(stop, w * (select max(case when level <= per then level end) from l)), stop) as target from l
), r as (
  select d.doc_id, d.size, t.source_size, t.target,
         row_number() over (partition by d.known, d.source order by d.size, d.doc_id nulls first) - 1 as k,
         case when t.source_size > 0 then least(2.0::double, t.target / t.source_size) else 0.0::double end as rate,
         ('0x' || substr(md5('offset:' || d.source), 1, 8))::bigint / 4294967296.0::double as u
  from d join t on d.known = t.known and d.source = t.source
)
select doc_id, size, source_size, target, (size * (floor((k + 1) * rate + u) - floor(k * rate + u)))::bigint as taken from r
"""


def sampled(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0, 1 or more times).

    Rows are matched by doc_id and text hash; rows that share both are told apart by number."""
    key = lambda df: df.withColumn("h", F.xxhash64("text")).withColumn("key", F.coalesce(F.col("doc_id"), F.col("h")))
    nth = F.row_number().over(Window.partitionBy("key", "h").orderBy("source"))
    narrow = key(sized(docs.select("doc_id", "source", "text"))).drop("text")
    copies = mix(spark, narrow, weights, share, most)
    copies = common.written(spark, copies.withColumn("nth", nth).where("copies > 0").select("key", "h", "nth", "copies"), "mix-copies")
    own = ("doc_id", "source", "text")
    rows = key(common.boxed(docs, *own)).withColumn("nth", nth).join(copies.hint("shuffle_hash"), ["key", "h", "nth"])
    return common.unboxed(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))), docs.columns, *own)
