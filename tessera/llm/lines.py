"""Fuzzy line dedup, in SQL functions throughout.

One scan writes every line that has a word, with its place.  Each distinct line (by a 64-bit
hash) gets a 64-bit SimHash of its normalised words (lower case, without punctuation).  Lines
of equal normal form are one node.  Fingerprints within ``REACH`` bits agree on all but
``REACH`` of any set of blocks, so a join on keys of the blocks left finds them (pigeonhole);
a candidate pair counts if the edit similarity of the normalised lines, in words, is at least 0.8
(so few bits apart, nearly all words are equal, and typos have made other words of the rest).  Of each connected group of lines the first place (by doc_id, then line) stays, the
others leave their texts.

All pairs of different normal forms within reach are settled (``close_links``).  Lines that are
mostly a few frequent words have nearly one fingerprint, so pairs are also told apart by their
lengths before their words are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import bucket_links, components

REACH = 3
ALIKE = 0.8
#: Fingerprints that share a key by chance, about, up to which keys of fewer blocks are taken.
CROWD = 4
#: Members of a bucket up to which its pairs are tried at once.
MANY = 128

#: What separates words: ASCII but digits and letters; the lines are in lower case by then.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Edit distances up to which a pair is tried before the next, costlier one.
TRIES = (8, 32, 128, 512, 2048, 8192, 1 << 15, 1 << 20, 1 << 30)
#: Words of a line whose counts share a sum, before those of a longer line are added up.
CHUNK = 1 << 17


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), BREAKS), "")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, k, size, line) of every line with a visible character; h is the text's
    hash, k the line's, size its bytes."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))  # before the lines, not once for each of them
    rows = docs.select("doc_id", "h", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return rows.where(F.btrim("line", F.lit(" \t\r\x0b\x0c")) != "").select("doc_id", "h", "pos", F.xxhash64("line").alias("k"), F.octet_length("line").alias("size"), "line")


def simhash(rows: DataFrame) -> DataFrame:
    """(k, fp, n, form) of the distinct lines of rows (k, size, line): bit by bit the majority
    of the words' hashes, the number of words, and a hash of the normal form (the words with
    their places).

    Three bits' counts share a sum (lanes of 22, 22 and 20 bits) for ``CHUNK`` words; only lines
    that may be longer, if any, are summed up in parts whose lanes are then added up apart."""
    h = F.xxhash64("word")
    lane = 1 | 1 << 22 | 1 << 44
    sums = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(lane))).alias(f"s{j}") for j in range(22)]
    form = F.bit_xor(F.xxhash64("word", "place")).alias("form")
    def words(some: DataFrame) -> DataFrame:
        distinct = some.select("k", "line").groupBy("k").agg(F.first("line").alias("line"))
        return distinct.select("k", F.posexplode(words_of(F.col("line"))).alias("place", "word"))

    # A lane of twice a sum, less n + 1, plus a bit above both: that bit stays if 2 * count > n.
    above = 1 << 21 | 1 << 43 | 1 << 62

    def three(j: int) -> Column:
        v = F.col("above") + F.shiftleft(F.col(f"s{j}"), 1)
        bits = F.shiftrightunsigned(v, 21).bitwiseAND(F.lit(1 | 1 << 22)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(v, 62), 44))
        return F.shiftleft(bits, j)

    either = lambda a, b: a.bitwiseOR(b)
    short = words(rows.where(F.col("size") < 2 * CHUNK)).groupBy("k").agg(F.count("*").alias("n"), form, *sums)
    short = short.withColumn("above", F.lit(above) - (F.col("n") + 1) * F.lit(lane))
    short = short.select("k", reduce(either, [three(j) for j in range(22)]).alias("fp"), "n", "form")
    big = rows.where(F.col("size") >= 2 * CHUNK)
    if big.isEmpty():
        return short
    count = lambda at: F.shiftrightunsigned(F.col(f"s{at % 22}"), at // 22 * 22).bitwiseAND(F.lit((1 << 22) - 1))
    parts = words(big).groupBy("k", F.floor(F.col("place") / CHUNK).alias("part")).agg(F.count("*").alias("n"), form, *sums)
    long = parts.groupBy("k").agg(F.sum("n").alias("n"), F.bit_xor("form").alias("form"), *[F.sum(count(at)).alias(f"c{at}") for at in range(64)])
    bits = [F.when(2 * F.col(f"c{at}") > F.col("n"), F.lit((1 << at) - (1 << 64 if at == 63 else 0))).otherwise(F.lit(0)).cast("long") for at in range(64)]
    return short.unionByName(long.select("k", reduce(either, bits).alias("fp"), "n", "form"))


def block_keys(fp: Column, rows: int, reach: int = REACH, crowd: int = CROWD) -> Column:
    """Keys of a fingerprint of which two within ``reach`` bits share one at least.

    64 bits are cut in m blocks; ``reach`` bits touch as many blocks at most, so some choice
    of m - reach blocks is equal.  m is the smallest for which about ``crowd`` of ``rows``
    fingerprints share a key by chance: keys get longer as the table grows, and what they
    find stays the same."""
    m = reach + 1
    while m < 2 * reach + 2 and rows > crowd << (64 * (m - reach) // m):
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(m), m - reach)):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        part = fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        keys.append(F.xxhash64(F.lit(number), part))
    return F.array(*keys)


def symbols(words: Column) -> Column:
    """Each word as one character beyond the first 65,536, by a hash of it, so that an edit
    distance of such strings is one in words: too small by about a millionth of the words that
    differ, as there are 1,048,576 such characters."""
    places = F.transform(words, lambda w: F.concat(F.lit("00"), F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(1 << 20)) + (1 << 16)), 6, "0")))
    return F.decode(F.unhex(F.array_join(places, "")), "UTF-32")


def similar(x: Column, y: Column, least: float = ALIKE) -> Column:
    """Whether the edit similarity of two strings, 1 - distance / the longer one's length, is at
    least ``least``.  A bounded distance costs the length times the bound: small bounds are tried first."""
    most = F.floor(F.greatest(F.length(x), F.length(y)) * (1 - least) + 1e-9)
    out = F.lit(False)
    for limit in reversed(TRIES):
        far = F.levenshtein(x, y, limit).bitwiseAND(F.lit(0x7FFFFFFF))  # -1, beyond the bound, becomes the greatest
        out = F.when(far <= most, True).when(most <= limit, False).otherwise(out)
    return (x == y) | ((F.abs(F.length(x) - F.length(y)) <= most) & out)


def shortest(least: float = ALIKE) -> int:
    """Words of the shortest line that a different one can be like: the longer one may have an edit."""
    return next(n for n in range(1, 1 << 20) if n >= least * (m := next(m for m in range(n, 1 << 20) if int(m * (1 - least) + 1e-9))) - 1e-9)


def close_links(spark: SparkSession, forms: DataFrame, sure: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """Links (a, b) that connect all pairs of ``forms`` (h, fp, n) within reach that ``sure`` confirms.

    Lines whose lengths alone put them below ``ALIKE`` are no pair.  Buckets of a key of up to ``MANY``
    members are paired at once.  Of larger ones, all members are paired with one of them first; then, where a
    bucket still has several groups, with each other (``bucket_links``)."""

    def fits(x, y) -> Column:
        short = F.least(x("n"), y("n")) >= F.greatest(x("n"), y("n")) * ALIKE - 1e-9
        return short & (F.bit_count(x("fp").bitwiseXOR(y("fp"))) <= REACH)

    def shared_by(keyed: DataFrame) -> DataFrame:
        keyed = keyed.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")
        return common.written(spark, keyed.select("key", "h", "fp", "n", (F.col("m") > MANY).alias("many")), "line-shared")

    side = lambda df, x: df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("h", "fp", "n")])
    fit = fits(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"))
    ends = [F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")]
    shared = shared_by(forms.select("h", "fp", "n", F.explode(block_keys(F.col("fp"), n)).alias("key")))
    few, many = shared.where("not many"), shared.where("many")
    pairs = side(few, "x").join(side(few, "y"), "key").where((F.col("h_x") < F.col("h_y")) & fit).select(*ends)
    crowded = not many.isEmpty()
    if crowded:
        heads = many.groupBy("key").agg(F.max_by(F.struct("h", "fp", "n"), F.bitwise_not("h")).alias("one")).select("key", "one.*")
        pairs = pairs.union(side(heads, "x").join(side(many, "y"), "key").where((F.col("h_x") != F.col("h_y")) & fit).select(*ends))
    links = common.written(spark, sure(common.written(spark, pairs.distinct(), "line-pairs")), "line-links")
    if not crowded:
        return links
    return bucket_links(spark, many.drop("many"), links, sure, fits, direct=100 * n, settled=0)


def line_groups(spark: SparkSession, docs: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """The places of lines (doc_id, h, pos, k), and the roots (k, root) of lines that are
    linked to others; lines of fewer than ``least`` words have no part in it."""
    rows = common.written(spark, lines_of(docs.select("doc_id", "text")), "lines")
    prints = common.written(spark, simhash(rows).where(F.col("n") >= least), "line-prints")
    # Lines of one normal form: a star around that of the smallest hash.
    forms = common.written(spark, prints.groupBy("form").agg(F.min("k").alias("k"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.count("*").alias("own")), "line-forms")
    same = prints.join(forms.where("own > 1").select("form", F.col("k").alias("a")), "form").where("k != a").select("a", F.col("k").alias("b"))
    n = forms.count()
    some = forms.where(F.col("n") >= shortest()).select(F.col("k").alias("h"), "fp", F.col("n").cast("int").alias("n"))

    def sure(pairs: DataFrame) -> DataFrame:
        """The pairs that are alike; the words of their lines, and of no others, are read."""
        asked = common.written(spark, pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct(), "line-asked")
        texts = rows.select("k", "line").join(common.small_side(asked), "k", "left_semi").dropDuplicates(["k"])
        texts = common.written(spark, texts.select("k", symbols(words_of(F.col("line"))).alias("marks")), "line-texts")
        both = pairs.join(texts.select(F.col("k").alias("a"), F.col("marks").alias("x")), "a").join(texts.select(F.col("k").alias("b"), F.col("marks").alias("y")), "b")
        return both.where(similar(F.col("x"), F.col("y"))).select("a", "b")

    links = close_links(spark, some, sure, n)
    roots = components(spark, same.unionByName(links))
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "k")
    if least > 1:
        rows = rows.join(prints.select("k"), "k", "left_semi")
    return rows.select("doc_id", "h", "pos", "k"), roots


def dedup_lines(spark: SparkSession, docs: DataFrame, least: int = 1, removed: str | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of their texts, and (if named) a column with
    the number of lines taken out.

    Null text: stays null.  Lines without a letter or digit stay, unless they are equal: then,
    as any, all but the first go; blank lines always stay.  A line without blanks or
    punctuation is one word, however long: it has no near copies but equal ones.  Null doc_id: such
    documents come first.  Rows of equal doc_id and text are one document, of which either row
    is kept alike.  Ties: of a text's lines the first stays.  Very long lines: compared whole.
    Columns are those of ``docs``."""
    with common.passing(spark):
        places, roots = line_groups(spark, docs, least)
        grouped = places.join(common.small_side(roots), "k", "left").select("doc_id", "h", "pos", F.coalesce("root", "k").alias("g"))
        grouped = common.written(spark, grouped, "line-grouped", outlives=True)
    first = grouped.groupBy("g").agg(F.min(F.struct("doc_id", "h", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = common.written(spark, first, "line-first")
    later = common.spread_join(grouped, first, "g", "n").where(~F.struct("doc_id", "h", "pos").eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("pos").alias("_gone"))
    gone = common.written(spark, gone, "line-gone")
    rows = common.boxed(docs, "doc_id", "text")
    out = rows.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left")
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    kept = lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n")
    # A column of the lines would be put in for each use, so that a text were split again for each of its lines.
    once = F.get(F.transform(F.array(F.split("text", "\n")), kept), F.lit(0))
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(once))
    if removed is None:
        return common.unboxed(out, docs.columns, "doc_id", "text")
    n = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("box").getField(c).alias(c) for c in docs.columns if c != removed], n.alias(removed))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without repeated lines: doc_id, the text, and the number of lines taken out.

    Null text: null, 0.  Empty text: no lines.  Null doc_id: such documents come first.
    Repeated rows: one document, each row with the same result.  Ties: the lower line stays.
    Very long texts and lines: taken whole.  Empty table: no rows.  Other columns: ignored."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(spark, docs, removed="n_removed")
