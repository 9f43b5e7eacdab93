"""Connected components of a link table, by alternating star operations.

Each round re-hangs every node's larger neighbours, then its smaller ones, on the smallest
node that it knows; stars remain after about log(n) rounds.  Both steps are a minimum (with
partial aggregation) and a join, so a node with very many links doesn't gather them in one
task: the join's large partitions can be split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``links`` that isn't its component's smallest.

    Links with a null or equal ends and repeated links change nothing; no links, no rows."""
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = common.written(spark, now, "links")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        old, now = now, common.written(spark, small, "links")
        common.dropped(spark, old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def bucket_links(
    spark: SparkSession, banded: DataFrame, links: DataFrame | None, sure: Callable[[DataFrame], DataFrame],
    fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], direct: int = 0, finish: Callable[[DataFrame], DataFrame] | None = None,
    settled: int = 4,
) -> DataFrame:
    """Links (a, b) that connect what ``links`` and all pairs of a bucket (key, h, ...) connect
    that ``fits`` (given both sides' columns) and ``sure`` (given pairs (a, b)) confirm.

    No pair of a bucket is left out but those that are linked already and those that don't
    fit.  A round pairs representatives of each bucket with all of its members and takes them
    out of it; members stay, linked or not, as others may be like them only.  Buckets of one
    group are done.  Representatives are 1, 4, 16, ... of a bucket, those with most links
    first: so the text that many differing copies were made from comes second at the latest.
    After rounds of up to ``settled`` representatives (none: 0), pairs that are at most ``direct`` (a number in proportion to the
    rows) are all taken at once; with ``finish``, buckets left after the first are given to it, with
    their groups g and sizes m, for the links of all their pairs."""
    columns = [c for c in banded.columns if c != "key"]
    side = lambda df, x: df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in [*columns, "g"]])

    def one_round(links: DataFrame | None, banded: DataFrame, reps: int, every: bool) -> tuple[DataFrame, DataFrame]:
        """The links of a round, and the representatives that it took."""
        chosen = banded
        if not every:
            rank = F.bitwise_not("h")
            some = banded
            if links is not None:
                ends = links.select(F.col("a").alias("h")).union(links.select("b")).groupBy("h").agg(F.count("*").alias("own"))
                some, rank = banded.join(ends, "h", "left"), F.struct(F.coalesce("own", F.lit(0)), rank)
            one = F.max_by(F.struct(*columns, "g"), rank).alias("one")
            chosen = some.groupBy("key", F.pmod(F.xxhash64("h"), F.lit(reps)).alias("salt")).agg(one)
            chosen = common.written(spark, chosen.select("key", "one.*"), "buckets-chosen", outlives=True)
        could = (F.col("g_x") != F.col("g_y")) & fits(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"))
        if every:
            could = could & (F.col("h_x") < F.col("h_y"))
        pairs = side(chosen, "x").join(side(banded, "y"), "key").where(could).select(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")).distinct()
        found = sure(common.written(spark, pairs, "bucket-pairs"))
        return common.written(spark, found, "bucket-found", outlives=True), chosen

    reps = 1
    own: list[DataFrame] = []  # the tables of this function that are still read
    while True:
        if links is None:
            banded = banded.withColumn("g", F.col("h"))
        else:
            links = common.written(spark, links.distinct(), "bucket-links")
            roots = components(spark, links)
            banded = banded.select("key", *columns).join(roots.withColumnRenamed("node", "h"), "h", "left").select("key", *columns, F.coalesce("root", "h").alias("g"))
            banded = common.written(spark, banded, "buckets")
            common.dropped(spark, *own)
            own = [links, banded]
        mixed = banded.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("m")).where("lo < hi")
        mixed = common.written(spark, mixed.select("key", "m"), "buckets-mixed")
        left = mixed.agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2)).first()[0]
        if not left:
            return spark.createDataFrame([], "a long, b long") if links is None else links
        banded = common.written(spark, banded.join(mixed, "key", "left_semi"), "buckets")
        common.dropped(spark, *own[1:])
        own = [*own[:1], banded]
        if finish is not None and reps > 1:
            return links.unionByName(finish(banded.join(mixed, "key")))
        every = reps > settled and left <= direct
        with common.passing(spark):
            found, chosen = one_round(links, banded, reps, every)
        own.append(found)
        links = found if links is None else links.unionByName(found)
        if every:
            return links
        if finish is None:
            own.append(chosen)
            banded = banded.join(chosen, ["key", "h"], "left_anti")
        reps *= 4
