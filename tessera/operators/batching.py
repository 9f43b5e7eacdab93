"""Batches as a column: every sampler assigns ``batch_id`` in one plan.

Balanced samplers repeat the rows of small classes: a row of a class of n rows stands at
places rank, rank + n, rank + 2n, ... of the class's sequence, as far as batches need them;
each cycle has an order of its own, by an md5 of seed, cycle and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import artifacts

from . import prefix as P

#: Ids that share a bucket when rows are numbered in order of id.
ID_RANGE = 1 << 16


def order_hash(seed: int, cycle: Column, key: str = "cell_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), cycle.cast("string"), F.col(key).cast("string")))


def eval_batches(cells: DataFrame, size: int) -> DataFrame:
    """(cell_id, batch_id) in order of cell_id."""
    rows = P.place(cells.select("cell_id"), [], F.floor(F.col("cell_id") / ID_RANGE), ["cell_id"])
    return rows.select("cell_id", F.floor(F.col("place") / size).cast("long").alias("batch_id"))


def random_batches(cells: DataFrame, size: int, seed: int = 1) -> DataFrame:
    rows = cells.select("cell_id").withColumn("h", order_hash(seed, F.lit(0)))
    return P.place(rows, [], P.hash_bucket("h"), ["h", "cell_id"]).select("cell_id", F.floor(F.col("place") / size).cast("long").alias("batch_id"))


def cycled(rows: DataFrame, stratum: str, slots: DataFrame, seed: int = 1) -> DataFrame:
    """(cell_id, stratum, batch_id): ``slots`` gives each stratum its places per batch (slots)
    and the number of batches."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    need = slots.join(F.broadcast(sizes), stratum).withColumn("_need", F.col("slots") * F.col("batches"))
    need = need.withColumn("_cycles", F.ceil(F.col("_need") / F.col("_size")).cast("long"))
    need = F.broadcast(need)  # a row a class: joined by key, a class's rows would lie in one task
    every = rows.select("cell_id", stratum).join(need, stratum).withColumn("_cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cycles") - 1)))
    every = P.place(every.withColumn("_h", order_hash(seed, F.col("_cycle"))), [stratum, "_cycle"], P.hash_bucket("_h"), ["_h", "cell_id"])
    at = every.withColumn("_at", F.col("_cycle") * F.col("_size") + F.col("place")).where("_at < _need")
    return at.select("cell_id", stratum, F.floor(F.col("_at") / F.col("slots")).cast("long").alias("batch_id"))


def balanced_labels(cells: DataFrame, size: int, seed: int = 1, label: str = "y") -> DataFrame:
    """Half of each batch positive (rounded down), the rest negative; ceil(n / size) batches."""
    cells = artifacts.written(cells.select("cell_id", label), "labels")
    total = cells.agg(F.ceil(F.count("*") / size).cast("long").alias("batches"))
    slots = cells.select(label).distinct().withColumn("slots", F.when(F.col(label) == 1, size // 2).otherwise(size - size // 2).cast("long"))
    return cycled(cells, label, slots.crossJoin(F.broadcast(total)), seed)  # one row: the number of batches


def strata(cells: DataFrame, label: str = "y") -> DataFrame:
    """Adds ``stratum``: tissue_label, with _pos or _neg where both occur."""
    name = F.concat_ws("_", F.coalesce("tissue_type", F.lit("nan")), F.coalesce("imputed_labels", F.lit("nan")))
    rows = cells.withColumn("_name", name)
    both = rows.groupBy("_name").agg((F.count_distinct(label) == 2).alias("_both"))
    end = F.when(~F.col("_both"), "").otherwise(F.when(F.col(label) == 1, "_pos").otherwise("_neg"))
    return rows.join(F.broadcast(both), "_name").withColumn("stratum", F.concat("_name", end)).drop("_name", "_both")


def allocation(stratified: DataFrame, size: int) -> DataFrame:
    """(stratum, n, slots): equal places per batch, one more for the largest until they are dealt."""
    n = stratified.groupBy("stratum").agg(F.count("*").alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = F.count("*").over(every)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "stratum"))
    slots = F.floor(F.lit(size) / kinds) + F.when(rank <= size % kinds, 1).otherwise(0)
    return n.select("stratum", "n", slots.cast("long").alias("slots"))


def balanced_types(cells: DataFrame, size: int, seed: int = 1, label: str = "y") -> DataFrame:
    """Batches with equal numbers from each stratum; a batch smaller than their number is an error."""
    cells = artifacts.written(cells.select("cell_id", label, "tissue_type", "imputed_labels"), "cells")
    rows = artifacts.written(strata(cells, label).select("cell_id", "stratum"), "strata")
    slots = artifacts.written(allocation(rows, size), "slots")
    kinds = slots.count()
    if size < kinds:
        raise ValueError(f"batch size {size} is below the number of strata, {kinds}")
    total = cells.agg(F.ceil(F.count("*") / size).cast("long").alias("batches"))
    return cycled(rows, "stratum", slots.crossJoin(F.broadcast(total)), seed)  # one row: the number of batches


SAMPLERS = ("random", "balanced_labels", "balanced_types")


def train_batches(sampler: str, cells: DataFrame, size: int, seed: int = 1, label: str = "y") -> DataFrame:
    """(cell_id, batch_id) of a sampler by name; cells of small classes recur with the balanced ones."""
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler!r}; known: {SAMPLERS}")
    if sampler == "random":
        return random_batches(cells, size, seed)
    made = balanced_labels if sampler == "balanced_labels" else balanced_types
    return made(cells, size, seed, label).select("cell_id", "batch_id")


def class_weights(cells: DataFrame, label: str = "y") -> DataFrame:
    """(label, n, weight): N / (classes n)."""
    n = cells.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return n.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def check_classes(cells: DataFrame, label: str = "y") -> None:
    """ValueError unless both classes occur."""
    if cells.select(label).distinct().where(F.col(label).isin(0, 1)).count() < 2:
        raise ValueError("both classes need at least one row")
