"""Training data: split and fitted schema, kept as a version, or taken up again from one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators import batching, matrix, split
from tessera.sources import artifacts
from tessera.sources.store import Store, fingerprint

NAME = "prepared"


@dataclass
class Prepared:
    """Counts, cells with their ``split`` and label ``y``, and what was fitted on the training cells."""

    counts: DataFrame
    cells: DataFrame
    schema: artifacts.Schema
    fingerprint: str
    resumed: bool

    def side(self, name: str) -> DataFrame:
        return self.cells.where(F.col("split") == name)


def prepare(
    spark: SparkSession, path: str, counts: DataFrame, genes: DataFrame, cells: DataFrame, dev_ratio: float = 0.2, seed: int = 1, use_log: bool = True,
    use_zscore: bool = True, features: tuple[str, ...] = ("tissue_type", "imputed_labels"), resume: bool = True,
) -> Prepared:
    """Splits patients, fits the schema on the training side, and commits both with the patients under ``path``.

    With ``resume`` a version of the same inputs and switches is read back instead, and one of
    others is refused (``ChangedInput``); without it a new version is made.  The split by cell,
    the patients of each side, the statistics and the codes of categories are tables of the version."""
    if not 0 < dev_ratio < 1:
        raise ValueError("dev_ratio must be between 0 and 1")
    cells = cells.withColumn("y", N.hard_label(F.col("expansion")))
    store = Store(spark, path)
    switches = {"dev_ratio": dev_ratio, "seed": seed, "use_log": use_log, "use_zscore": use_zscore, "features": list(features)}
    mark = fingerprint([counts, genes, cells], **switches)
    version = store.resume(NAME, mark) if resume else None
    resumed = version is not None
    if version is None:
        batching.check_classes(cells)
        patients = artifacts.written(split.checked_split(cells, dev_ratio, seed), "patients")
        parts = artifacts.written(split.split_cells(cells, patients), "split")
        learn = matrix.slice_rows(cells, parts.where("split = 'train'").hint("merge")).hint("merge")  # a row a cell is never broadcast
        stats = matrix.fit_stats(matrix.slice_rows(counts, learn), genes, learn, use_log)
        codes = [matrix.category_codes(learn, f) for f in features if f in cells.columns]
        every = spark.createDataFrame([], "feature string, category string, code long")
        for own in codes:
            every = every.unionByName(own)
        version = store.commit(NAME, {"split": parts, "patients": patients, "stats": stats, "codes": every}, mark, switches=switches)
    schema = artifacts.Schema(store.table(version, "stats"), store.table(version, "codes"), use_log, use_zscore)
    return Prepared(counts, cells.join(store.table(version, "split").hint("merge"), "cell_id"), schema, mark, resumed)


def patient_lists(spark: SparkSession, path: str, to: str) -> None:
    """The patients of each side as CSV folders ``<side>_patients``, from what was prepared."""
    store = Store(spark, path)
    version = store.last(NAME)
    if version is None:
        raise FileNotFoundError(f"nothing is prepared under {path}")
    rows = store.table(version, "patients")
    for side in ("train", "dev"):
        artifacts.write_csv(rows.where(F.col("split") == side).select("patient_id").distinct().orderBy("patient_id").coalesce(1), f"{to.rstrip('/')}/{side}_patients")
