"""Patient-disjoint stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix as P


def patient_id() -> Column:
    """study:patient."""
    return F.concat_ws(":", F.col("study").cast("string"), F.col("patient").cast("string"))


def patients(cells: DataFrame) -> DataFrame:
    """(patient_id, cancer_type), one row each pair."""
    return cells.select(patient_id().alias("patient_id"), "cancer_type").distinct()


def bad_identifiers(cells: DataFrame) -> DataFrame:
    """Studies and patients whose names hold the separator."""
    names = cells.select(F.explode(F.array(F.struct(F.lit("study").alias("kind"), F.col("study").alias("name")), F.struct(F.lit("patient").alias("kind"), F.col("patient").alias("name")))).alias("n")).select("n.kind", "n.name")
    return names.where(F.contains("name", F.lit(":"))).distinct()


def many_cancers(cells: DataFrame) -> DataFrame:
    """Patients that don't have exactly one cancer type."""
    return cells.groupBy(patient_id().alias("patient_id")).agg(F.count_distinct("cancer_type").alias("n_types")).where("n_types != 1")


def split_patients(cells: DataFrame, dev_ratio: float = 0.2, seed: int = 1) -> DataFrame:
    """(patient_id, cancer_type, split): of each cancer type's n patients, round(ratio n) go to
    dev, at least one from two patients on; which, an md5 of seed and name decides."""
    rows = patients(cells).withColumn("h", F.md5(F.concat(F.col("patient_id"), F.lit(f":{seed}"))))
    rows = rows.withColumn("cancer_type", F.coalesce("cancer_type", F.lit("nan")))
    n = F.col("n")
    dev = F.when(n >= 2, F.greatest(F.lit(1), F.floor(n * dev_ratio + 0.5))).otherwise(F.lit(0))
    sizes = F.broadcast(rows.groupBy("cancer_type").agg(F.count("*").alias("n")))  # a row a type: joined by key, a type's patients would lie in one task
    rows = P.place(rows, ["cancer_type"], P.hash_bucket("h"), ["h", "patient_id"]).join(sizes, "cancer_type")
    return rows.select("patient_id", "cancer_type", F.when(F.col("place") < dev, "dev").otherwise("train").alias("split"))


def checked_split(cells: DataFrame, dev_ratio: float = 0.2, seed: int = 1) -> DataFrame:
    """``split_patients`` after checks; ValueError names the offenders (the first hundred)."""
    bad = sorted(r["name"] for r in bad_identifiers(cells).limit(100).collect())
    if bad:
        raise ValueError(f"names must not contain ':': {bad}")
    many = sorted(r["patient_id"] for r in many_cancers(cells).limit(100).collect())
    if many:
        raise ValueError(f"patients without exactly one cancer type: {many}")
    return split_patients(cells, dev_ratio, seed)


def split_cells(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """(cell_id, split)."""
    return cells.withColumn("patient_id", patient_id()).join(parts.select("patient_id", "split"), "patient_id").select("cell_id", "split")


def summary(cells: DataFrame, parts: DataFrame) -> DataFrame:
    rows = cells.withColumn("patient_id", patient_id()).join(parts.select("patient_id", "split"), "patient_id")
    return rows.groupBy("split").agg(F.count_distinct("patient_id").alias("n_patients"), F.count("*").alias("n_cells"))


def distribution(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """(split, feature, category, percent): cancer types per patient, the others per cell."""
    rows = cells.withColumn("patient_id", patient_id()).join(parts.select("patient_id", "split"), "patient_id")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit("nan")).alias("category")) for c in ("imputed_labels", "tissue_type")])
    per_cell = rows.select("split", F.explode(pairs).alias("f")).select("split", "f.feature", "f.category")
    per_patient = parts.select("split", F.lit("cancer_type").alias("feature"), F.coalesce("cancer_type", F.lit("nan")).alias("category"))
    n = per_cell.unionByName(per_patient).groupBy("split", "feature", "category").agg(F.count("*").alias("n"))
    return n.select("split", "feature", "category", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("split", "feature"))).alias("percent"))


def overview(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("n_cells"), F.count_distinct(patient_id()).alias("n_patients"), F.count_distinct("sample").alias("n_samples"), F.count_distinct("cancer_type").alias("n_cancer_types"))
