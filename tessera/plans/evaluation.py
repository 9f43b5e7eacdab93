"""Evaluate predictions and save all that comes of it, in one pass over the scores."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text
from tessera.operators import metrics
from tessera.sources import artifacts
from tessera.sources.store import Store

KEYS = ("imputed_labels", "tissue_type")


@dataclass
class Evaluated:
    """The scored cells as they were written, what was counted on the way, and the metrics."""

    scored: DataFrame
    seen: dict
    metrics: dict = field(default_factory=dict)


def evaluate_and_save(spark: SparkSession, predictions: DataFrame, cells: DataFrame, path: str, model_type: str, name: str = "dev", threshold: float = 0.5) -> Evaluated:
    """Joins predictions (cell_id, p) to ``cells`` by key and writes, under ``path``:

    ``scored_<name>`` (Parquet), the one pass over the plan behind ``predictions``, in which their
    number, bounds and lacks are counted; from it ``<model>_predictions`` (CSV, the cells with their prediction) and,
    where cells have ``expansion``, ``results_table_<name>``, ``roc_curve_<name>`` (CSV), ``auroc_per_strata.json``
    and the report ``results_<name>.txt``.

    ValueError if there are no predictions, one is missing for a cell, or one isn't in [0, 1]: then nothing but
    ``scored_<name>`` is written.  Without ``expansion`` the predictions are saved and there are no metrics."""
    store = Store(spark, path)
    with_labels = "expansion" in cells.columns
    rows = cells.join(predictions.select("cell_id", "p"), "cell_id", "left")
    if with_labels:
        rows = rows.withColumn("y", N.hard_label(F.col("expansion")))
    seen = Observation(f"scored {name}")
    bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
    counts = [F.count("*").alias("n"), F.min("p").alias("least"), F.max("p").alias("most"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad")]
    counts += [F.sum("y").alias("positives")] if with_labels else []
    at = f"{store.root}/scored_{name}"
    rows.observe(seen, *counts).write.mode("overwrite").parquet(at)
    found = seen.get
    if not found["n"]:
        raise ValueError("there are no predictions")
    if found["bad"]:
        raise ValueError(f"{found['bad']} of {found['n']} cells have no prediction in [0, 1]")
    scored = spark.read.schema(rows.schema).parquet(at)
    own = [c for c in cells.columns if c != "cell_id"]
    artifacts.write_csv(scored.select("cell_id", *own, F.col("p").alias(f"{model_type}_prediction")), f"{store.root}/{model_type}_predictions")
    out = Evaluated(scored, found)
    if not with_labels:
        return out
    artifacts.write_csv(artifacts.results_table(scored.select("cell_id", "y", "p", *own), threshold), f"{store.root}/results_table_{name}")
    keys = [c for c in KEYS if c in cells.columns]
    if len(keys) == 2:
        report = metrics.report(scored, threshold)
        strata = {r["stratum"]: r["AUROC"] for r in metrics.auroc_by_valid_stratum(scored).collect()}
        store.write_text(f"{store.root}/auroc_per_strata.json", json.dumps(strata, sort_keys=True, indent=1))
    else:  # strata need both columns
        report = metrics.tall(metrics.metrics(scored, [], threshold), "overall", F.lit(""))
    out.metrics = metrics.as_dict(report.collect())
    artifacts.write_csv(metrics.roc_points(scored), f"{store.root}/roc_curve_{name}")
    store.write_text(f"{store.root}/results_{name}.txt", text.report(out.metrics, f"Results ({name})"))
    return out
