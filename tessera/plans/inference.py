"""The façade: fit a schema, train a family, score cells, evaluate, save and load."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.models import estimators, network, registry, sgd, trees
from tessera.operators import matrix, metrics, scoring
from tessera.plans import evaluation, prepare
from tessera.sources import artifacts

SCORE_METRICS = set(metrics.METRICS)
LINEAR = ("logistic", "svm")
LOADERS = {"gbt": GBTClassificationModel}


@dataclass
class Trained:
    model_type: str
    schema: artifacts.Schema
    model: object


@dataclass
class Results:
    """Predictions (cell_id, p) and, where labels exist, metrics as a nested dict."""

    predictions: DataFrame
    metrics: dict = field(default_factory=dict)
    model_type: str = ""

    @property
    def has_metrics(self) -> bool:
        return bool(self.metrics)

    def n_predictions(self) -> int:
        return self.predictions.count()

    def auroc(self) -> float:
        return self.metrics.get("AUROC", float("nan"))

    def harmonic_auroc(self) -> float:
        return self.metrics.get("harmonic_avg", {}).get("AUROC", float("nan"))


def fit_schema(counts: DataFrame, genes: DataFrame, cells: DataFrame, use_log: bool = True, features: tuple[str, ...] = ("tissue_type", "imputed_labels")) -> artifacts.Schema:
    """Gene statistics and category codes of training cells."""
    stats = matrix.fit_stats(matrix.slice_rows(counts, cells), genes, cells, use_log)
    codes = None
    for f in (f for f in features if f in cells.columns):
        own = matrix.category_codes(cells, f)
        codes = own if codes is None else codes.unionByName(own)
    if codes is None:
        codes = cells.sparkSession.createDataFrame([], "feature string, category string, code long")
    return artifacts.Schema(stats, codes, use_log)


def vectors(counts: DataFrame, cells: DataFrame, schema: artifacts.Schema) -> DataFrame:
    """(cell_id, x): dense z-scores in gene order, for families that need them.  A cell's non-zeros
    meet in one row (as many as genes); the zeros between two of them are a slice of the
    schema's zero values, so a row costs its length and nothing is searched."""
    rows = sgd.sparse_rows(counts, cells, schema.stats, schema.use_log, schema.use_zscore)
    zero = sgd.initial(schema.stats, schema.use_zscore).where("gene_idx >= 0")
    zero = zero.agg(F.transform(F.array_sort(F.collect_list(F.struct("gene_idx", "z0"))), lambda s: s["z0"]).alias("_zero"))
    rows = rows.crossJoin(F.broadcast(zero)).withColumn("_before", F.array_insert(F.transform("e", lambda x: x["i"]), 1, F.lit(-1)))  # one row
    parts = F.transform("e", lambda x, k: F.concat(F.slice("_zero", F.get("_before", k) + 2, x["i"] - F.get("_before", k) - 1), F.array(F.get("_zero", x["i"]) + x["d"])))
    rest = F.slice("_zero", F.element_at("_before", -1) + 2, F.size("_zero"))
    return rows.select("cell_id", F.concat(F.flatten(parts), rest).alias("x"))


def train(spark: SparkSession, model_type: str, counts: DataFrame, genes: DataFrame, cells: DataFrame, params=None, dev_ratio: float = 0.2, seed: int = 1, use_log: bool = True, path: str | None = None, resume: bool = True, report=None) -> tuple[Trained, dict]:
    """A model trained on the training patients, and its metrics on the others.

    ``path``: a folder where the split, the schema and (linear families with ``SgdParams``) each epoch's
    state are kept as versions, and taken up from with ``resume``.  ``report`` is called with
    (epoch, score) where training has epochs."""
    registry.require(model_type)
    path = path or artifacts.scratch(spark, "training")
    own = prepare.prepare(spark, path, counts, genes, cells, dev_ratio, seed, use_log, resume=resume)
    rows = artifacts.written(own.cells, "training-cells")
    learn, dev, schema = rows.where("split = 'train'"), rows.where("split = 'dev'"), own.schema
    if model_type in LINEAR:
        if isinstance(params, sgd.SgdParams):
            fit = sgd.fit(spark, counts, learn, dev, schema, replace(params, loss=sgd.LOSSES[model_type]), path, own.fingerprint, resume, report)
            model = fit.weights
        else:
            sparse = sgd.sparse_rows(counts, learn, schema.stats, schema.use_log, schema.use_zscore)
            model = sgd.initial(schema.stats, schema.use_zscore)
            x = artifacts.written(sgd.training_rows(learn, sparse, sgd.SgdParams()), "training-rows")
            model = estimators.fit_sparse(model_type, x, model, params)
    elif isinstance(params, trees.LeafwiseParams):
        model = trees.fit(spark, counts, learn, schema.stats, params, schema.use_log)
    else:
        # Written once: each pass of an iterative fit reads rows, not the plan that makes them.
        x = artifacts.written(vectors(counts, learn, schema).join(learn.select("cell_id", "y"), "cell_id"), "training-rows")
        if model_type == "mlp":
            model = network.train_mlp(spark, x, params or network.MlpParams())[0]
        elif model_type == "autoencoder":
            model = network.train_ae(spark, x, params or network.AeParams())[0]
        else:
            model = estimators.fit(model_type, estimators.features(estimators.weighted(x)), params)
    trained = Trained(model_type, schema, model)
    return trained, run_inference(spark, trained, counts, dev).metrics


def linear_scores(spark: SparkSession, trained: Trained, counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, score, p) of a linear model, from the non-zeros alone; the matrix is never dense."""
    w, bias = sgd.as_gene_weights(trained.model, trained.schema.stats)
    return scoring.linear_sparse(counts, cells, trained.schema.stats, w, bias, trained.schema.use_log, trained.schema.use_zscore, "target")


def evaluate_and_save(spark: SparkSession, trained: Trained, counts: DataFrame, cells: DataFrame, path: str, name: str = "dev", prepared: str | None = None) -> evaluation.Evaluated:
    """Scores cells and saves predictions, tables, curve and report in one call, one pass over
    the counts (``evaluation.evaluate_and_save``); with ``prepared``, the folder of a preparation, its patient lists too."""
    out = evaluation.evaluate_and_save(spark, scores(spark, trained, counts, cells), cells, path, trained.model_type, name)
    if prepared:
        prepare.patient_lists(spark, prepared, path)
    return out


def scores(spark: SparkSession, trained: Trained, counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, p) of a model of any family, as a plan."""
    if trained.model_type in LINEAR:
        return linear_scores(spark, trained, counts, cells).select("cell_id", "p")
    if isinstance(trained.model, trees.Leafwise):
        return trees.predict(spark, trained.model, counts, cells, trained.schema.stats, trained.schema.use_log).select("cell_id", "p")
    x = vectors(counts, cells, trained.schema)
    if trained.model_type == "mlp":
        return network.predict(spark, x, trained.model)
    if trained.model_type == "autoencoder":
        return network.ae_predict(spark, x, trained.model).select("cell_id", "p")
    return estimators.predict(trained.model_type, trained.model, estimators.features(x)).select("cell_id", "p")


def run_inference(spark: SparkSession, trained: Trained, counts: DataFrame, cells: DataFrame, selected: DataFrame | None = None) -> Results:
    """Scores of cells, and metrics if they have ``expansion``."""
    cells = matrix.slice_rows(cells, selected)
    p = scores(spark, trained, counts, cells)
    p = artifacts.written(p, "predictions")  # the metrics and the caller both read them
    out = Results(p, {}, trained.model_type)
    if "expansion" in cells.columns:
        keys = [c for c in ("imputed_labels", "tissue_type") if c in cells.columns]
        rows = cells.select("cell_id", N.hard_label(F.col("expansion")).alias("y"), *keys).join(p, "cell_id")
        if len(keys) == 2:
            report = metrics.report(rows)
        else:  # strata need both columns
            report = metrics.tall(metrics.metrics(rows, []), "overall", F.lit(""))
        out.metrics = metrics.as_dict(report.collect())
    return out


def save(trained: Trained, path: str) -> None:
    """Schema, model and type under one folder, through Spark's own writers."""
    artifacts.save_schema(trained.schema, f"{path}/schema")
    spark = trained.schema.stats.sparkSession
    spark.createDataFrame([(trained.model_type,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model_type")
    if isinstance(trained.model, DataFrame):
        trained.model.write.mode("overwrite").parquet(f"{path}/linear")
    elif isinstance(trained.model, trees.Leafwise):
        base = spark.createDataFrame([(-1, 0, -1, 0.0, -1, -1, trained.model.base)], trees.MODEL)
        trained.model.nodes.unionByName(base).write.mode("overwrite").parquet(f"{path}/trees")
    elif isinstance(trained.model, dict):
        rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in sorted(trained.model.items())]
        spark.createDataFrame(rows, "name string, shape array<int>, value array<double>").write.mode("overwrite").parquet(f"{path}/weights")
    else:
        trained.model.write().overwrite().save(f"{path}/model")


def load(spark: SparkSession, path: str) -> Trained:
    kind = spark.read.text(f"{path}/model_type").first()["value"].strip()
    registry.require(kind)
    schema = artifacts.load_schema(spark, f"{path}/schema")
    if kind in LINEAR:
        return Trained(kind, schema, spark.read.parquet(f"{path}/linear"))
    if artifacts.exists(spark, f"{path}/trees"):
        nodes = spark.read.parquet(f"{path}/trees")
        return Trained(kind, schema, trees.Leafwise(nodes.where("tree = -1").first()["value"], nodes.where("tree >= 0")))
    if kind in LOADERS:
        return Trained(kind, schema, LOADERS[kind].load(f"{path}/model"))
    rows = spark.read.parquet(f"{path}/weights").collect()
    return Trained(kind, schema, {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in rows})


def require_metric(name: str) -> str:
    """Unknown metrics are refused before a search begins."""
    if name not in SCORE_METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(SCORE_METRICS)}")
    return name


def summary_json(results: Results) -> str:
    return json.dumps({"model_type": results.model_type, "metrics": results.metrics}, sort_keys=True, default=str)
