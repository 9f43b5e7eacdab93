"""Mini-batch gradient descent for linear families on the non-zeros of a count matrix.

The state is a table of weights (gene_idx, z0, w), the intercept at gene_idx -1.  With
d = z - z0, the difference of an entry's z-score from that of an implicit zero,

    score(c) = b + sum_g w_g z0_g + sum over the cell's non-zeros of w_g d_cg
    gradient_g = (sum_c r_c z0_g + sum over the batch's non-zeros of r_c d_cg) / n

where r_c is the loss's derivative at the cell's score.  So a step is one aggregation of the
batch's non-zeros by gene, and the dense matrix never exists.  L2 is one factor on all
weights, L1 a soft threshold.  After each epoch the other patients' score decides: the best
state is kept, ``patience`` epochs without a better one end the training, and every epoch's state is a
version in a store, from which a run is taken up where it broke off.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import numeric as N
from tessera.operators import batching, matrix, metrics
from tessera.sources import artifacts
from tessera.sources.store import ChangedInput, Store, Version

NAME = "linear"
LOSSES = {"logistic": "log", "svm": "hinge"}


@dataclass(frozen=True)
class SgdParams:
    """Defaults of the searched ranges; ``learning_rate``: constant, invscaling or optimal."""

    loss: str = "log"
    penalty: str = "l2"
    alpha: float = 1e-4
    l1_ratio: float = 0.15
    learning_rate: str = "invscaling"
    eta0: float = 0.1
    power_t: float = 0.5
    batch_size: int = 2048
    n_epochs: int = 1000
    patience: int = 5
    eval_interval: int = 1
    sampler: str = "random"
    balanced: bool = True
    soft_beta: float | None = None
    relayout: int = 0
    seed: int = 42
    metric: str = "harmonic_avg/AUROC"

    def __post_init__(self):
        if self.loss not in ("log", "hinge") or self.penalty not in ("l1", "l2", "elasticnet") or self.learning_rate not in ("constant", "invscaling", "optimal"):
            raise ValueError(f"unknown loss, penalty or learning rate: {self.loss}, {self.penalty}, {self.learning_rate}")
        if self.batch_size < 1 or self.n_epochs < 1 or self.patience < 1 or self.eval_interval < 1:
            raise ValueError("batch_size, n_epochs, patience and eval_interval must be positive")

    @property
    def lasso(self) -> float:
        return {"l1": 1.0, "l2": 0.0}.get(self.penalty, self.l1_ratio)

    def rate(self, step: int) -> float:
        """The learning rate of a step, counted from 0."""
        if self.learning_rate == "constant":
            return self.eta0
        if self.learning_rate == "invscaling":
            return self.eta0 / (step + 1) ** self.power_t
        typical = math.sqrt(1 / math.sqrt(self.alpha))
        slope = 1 / (1 + math.exp(-typical)) if self.loss == "log" else 1.0
        return 1 / (self.alpha * (1 / (typical / max(1.0, slope) * self.alpha) + step))


def sparse_rows(counts: DataFrame, cells: DataFrame, stats: DataFrame, use_log: bool = True, use_zscore: bool = True) -> DataFrame:
    """(cell_id, e array<struct<i, d>>), one row a cell, cells without counts included: its fitted
    genes' places and differences from an implicit zero's z-score.  A row holds at most a cell's genes."""
    z = matrix.preprocess(matrix.slice_rows(counts, cells), stats, log=use_log, use_zscore=use_zscore)
    zero = N.zscore(F.lit(0.0), F.col("mu"), F.col("sigma")) if use_zscore else F.lit(0.0)
    one = F.struct(F.col("gene_idx").cast("int").alias("i"), (F.col("z") - zero).alias("d"))
    own = z.groupBy("cell_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    return cells.select("cell_id").join(own, "cell_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<i:int,d:double>>")))


def initial(stats: DataFrame, use_zscore: bool = True) -> DataFrame:
    """Weights of zero for every gene and the intercept."""
    zero = N.zscore(F.lit(0.0), F.col("mu"), F.col("sigma")) if use_zscore else F.lit(0.0)
    own = stats.select(F.col("gene_idx").cast("int").alias("gene_idx"), zero.alias("z0"), F.lit(0.0).alias("w"))
    return own.unionByName(own.sparkSession.createDataFrame([(-1, 0.0, 0.0)], "gene_idx int, z0 double, w double"))


def scored(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` (with e) and their score.  A task has the weights once, as an array by gene: a row never carries them."""
    have = sorted((r["gene_idx"], r["w"], r["z0"]) for r in weights.collect())  # as many as genes
    bias = next(w for i, w, _ in have if i == -1)
    w = np.array([w for i, w, _ in have if i >= 0], float)
    base = bias + sum(w * z0 for i, w, z0 in have if i >= 0)
    rows = rows.drop("score")
    shape = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["e"]
            at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            entries = lists.flatten()
            i, d = entries.field("i").to_numpy(), entries.field("d").to_numpy()
            own = np.where(i < len(w), w[np.minimum(i, len(w) - 1)], 0.0) * d if len(w) else np.zeros(len(i))
            score = base + np.bincount(at, own, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=shape.names)

    return rows.mapInArrow(work, shape)


def slope(loss: str, y: Column, score: Column) -> Column:
    """The loss's derivative at a score; y in [0, 1] for the log loss, 0 or 1 for the hinge."""
    if loss == "log":
        return N.sigmoid(score) - y
    t = F.when(y > 0.5, 1.0).otherwise(-1.0)
    return F.when(t * score < 1, -t).otherwise(0.0)


def gradient(batch: DataFrame, weights: DataFrame, loss: str) -> DataFrame:
    """(gene_idx, z0, w, g) of rows (e, y, weight): the mean gradient of the loss, the intercept's too."""
    rows = scored(batch, weights).withColumn("r", F.col("weight") * slope(loss, F.col("y"), F.col("score")))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("d")))
    sums = rows.select("r", F.explode(F.concat(whole, "e")).alias("x")).groupBy(F.col("x.i").alias("gene_idx")).agg(F.sum(F.col("r") * F.col("x.d")).alias("s"), F.count("*").alias("k"))
    one = sums.where("gene_idx = -1").select(F.col("s").alias("all_r"), F.col("k").alias("n"))
    found = weights.join(sums.select("gene_idx", "s"), "gene_idx", "left").crossJoin(F.broadcast(one))  # one row
    return found.select("gene_idx", "z0", "w", ((F.coalesce("s", F.lit(0.0)) + F.col("all_r") * F.col("z0")) / F.col("n")).alias("g"))


def stepped(batch: DataFrame, weights: DataFrame, params: SgdParams, step: int) -> DataFrame:
    """The weights after one step; the intercept has no penalty."""
    rate, lasso = params.rate(step), params.lasso
    moved = F.col("w") * (1 - rate * params.alpha * (1 - lasso)) - rate * F.col("g")
    shrunk = F.signum(moved) * F.greatest(F.abs(moved) - rate * params.alpha * lasso, F.lit(0.0)) if lasso else moved
    w = F.when(F.col("gene_idx") == -1, F.col("w") - rate * F.col("g")).otherwise(shrunk)
    return gradient(batch, weights, params.loss).select("gene_idx", "z0", w.alias("w"))


def training_rows(cells: DataFrame, sparse: DataFrame, params: SgdParams) -> DataFrame:
    """(cell_id, y, weight, e) of labelled cells (y, and clone sizes where soft labels are asked for)."""
    y = F.col("y").cast("double")
    if params.soft_beta is not None and {"clone_id_size", "median_clone_size"} <= set(cells.columns):
        y = N.soft_label(F.col("clone_id_size"), F.col("median_clone_size"), params.soft_beta)
    rows = cells.withColumn("weight", F.lit(1.0))
    if params.balanced:
        rows = cells.join(F.broadcast(batching.class_weights(cells).select("y", "weight")), "y")  # two rows
    return rows.select("cell_id", y.alias("y"), "weight").join(sparse, "cell_id")


def predictions(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(cell_id, p) of rows with e; a hinge score goes through a sigmoid as well."""
    return scored(rows, weights).select("cell_id", N.sigmoid(F.col("score")).alias("p"))


def evaluated(rows: DataFrame, cells: DataFrame, weights: DataFrame) -> dict:
    """The whole report on labelled cells as a nested dict."""
    keys = [c for c in ("imputed_labels", "tissue_type") if c in cells.columns]
    found = cells.select("cell_id", "y", *keys).join(predictions(rows, weights), "cell_id")
    report = metrics.report(found) if len(keys) == 2 else metrics.tall(metrics.metrics(found, []), "overall", F.lit(""))
    return metrics.as_dict(report.collect())


def metric_of(found: dict, path: str) -> float:
    """A metric by its path (``AUROC``, ``harmonic_avg/AUROC``); what isn't there or not a number is the lowest."""
    at: object = found
    for part in path.split("/"):
        at = at.get(part) if isinstance(at, dict) else None
    return float("-inf") if at is None or isinstance(at, dict) or math.isnan(at) else float(at)


def _laid_out(cells: DataFrame, rows: DataFrame, params: SgdParams, epoch: int) -> DataFrame:
    """The rows in folders by batch_id, so that a step reads its own batch only."""
    dealt = batching.train_batches(params.sampler, cells, params.batch_size, params.seed + epoch)
    path = artifacts.scratch(cells.sparkSession, "sgd-batches")
    rows = rows.join(dealt.withColumnRenamed("batch_id", "batch"), "cell_id")
    rows.repartition("batch").write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass
class Fit:
    """The best state and the epochs that led to it: (epoch, score) each."""

    weights: DataFrame
    best_epoch: int
    best_score: float
    history: list[tuple[int, float]]
    stopped: bool


def fit(
    spark: SparkSession, counts: DataFrame, learn: DataFrame, dev: DataFrame, schema: artifacts.Schema, params: SgdParams, path: str | None = None,
    mark: str = "", resume: bool = True, report: Callable[[int, float], None] | None = None,
) -> Fit:
    """Trains on cells ``learn`` (y), scores cells ``dev`` after each ``eval_interval`` epochs.

    ``path``: a store's folder.  Each scored epoch is committed there under ``linear`` with its score and the
    history; with ``resume`` a run of the same inputs (``mark``) and parameters goes on after the last
    of them, and gives what an unbroken one would.  ``report`` is called with each score and may end the run by raising."""
    store = Store(spark, path or artifacts.scratch(spark, "sgd-store"))
    mark = json.dumps([mark, {k: v for k, v in asdict(params).items() if k != "n_epochs"}], sort_keys=True)
    found = store.resume(NAME, mark) if resume else None
    if not resume and store.last(NAME):
        raise ChangedInput(f"{store.root} has versions of an earlier run; resume it or take another folder")
    history: list[tuple[int, float]] = [tuple(x) for x in found.manifest["history"]] if found else []
    step = found.manifest["step"] if found else 0
    weights = store.table(found, "weights") if found else artifacts.written(initial(schema.stats, schema.use_zscore), "sgd-weights")

    rows = artifacts.written(training_rows(learn, sparse_rows(counts, learn, schema.stats, schema.use_log, schema.use_zscore), params), "sgd-rows")
    held_out = artifacts.written(sparse_rows(counts, dev, schema.stats, schema.use_log, schema.use_zscore), "sgd-dev")
    learn = artifacts.written(learn.select("cell_id", "y", *[c for c in ("tissue_type", "imputed_labels") if c in learn.columns]), "sgd-cells")
    done = found.manifest["epoch"] + 1 if found else 0
    best: Version | None = store.best(NAME)
    waited, batches, laid = _waited(history), None, None
    for epoch in range(done, params.n_epochs):
        if waited >= params.patience:
            break
        layout = epoch // params.relayout * params.relayout if params.relayout else 0
        if layout != laid:
            batches, laid = _laid_out(learn, rows, params, layout), layout
            numbers = sorted(r["batch"] for r in batches.select("batch").distinct().collect())
        for b in numbers:
            weights = artifacts.written(stepped(batches.where(F.col("batch") == b), weights, params, step), "sgd-weights")
            step += 1
        if (epoch + 1) % params.eval_interval and epoch + 1 < params.n_epochs:
            continue
        score = metric_of(evaluated(held_out, dev, weights), params.metric)
        history.append((epoch, score))
        version = store.commit(NAME, {"weights": weights}, mark, score=score if score > float("-inf") else None, epoch=epoch, step=step, history=history)
        weights = store.table(version, "weights")
        best, waited = store.best(NAME), _waited(history)
        store.prune(NAME)
        if report:
            report(epoch, score)
    if best is None:  # no score at all: the last state
        best = store.last(NAME)
    return Fit(store.table(best, "weights"), best.manifest["epoch"], float("-inf") if best.score is None else best.score, history, waited >= params.patience)


def _waited(history: list[tuple[int, float]]) -> int:
    """Scores since the best one, the first of equals."""
    if not history:
        return 0
    scores = [s for _, s in history]
    return len(scores) - 1 - scores.index(max(scores))


def as_gene_weights(weights: DataFrame, stats: DataFrame) -> tuple[DataFrame, float]:
    """(gene_id, w) and the intercept, for ``scoring.linear_sparse`` and the scorer of streams."""
    bias = weights.where("gene_idx = -1").first()["w"]
    return stats.select("gene_id", F.col("gene_idx").cast("int").alias("gene_idx")).join(weights, "gene_idx").select("gene_id", "w"), float(bias)
