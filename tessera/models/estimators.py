"""Linear and tree families as Spark ML estimators on a vector column ``features``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators.batching import class_weights


@dataclass(frozen=True)
class LinearParams:
    alpha: float = 1e-4
    l1_ratio: float = 0.0
    max_epochs: int = 100


@dataclass(frozen=True)
class TreeParams:
    max_depth: int = 5
    n_trees: int = 20
    learning_rate: float = 0.1


def weighted(rows: DataFrame, label: str = "y") -> DataFrame:
    """Adds ``weight``, balanced over classes."""
    return rows.join(F.broadcast(class_weights(rows, label).select(label, "weight")), label)  # two rows


def features(rows: DataFrame, array: str = "x") -> DataFrame:
    return rows.withColumn("features", array_to_vector(array))


def fit(model_type: str, rows: DataFrame, params=None):
    """A fitted model of a linear or tree family on rows with features, y and weight."""
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    if model_type == "logistic":
        p = params or LinearParams()
        return LogisticRegression(regParam=p.alpha, elasticNetParam=p.l1_ratio, maxIter=p.max_epochs, **common).fit(rows)
    if model_type == "svm":
        p = params or LinearParams()
        return LinearSVC(regParam=p.alpha, maxIter=p.max_epochs, **common).fit(rows)
    if model_type == "gbt":
        p = params or TreeParams()
        return GBTClassifier(maxDepth=p.max_depth, maxIter=p.n_trees, stepSize=p.learning_rate, seed=1, **common).fit(rows)
    raise ValueError(f"no estimator for {model_type!r}")


def fit_sparse(model_type: str, rows: DataFrame, weights: DataFrame, params=None) -> DataFrame:
    """Weights (gene_idx, z0, w) of a linear family, fitted on rows (e, y, weight) as sparse vectors.

    The features are differences from an implicit zero's z-scores.  Only the intercept sees the
    shift, and it has no penalty, so the weights are those of the z-scores themselves."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    n = weights.where("gene_idx >= 0").count()

    @F.udf(VectorUDT())
    def sparse(e):
        return Vectors.sparse(n, [x["i"] for x in e], [x["d"] for x in e])

    model = fit(model_type, rows.withColumn("features", sparse("e")), params)
    spark = rows.sparkSession
    found = spark.createDataFrame([(-1, float(model.intercept)), *enumerate(map(float, model.coefficients.toArray()))], "gene_idx int, v double")  # as many as genes
    found = weights.select("gene_idx", "z0").join(found, "gene_idx")
    shift = found.where("gene_idx >= 0").agg(F.coalesce(F.sum(F.col("v") * F.col("z0")), F.lit(0.0)).alias("shift"))  # one row
    w = F.when(F.col("gene_idx") == -1, F.col("v") - F.col("shift")).otherwise(F.col("v"))
    return found.crossJoin(F.broadcast(shift)).select("gene_idx", "z0", w.alias("w"))


def predict(model_type: str, model, rows: DataFrame) -> DataFrame:
    """``rows`` with p; a decision value without probability goes through a sigmoid."""
    out = model.transform(rows)
    if model_type == "svm":
        p = N.sigmoid(F.get(vector_to_array("rawPrediction"), F.lit(1)))
    else:
        p = F.get(vector_to_array("probability"), F.lit(1))
    return out.withColumn("p", F.nanvl(p, F.lit(0.5))).drop("rawPrediction", "probability", "prediction")
