"""Classification metrics over rows (y 0/1, p in [0, 1]), overall and by stratum.

Undefined values are null.  Area under the ROC curve is exact, with ties at mid-rank, and
works on counts per distinct score, so what a window sorts is distinct scores, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix as P

#: Ranges of scores that running counts are summed up by.
SCORE_BUCKETS = 4096

METRICS = ["AUROC", "accuracy", "error_rate", "F1", "precision", "recall", "FPR", "FNR", "RMSE", "positives_rate", "n"]


def valid(rows: DataFrame, score: str = "p") -> DataFrame:
    """Rows with a finite score; a null, NaN or infinite one can't be ranked."""
    return rows.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))


def score_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, y, w): rows of each distinct score and label.  Everything below works on this
    table, so one aggregation of the rows (whose exchange Spark reuses) serves all metrics."""
    return rows.groupBy(*keys, "p", "y").agg(F.count("*").alias("w"))


def _confusion(at: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    pos, hit = F.col("y") == 1, F.col("p") > threshold
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("w")).otherwise(0)), F.lit(0))
    return at.groupBy(*keys).agg(
        count(pos & hit).alias("tp"), count(~pos & hit).alias("fp"), count(~pos & ~hit).alias("tn"), count(pos & ~hit).alias("fn"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.sum(F.col("w") * F.pow(F.col("y") - F.col("p"), F.lit(2.0))).alias("se"), F.sum(F.col("w") * F.col("y")).alias("positives"),
    )


def confusion(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn (a prediction is positive above the threshold), n, squared error, positives."""
    return _confusion(score_counts(rows, keys), keys, threshold)


def _auroc(at: DataFrame, keys: list[str]) -> DataFrame:
    at = at.groupBy(*keys, "p").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum("w").alias("n"))
    at = P.running_sum(at.withColumn("neg", F.col("n") - F.col("pos")), keys, F.floor(F.col("p") * SCORE_BUCKETS), ["p"], "neg", "neg_below")
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return at.groupBy(*keys).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg").cast("double")).alias("AUROC"))


def auroc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, AUROC): the chance that a positive scores above a negative, ties half; null for one class."""
    return _auroc(score_counts(rows, keys), keys)


def roc_points(rows: DataFrame) -> DataFrame:
    """(p, fpr, tpr) at each distinct score, highest first."""
    at = rows.groupBy("p").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    at = at.withColumn("neg", F.col("n") - F.col("pos"))
    for c in ("neg", "pos"):
        at = P.running_sum(at, [], -F.floor(F.col("p") * SCORE_BUCKETS), [F.col("p").desc()], c, f"{c}_above")
    every = at.agg(F.sum("neg").alias("all_neg"), F.sum("pos").alias("all_pos"))
    at = at.crossJoin(F.broadcast(every))  # one row
    return at.select("p", F.try_divide(F.col("neg_above") + F.col("neg"), F.col("all_neg")).alias("fpr"), F.try_divide(F.col("pos_above") + F.col("pos"), F.col("all_pos")).alias("tpr"))


def rates(c: DataFrame) -> dict[str, Column]:
    div = F.try_divide
    return {
        "accuracy": div(F.col("tp") + F.col("tn"), F.col("n")),
        "error_rate": 1 - div(F.col("tp") + F.col("tn"), F.col("n")),
        "F1": div(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "precision": div(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": div(F.col("tp"), F.col("tp") + F.col("fn")),
        "FPR": div(F.col("fp"), F.col("fp") + F.col("tn")),
        "FNR": div(F.col("fn"), F.col("fn") + F.col("tp")),
        "RMSE": F.sqrt(div(F.col("se"), F.col("n"))),
        "positives_rate": div(F.col("positives"), F.col("n")),
    }


def _metrics(at: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    if keys:
        c = _confusion(at, keys, threshold).join(_auroc(at, keys), keys)
    else:
        c = _confusion(at, [], threshold).crossJoin(_auroc(at, []))  # one row each
    return c.select(*keys, *[v.alias(k) for k, v in rates(c).items()], "AUROC", "n")


def metrics(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """One row a group with all metrics."""
    return _metrics(score_counts(rows, keys), keys, threshold)


def with_stratum(rows: DataFrame, keys: tuple[str, str] = ("imputed_labels", "tissue_type")) -> DataFrame:
    """Adds ``stratum``, named ``<label>__<tissue>``."""
    return rows.withColumn("stratum", F.concat_ws("__", *[F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys]))


def by_stratum(rows: DataFrame, threshold: float = 0.5, keys: tuple[str, str] = ("imputed_labels", "tissue_type")) -> DataFrame:
    """Metrics of each stratum."""
    return metrics(with_stratum(rows, keys), ["stratum"], threshold)


def auroc_by_valid_stratum(rows: DataFrame) -> DataFrame:
    """(stratum, AUROC) of strata with both classes whose scores are all finite: one that can't be
    ranked takes its whole stratum out, as a part of the stratum says nothing of the model."""
    rows = with_stratum(rows)
    ok = F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") != float("inf"))
    at = rows.groupBy("stratum", "p", "y").agg(F.count("*").alias("w"))
    judged = at.groupBy("stratum").agg(F.min(ok).alias("whole"), F.count_distinct("y").alias("kinds"))
    fit = judged.where("whole and kinds = 2").select("stratum")
    return _auroc(at.join(fit, "stratum", "left_semi"), ["stratum"])


def tall(wide: DataFrame, scope: str, stratum: Column) -> DataFrame:
    """(scope, stratum, metric, value)."""
    names = [m for m in METRICS if m in wide.columns]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))
    return wide.select(F.lit(scope).alias("scope"), stratum.alias("stratum"), cells.alias("c")).select("scope", "stratum", "c.metric", "c.value")


def macro_average(strata_tall: DataFrame) -> DataFrame:
    """Mean over strata of each metric; undefined ones don't count."""
    return strata_tall.groupBy("metric").agg(F.avg("value").alias("value"))


def harmonic_mean(strata_tall: DataFrame) -> DataFrame:
    """Harmonic mean over strata: undefined ones don't count, any zero makes it zero."""
    h = F.when(F.min("value") == 0, F.lit(0.0)).otherwise(F.try_divide(F.count("value").cast("double"), F.sum(F.try_divide(F.lit(1.0), F.col("value")))))
    return strata_tall.groupBy("metric").agg(h.alias("value"))


def report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The whole evaluation as (scope, stratum, metric, value): overall, strata, averages."""
    at = score_counts(with_stratum(rows), ["stratum"])
    whole = at.groupBy("p", "y").agg(F.sum("w").alias("w"))
    overall = tall(_metrics(whole, [], threshold), "overall", F.lit(""))
    strata = tall(_metrics(at, ["stratum"], threshold), "stratum", F.col("stratum"))
    means = macro_average(strata.where("metric != 'n'")).select(F.lit("average").alias("scope"), F.lit("").alias("stratum"), "metric", "value")
    hmeans = harmonic_mean(strata.where("metric != 'n'")).select(F.lit("harmonic_avg").alias("scope"), F.lit("").alias("stratum"), "metric", "value")
    return overall.unionByName(strata).unionByName(means).unionByName(hmeans)


def as_dict(tall_rows: list) -> dict:
    """A collected report as a nested dict: overall metrics on top, strata and averages below."""
    out: dict = {}
    for r in tall_rows:
        value = float("nan") if r["value"] is None else r["value"]
        if r["scope"] == "overall":
            out[r["metric"]] = value
        else:
            out.setdefault(r["stratum"] if r["scope"] == "stratum" else r["scope"], {})[r["metric"]] = value
    return out


def batch_rates(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Rates for batch logs: a prediction counts as positive from the threshold on, and an
    undefined rate is 0."""
    pos, hit = F.col("y") == 1, F.col("p") >= threshold
    share = lambda a, b: F.coalesce(F.try_divide(F.sum(F.when(a, 1).otherwise(0)), F.sum(F.when(b, 1).otherwise(0))), F.lit(0.0))
    return rows.groupBy(*keys).agg(share(~pos & hit, ~pos).alias("fpr"), share(pos & ~hit, pos).alias("fnr"), share(pos != hit, F.lit(True)).alias("error_rate"))
