"""Training control as queries over logs (epoch, score) and (trial, step, score, state)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_stopping(log: DataFrame, patience: int, key: str = "run") -> DataFrame:
    """Adds best so far, epochs since it was reached, and whether training stops here.  A log
    has some hundred epochs; runs are apart."""
    so_far = Window.partitionBy(key).orderBy("epoch")
    rows = log.withColumn("best", F.max("score").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max("score").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("better", (before.isNull() | (F.col("score") > before)).cast("int"))
    rows = rows.withColumn("_at", F.max(F.when(F.col("better") == 1, F.col("epoch"))).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    wait = F.col("epoch") - F.col("_at")
    return rows.select(key, "epoch", "score", "best", wait.alias("wait"), (wait >= patience).alias("stop"))


def best_epoch(log: DataFrame, key: str = "run") -> DataFrame:
    """The first epoch of the highest score."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "epoch"))
    return log.withColumn("_r", rank).where("_r = 1").select(key, "epoch", "score")


def percentile_prune(log: DataFrame, keep: float = 0.6, warmup_steps: int = 5, startup_trials: int = 5, least: int = 5) -> DataFrame:
    """(trial, step, best, cutoff, prune): a trial goes where its best score so far is under the
    (1 - keep) percentile of all trials' at that step; not in the first steps or trials, nor
    with few reports."""
    so_far = Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("best", F.max("score").over(so_far))
    cut = rows.groupBy("step").agg(F.percentile("best", 1 - keep).alias("cutoff"), F.count("*").alias("reports"))
    rows = rows.join(cut, "step")
    prune = (F.col("step") >= warmup_steps) & (F.col("trial") >= startup_trials) & (F.col("reports") >= least) & (F.col("best") < F.col("cutoff"))
    return rows.select("trial", "step", "best", "cutoff", prune.alias("prune"))


def trial_summary(trials: DataFrame) -> DataFrame:
    """Per state the number of trials and the best score (NaN and null count as minus infinity)."""
    score = F.coalesce(F.nanvl("score", F.lit(float("-inf"))), F.lit(float("-inf")))
    return trials.groupBy("state").agg(F.count("*").alias("n"), F.max_by("trial", F.struct(score, -F.col("trial"))).alias("best_trial"), F.max(score).alias("best_score"))


def plateau_lr(scores: list[float], lr: float, factor: float = 0.1, patience: int = 3, low: float = 1e-6) -> float:
    """The rate after scores that should rise: cut each time none of ``patience`` epochs is better."""
    best, wait = float("-inf"), 0
    for s in scores:
        best, wait = (s, 0) if s > best else (best, wait + 1)
        if wait > patience:
            lr, wait = max(low, lr * factor), 0
    return lr


def lr_schedule(kind: str, epoch: int, epochs: int, lr: float = 1e-3, low: float = 1e-6) -> float:
    """The learning rate of an epoch."""
    if kind in ("none", "constant"):
        return lr
    if kind == "step":
        return lr * 0.1 ** (epoch // max(1, epochs // 3))
    if kind == "exponential":
        return lr * 0.95**epoch
    if kind == "cosine":
        return low + (lr - low) * (1 + math.cos(math.pi * epoch / max(1, epochs))) / 2
    if kind == "linear":
        return lr + (low - lr) * epoch / max(1, epochs)
    if kind == "onecycle":
        up = max(1, int(0.3 * epochs))
        return lr * (0.04 + 0.96 * epoch / up) if epoch < up else low + (lr - low) * (1 + math.cos(math.pi * (epoch - up) / max(1, epochs - up))) / 2
    raise ValueError(f"unknown schedule: {kind}")
