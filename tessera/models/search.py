"""Hyper-parameter search: seeded sampling of a space, trials as rows, pruning by percentile."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.training import trial_summary

#: The ranges of the search spaces by family.  A list is a choice, a pair of
#: numbers a range, ("log", a, b) a range on a logarithmic scale.
SPACES: dict[str, dict] = {
    "logistic": {"alpha": ("log", 1e-6, 1e-1), "l1_ratio": (0.0, 0.9)},
    "svm": {"alpha": ("log", 1e-6, 1e-1)},
    "gbt": {"max_depth": [3, 4, 5, 6], "n_trees": [10, 20, 40], "learning_rate": ("log", 1e-2, 3e-1)},
    "mlp": {"lr": ("log", 1e-4, 1e-1), "layers": [(32,), (64, 32), (128, 64)], "weight_decay": ("log", 1e-6, 1e-2)},
    "autoencoder": {"lr": ("log", 1e-4, 1e-1), "latent": [4, 8, 16], "classifier_weight": (0.1, 2.0)},
}

#: Errors that end a search; any other makes its trial fail with the lowest score.
CRITICAL = (KeyboardInterrupt, SystemExit, MemoryError)


@dataclass(frozen=True)
class Trial:
    trial: int
    params: dict
    state: str = "waiting"
    score: float = float("-inf")


def sample(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, spec in space.items():
        if isinstance(spec, list):
            out[name] = rng.choice(spec)
        elif spec[0] == "log":
            out[name] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
        else:
            out[name] = rng.uniform(*spec)
    return out


def score_of(metrics: dict, name: str) -> float:
    """The searched metric; lacking, null or NaN counts as minus infinity."""
    value = metrics.get(name) if isinstance(metrics, dict) else None
    return float("-inf") if value is None or math.isnan(value) else float(value)


def run(family: str, objective: Callable[[dict], dict], n_trials: int, metric: str = "AUROC", seed: int = 1, done: list[Trial] | None = None, parallel: int = 1) -> list[Trial]:
    """Finished trials, those of an earlier search (``done``) included and not repeated.

    ``objective`` takes parameters and returns metrics; each runs Spark jobs of its own, so
    trials may run in parallel on one session."""
    if family not in SPACES:
        raise ValueError(f"unknown family {family!r}")
    rng = random.Random(seed)
    planned = [Trial(k, sample(SPACES[family], rng)) for k in range(n_trials)]
    kept = {t.trial: t for t in done or [] if t.state == "complete"}

    def one(t: Trial) -> Trial:
        if t.trial in kept:
            return kept[t.trial]
        try:
            return Trial(t.trial, t.params, "complete", score_of(objective(t.params), metric))
        except CRITICAL:
            raise
        except Exception:  # a set of parameters that doesn't work is a result
            return Trial(t.trial, t.params, "fail")

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return list(pool.map(one, planned))


def best(trials: list[Trial]) -> Trial | None:
    good = [t for t in trials if t.state == "complete" and t.score > float("-inf")]
    return max(good, key=lambda t: (t.score, -t.trial)) if good else None


def as_table(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    rows = [(t.trial, t.state, t.score, json.dumps(t.params, sort_keys=True)) for t in trials]
    return spark.createDataFrame(rows, "trial long, state string, score double, params string")


def from_table(df: DataFrame) -> list[Trial]:
    return [Trial(r["trial"], json.loads(r["params"]), r["state"], r["score"]) for r in df.orderBy("trial").collect()]


def summary(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    return trial_summary(as_table(spark, trials))
