"""A search whose trials report while they run, are pruned, and can be taken up again.

Everything lies in a folder of any Hadoop store, a small file each: the study, a state a trial,
a report a step.  A trial runs in a thread of its own under a job tag; when it is pruned, by
its own report or by a watcher, its Spark jobs are cancelled by that tag and no others are.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.store import ChangedInput, Store

from .parzen import Sampler
from .search import CRITICAL, Trial, score_of
from .spaces import SPACES, Param, validate

STATES = ("running", "complete", "pruned", "fail")
LOWEST = float("-inf")


class Pruned(Exception):
    """Raised in a trial whose reports fall behind."""


def percentile(values: list[float], share: float) -> float:
    """Linear interpolation between the sorted values, as ``F.percentile``."""
    own = sorted(values)
    at = share * (len(own) - 1)
    low = int(at)
    return own[low] if low + 1 == len(own) else own[low] + (at - low) * (own[low + 1] - own[low])


def behind(reports: dict[int, dict[int, float]], trial: int, step: int, keep: float = 0.6, warmup_steps: int = 5, startup_trials: int = 5, least: int = 5) -> bool:
    """Whether a trial's best score so far is under the (1 - keep) percentile of all trials' at that
    step; the rule of ``training.percentile_prune`` on (trial, step, score)."""
    if step < warmup_steps or trial < startup_trials:
        return False
    best = {t: max(s for k, s in own.items() if k <= step) for t, own in reports.items() if step in own}
    return len(best) >= least and best[trial] < percentile(list(best.values()), 1 - keep)


class Run:
    """What an objective gets: its parameters, a folder of its own, and ``report``."""

    def __init__(self, study: Study, trial: int, params: dict, resumed: bool):
        self.study, self.trial, self.params, self.resumed = study, trial, params, resumed
        self.folder = f"{study.store.root}/work/{trial:06d}"
        self.tag = f"trial-{study.name}-{trial}"

    def report(self, step: int, score: float) -> None:
        """Keeps the first score of a step (a step that a resumed trial repeats changes nothing), and
        raises ``Pruned`` if the trial is behind."""
        self.study.reported(self.trial, step, score_of({"v": score}, "v"))
        if self.study.should_stop(self.trial):
            raise Pruned(f"trial {self.trial} at step {step}")


class Study:
    def __init__(self, spark: SparkSession, path: str, family: str, space: list[Param] | None = None, metric: str = "harmonic_avg/AUROC", sampler: Sampler | None = None, resume: bool = False, **pruning):
        if space is None and family not in SPACES:
            raise ValueError(f"unknown family {family!r}")
        self.spark, self.store, self.family, self.metric = spark, Store(spark, path), family, metric
        self.space, self.sampler, self.pruning = space or SPACES[family], sampler or Sampler(), pruning
        self.name = self.store.root.rpartition("/")[2]
        self.lock, self.stopped = threading.Lock(), set()
        about = {"family": family, "metric": metric, "space": [repr(p) for p in self.space], "sampler": repr(self.sampler)}
        known = f"{self.store.root}/study.json"
        if self.store.exists(known):
            if not resume:
                raise ChangedInput(f"{path} holds a study; resume it or take another folder")
            if json.loads(self.store.read_text(known)) != about:
                raise ChangedInput(f"{path} holds a study of another family, metric, space or sampler")
        else:
            self.store.write_text(known, json.dumps(about, sort_keys=True))
        self.reports: dict[int, dict[int, float]] = {}
        for t in self._read("reports"):
            self.reports.setdefault(t["trial"], {})[t["step"]] = t["score"]

    # What is kept.

    def _read(self, kind: str) -> list[dict]:
        root = f"{self.store.root}/{kind}"
        return [json.loads(self.store.read_text(f"{root}/{x}")) for x in self.store.names(root) if x.endswith(".json")]

    def trials(self) -> list[Trial]:
        return sorted((Trial(t["trial"], t["params"], t["state"], t["score"]) for t in self._read("trials")), key=lambda t: t.trial)

    def _keep(self, t: Trial) -> Trial:
        self.store.write_text(f"{self.store.root}/trials/{t.trial:06d}.json", json.dumps({"trial": t.trial, "params": t.params, "state": t.state, "score": t.score}, sort_keys=True))
        return t

    def reported(self, trial: int, step: int, score: float) -> None:
        with self.lock:
            own = self.reports.setdefault(trial, {})
            if step in own:
                return
            own[step] = score
            self.store.write_text(f"{self.store.root}/reports/{trial:06d}-{step:06d}.json", json.dumps({"trial": trial, "step": step, "score": score}))
            if behind(self.reports, trial, step, **self.pruning):
                self.stopped.add(trial)

    def should_stop(self, trial: int) -> bool:
        return trial in self.stopped

    def stop(self, trial: int) -> None:
        """Ends a trial from outside: its running Spark jobs are cancelled."""
        self.stopped.add(trial)
        self.spark.sparkContext.cancelJobsWithTag(f"trial-{self.name}-{trial}")

    def cleanup(self) -> list[int]:
        """Forgets trials that broke off before they left anything; gives their numbers."""
        gone = [t.trial for t in self.trials() if t.state == "running" and not self.store.names(f"{self.store.root}/work/{t.trial:06d}") and not self.reports.get(t.trial)]
        for n in gone:
            self.store.delete(f"{self.store.root}/trials/{n:06d}.json")
        return gone

    # The search.

    def run(self, objective: Callable[[Run], dict], n_trials: int, parallel: int = 1) -> list[Trial]:
        """Runs until there are ``n_trials`` finished trials; those on record count and aren't repeated.

        Trials that broke off go first, with their parameters and folder.  An error in a trial makes it
        a failed one with the lowest score; critical ones end the search and leave it as running."""
        self.cleanup()
        known = {t.trial: t for t in self.trials()}
        again = [t for t in known.values() if t.state == "running"]
        fresh = [n for n in range(n_trials) if n not in known]
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            done = list(pool.map(lambda t: self._one(objective, t.trial, t.params), again))
            done += list(pool.map(lambda n: self._one(objective, n, None), fresh))
        return self.trials()

    def _one(self, objective: Callable[[Run], dict], number: int, params: dict | None) -> Trial:
        resumed = params is not None
        if params is None:
            with self.lock:
                finished = [(t.trial, t.params, t.score) for t in self.trials() if t.state in ("complete", "pruned") and t.score > LOWEST]
                params = validate(self.space, self.sampler.suggest(self.space, number, finished))
                self._keep(Trial(number, params, "running"))
        run, sc = Run(self, number, params, resumed), self.spark.sparkContext
        sc.addJobTag(run.tag)
        watched = threading.Event()
        watcher = threading.Thread(target=self._watch, args=(run, watched), daemon=True)
        watcher.start()
        try:
            return self._keep(Trial(number, params, "complete", score_of(_flat(objective(run)), self.metric)))
        except CRITICAL:
            raise
        except Exception:  # a set of parameters that doesn't work is a result
            if self.should_stop(number):
                best = max(self.reports.get(number, {}).values(), default=LOWEST)
                return self._keep(Trial(number, params, "pruned", best))
            return self._keep(Trial(number, params, "fail"))
        finally:
            watched.set()
            watcher.join()
            sc.removeJobTag(run.tag)
            sc.cancelJobsWithTag(run.tag)  # what a trial may have left running in the background

    def _watch(self, run: Run, over: threading.Event) -> None:
        """Cancels a trial's jobs as soon as it is to stop, also in the middle of one."""
        while not over.wait(0.2):
            if self.should_stop(run.trial):
                self.spark.sparkContext.cancelJobsWithTag(run.tag)

    # Tables.

    def table(self) -> DataFrame:
        rows = [(t.trial, t.state, t.score, json.dumps(t.params, sort_keys=True)) for t in self.trials()]
        return self.spark.createDataFrame(rows, "trial long, state string, score double, params string")

    def report_table(self) -> DataFrame:
        """(trial, step, score) for ``training.percentile_prune``."""
        rows = [(t, k, s) for t, own in sorted(self.reports.items()) for k, s in sorted(own.items())]
        return self.spark.createDataFrame(rows, "trial long, step long, score double")

    def info(self) -> dict:
        """Numbers of trials by state, and the best one; also kept as ``info.json``."""
        trials = self.trials()
        good = [t for t in trials if t.state == "complete" and t.score > LOWEST]
        best = max(good, key=lambda t: (t.score, -t.trial), default=None)
        out = {"family": self.family, "metric": self.metric, "states": {s: sum(t.state == s for t in trials) for s in STATES}, "written": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        out["best"] = {"trial": best.trial, "score": best.score, "params": best.params} if best else None
        self.store.write_text(f"{self.store.root}/info.json", json.dumps(out, sort_keys=True, indent=1))
        return out


def _flat(found) -> dict:
    """A nested metrics dict with paths as names; anything else as it is."""
    if not isinstance(found, dict):
        return found
    out: dict = {}
    for k, v in found.items():
        if isinstance(v, dict):
            out |= {f"{k}/{m}": x for m, x in _flat(v).items()}
        else:
            out[k] = v
    return out


def optimize(spark: SparkSession, path: str, family: str, counts: DataFrame, genes: DataFrame, cells: DataFrame, n_trials: int, metric: str = "harmonic_avg/AUROC", space: list[Param] | None = None, resume: bool = False, parallel: int = 1, sampler: Sampler | None = None) -> dict:
    """A search over what this library trains from a family's space; each trial keeps its split and states in its
    folder, so that a trial that broke off goes on.  Returns and keeps the study's info."""
    from tessera.plans import inference

    from . import sgd, spaces

    if family not in spaces.TRAINABLE:
        raise ValueError(f"{family} has no searched trainer; known: {sorted(spaces.TRAINABLE)}")
    study = Study(spark, path, family, space or spaces.TRAINABLE[family], metric, sampler, resume)

    def objective(run: Run) -> dict:
        params, use_log = spaces.trainer_params(family, run.params)
        if isinstance(params, sgd.SgdParams):
            from dataclasses import replace

            params = replace(params, metric=metric)
        return inference.train(spark, family, counts, genes, cells, params, use_log=use_log, path=run.folder, report=run.report)[1]

    study.run(objective, n_trials, parallel)
    return study.info()
