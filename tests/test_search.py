"""Spaces with conditions, the Parzen sampler against a plain one, and searches that prune and go on."""

import math
import random
import statistics
import threading
import time

import pytest

from tessera.models import parzen, spaces, study
from tessera.operators import training
from tessera.sources.store import ChangedInput


@pytest.mark.parametrize("family", sorted(spaces.SPACES))
def test_only_combinations_are_drawn(family):
    space = spaces.SPACES[family]
    for seed in range(60):
        rng = random.Random(seed)
        params = spaces.drawn(space, lambda p: parzen.uniform(p, rng))
        assert spaces.validate(space, params) is params
        kind = params.get("lr_scheduler_type")
        assert ("lr_gamma" in params) == (kind == "StepLR") and ("lr_factor" in params) == (kind == "ReduceLROnPlateau") and ("lr_t_max" in params) == (kind == "CosineAnnealingLR")
        assert ("ridge_lambda" in params) == (params.get("loss_type") == "zinb") and ("l1_ratio" in params) == (params.get("penalty") == "elasticnet")
        assert ("soft_loss_start_epoch" in params) == bool(params.get("use_soft_loss"))
        if family == "mlp":
            assert [f"layer_{k}_units" in params for k in range(5)] == [k < params["num_layers"] for k in range(5)]
        wrong = dict(params)
        wrong[next(iter(params))] = "nope"
        for bad in (wrong, params | {"unknown": 1}, {k: v for k, v in params.items() if k != next(iter(params))}):
            with pytest.raises(ValueError):
                spaces.validate(space, bad)


def test_impossible_combinations_are_refused():
    rng = random.Random(0)
    params = spaces.drawn(spaces.LINEAR, lambda p: "l2" if p.name == "penalty" else parzen.uniform(p, rng))
    with pytest.raises(ValueError, match="l1_ratio"):
        spaces.validate(spaces.LINEAR, params | {"l1_ratio": 0.5})
    with pytest.raises(ValueError, match="range"):
        spaces.validate(spaces.LINEAR, params | {"alpha": 1.0})
    with pytest.raises(ValueError, match="narrowed"):
        spaces.restricted(spaces.LINEAR, penalty=("l3",))
    made, use_log = spaces.trainer_params("svm", params | {"learning_rate": "constant"})
    assert made.loss == "hinge" and made.n_epochs == 30 and use_log == params["use_log_transform"]


def plain_suggestion(p, seed, trial, finished, startup=10, candidates=24):
    """The estimator written out for one parameter without conditions."""
    rng = random.Random(f"{seed}/{trial}/{p.name}")
    order = sorted(range(len(finished)), key=lambda k: (-finished[k][2], finished[k][0]))
    seen = [finished[k][1][p.name] for k in order]
    if len(seen) < startup:
        return parzen.uniform(p, rng)
    n = min(25, max(1, math.ceil(0.1 * len(seen))))
    if p.kind == "choice":
        weight = [[1 / len(p.choices) + part.count(c) for c in p.choices] for part in (seen[:n], seen[n:])]
        asked = rng.choices(range(len(p.choices)), weights=[w / (1 + n) for w in weight[0]], k=candidates)
        ratio = lambda k: weight[0][k] / (1 + n) / (weight[1][k] / (1 + len(seen) - n))
        return p.choices[sorted(set(asked), key=lambda k: (-ratio(k), k))[0]]
    f, g = (math.log, math.exp) if p.kind == "log" else (float, float)
    lo, hi = f(p.low) - (p.kind == "int") / 2, f(p.high) + (p.kind == "int") / 2
    cdf = statistics.NormalDist().cdf

    def mixture(values):
        values = sorted(map(f, values))
        out = []
        for k, v in enumerate(values):
            left = v - (values[k - 1] if k else lo)
            right = (values[k + 1] if k + 1 < len(values) else hi) - v
            out.append((v, min(hi - lo, max((hi - lo) / min(100, len(values) + 1), left, right))))
        return out + [((lo + hi) / 2, hi - lo)]

    def value(x, parts):
        return sum(statistics.NormalDist(c, w).pdf(x) / (cdf((hi - c) / w) - cdf((lo - c) / w)) for c, w in parts) / len(parts)

    up, down = mixture(seen[:n]), mixture(seen[n:])
    drawn = []
    for _ in range(candidates):
        c, w = up[rng.randrange(len(up))]
        while True:
            x = rng.gauss(c, w)
            if lo <= x <= hi:
                break
        drawn.append((value(x, up) / value(x, down), x))
    x = max(drawn, key=lambda t: t[0])[1]
    return int(min(p.high, max(p.low, math.floor(x + 0.5)))) if p.kind == "int" else min(p.high, max(p.low, g(x)))


FLAT = [spaces.real("a", -2, 3), spaces.log("b", 1e-4, 10), spaces.integer("c", 1, 9), spaces.choice("d", "x", "y", True)]


def height(v):
    return -((v["a"] - 1) ** 2) - (math.log10(v["b"]) + 1) ** 2 - abs(v["c"] - 4) / 4 - (v["d"] != "y")


def test_draws_equal_plain_ones():
    done = []
    for trial in range(40):
        got = parzen.Sampler(seed=4).suggest(FLAT, trial, done)
        want = {p.name: plain_suggestion(p, 4, trial, done) for p in FLAT}
        assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k], rel=1e-9) if isinstance(want[k], float) else want[k]) for k in got)
        done.append((trial, got, height(got)))


def test_it_beats_random_sampling():
    def best(seed, startup):
        done = []
        for trial in range(100):
            v = parzen.Sampler(seed=seed, startup=startup).suggest(FLAT, trial, done)
            done.append((trial, v, height(v)))
        return max(s for *_, s in done)

    pairs = [(best(seed, 10), best(seed, 10**9)) for seed in range(20)]
    assert statistics.mean(a for a, _ in pairs) > statistics.mean(b for _, b in pairs) + 0.1
    assert sum(a > b for a, b in pairs) >= 15


def test_pruning_rule_is_that_of_the_query(spark):
    rng = random.Random(2)
    reports = {t: {k: rng.random() + t / 20 for k in range(rng.randrange(4, 9))} for t in range(12)}
    rows = [(t, k, s) for t, own in reports.items() for k, s in own.items()]
    found = training.percentile_prune(spark.createDataFrame(rows, "trial long, step long, score double")).collect()
    assert any(r["prune"] for r in found) and not all(r["prune"] for r in found)
    for r in found:
        assert r["prune"] == study.behind(reports, r["trial"], r["step"]), r


def test_a_bad_trial_s_jobs_stop_early_and_nothing_is_repeated(spark, tmp_path):
    ran = []

    def objective(run):
        ran.append((run.trial, run.resumed))
        for step in range(8):
            run.report(step, -1.0 if run.trial == 6 else 10.0)
        if run.trial == 7:
            raise RuntimeError("no")
        return {"AUROC": run.params["a"]}

    s = study.Study(spark, str(tmp_path / "s"), "x", FLAT, "AUROC")
    trials = s.run(objective, 9)
    assert [t.state for t in trials] == ["complete"] * 6 + ["pruned", "fail", "complete"]
    assert set(s.reports[6]) == set(range(6)) and trials[7].score == float("-inf")  # stopped at step 5
    info = s.info()
    assert info["states"] == {"running": 0, "complete": 7, "pruned": 1, "fail": 1} and info["best"]["score"] == max(t.score for t in trials if t.state == "complete")
    again = study.Study(spark, str(tmp_path / "s"), "x", FLAT, "AUROC", resume=True)
    assert again.run(objective, 10)[:9] == trials and [n for n, _ in ran] == list(range(10))
    assert again.report_table().count() == sum(map(len, again.reports.values()))
    with pytest.raises(ChangedInput):
        study.Study(spark, str(tmp_path / "s"), "x", FLAT, "AUROC")
    with pytest.raises(ChangedInput):
        study.Study(spark, str(tmp_path / "s"), "x", FLAT, "F1", resume=True)


def test_running_jobs_of_a_stopped_trial_are_cancelled(spark, tmp_path):
    s = study.Study(spark, str(tmp_path / "s"), "x", FLAT, "AUROC")
    slow = lambda rows: (time.sleep(60) or r for r in rows)

    def objective(run):
        threading.Timer(3, s.stop, [run.trial]).start()
        return {"AUROC": float(spark.sparkContext.parallelize([1.0], 1).mapPartitions(slow).sum())}

    begin = time.time()
    assert [t.state for t in s.run(objective, 1)] == ["pruned"] and time.time() - begin < 40
    assert spark.range(5).count() == 5  # other jobs go on


def test_trials_that_broke_off_go_on_with_their_parameters(spark, tmp_path):
    s = study.Study(spark, str(tmp_path / "s"), "x", FLAT, "AUROC")

    def dies(run):
        if run.trial == 1:
            s.store.write_text(f"{run.folder}/state", "half")
            run.report(0, 0.5)
            raise KeyboardInterrupt
        return {"AUROC": 1.0}

    with pytest.raises(KeyboardInterrupt):
        s.run(dies, 3)
    s._keep(study.Trial(2, {"a": 0.0}, "running"))  # left nothing behind: it is forgotten
    params = {t.trial: t.params for t in s.trials()}
    seen = []
    again = study.Study(spark, str(tmp_path / "s"), "x", FLAT, "AUROC", resume=True)
    trials = again.run(lambda run: seen.append((run.trial, run.resumed)) or run.report(0, 0.9) or {"AUROC": 0.7}, 3)
    assert seen == [(1, True), (2, False)] and trials[1].params == params[1] and [t.state for t in trials] == ["complete"] * 3
    assert again.reports[1][0] == 0.5  # a step reported twice keeps its first score
