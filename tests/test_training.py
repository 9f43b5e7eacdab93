"""Versions, preparation, mini-batch descent, leaf-wise trees, evaluation: against plain Python."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text
from tessera.models import sgd, trees
from tessera.operators import batching
from tessera.plans import evaluation, inference, prepare
from tessera.sources import artifacts, tables
from tessera.sources.store import ChangedInput, Store, fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    """Written once, so that tests don't make them again."""
    make = {"counts": tables.counts(spark, SF), "genes": tables.genes(spark, SF), "cells": tables.cells(spark, SF)}
    out = {k: artifacts.written(v, k) for k, v in make.items()}
    out["cells"] = artifacts.written(out["cells"].withColumn("y", N.hard_label(F.col("expansion"))), "cells")
    out["schema"] = inference.fit_schema(out["counts"], out["genes"], out["cells"])
    return out


def dense(data):
    """(cells in order, z by cell and gene, x by cell and gene) as arrays."""
    ids = sorted(r["cell_id"] for r in data["cells"].select("cell_id").collect())
    at = {c: k for k, c in enumerate(ids)}
    stats = sorted(data["schema"].stats.collect(), key=lambda r: r["gene_idx"])
    gene = {r["gene_id"]: r["gene_idx"] for r in stats}
    x = np.zeros((len(ids), len(gene)))
    for r in data["counts"].collect():
        x[at[r["cell_id"]], gene[r["gene_id"]]] = r["value"]
    total = x.sum(axis=1, keepdims=True)
    x = np.log1p(x * np.where(total > 0, 1e4 / np.where(total > 0, total, 1), 1))
    mu, sd = (np.array([r[c] for r in stats]) for c in ("mu", "sigma"))
    return ids, np.clip((x - mu) / (sd + 1e-10), -6, 6), x


def test_versions_are_whole_or_absent(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = store.commit("m", {"t": spark.range(3)}, "a", score=0.5, epoch=0)
    two = store.commit("m", {"t": spark.range(4)}, "a", score=0.7, epoch=1)
    store.commit("m", {"t": spark.range(5)}, "a", score=0.7, epoch=2)
    os.makedirs(tmp_path / "m" / ".writing-lost" / "t")
    os.makedirs(tmp_path / "m" / "v000009" / "t")  # a version without manifest
    assert [v.number for v in store.versions("m")] == [1, 2, 3] and store.last("m").manifest["epoch"] == 2
    assert store.best("m").number == two.number and store.table(one, "t").count() == 3
    assert store.commit("m", {"t": spark.range(1)}, "a").number == 10
    store.prune("m")
    assert sorted(os.listdir(tmp_path / "m")) == ["v000002", "v000010"]
    with pytest.raises(ChangedInput):
        store.resume("m", "b")
    with pytest.raises(ValueError, match="no table"):
        store.table(two, "x")
    assert store.resume("none", "a") is None and store.last("none") is None


def test_fingerprints_follow_content_and_switches(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string")
    same = rows.repartition(3).orderBy(F.col("k").desc())
    assert fingerprint([rows], a=1) == fingerprint([same], a=1) != fingerprint([rows], a=2)
    assert fingerprint([rows]) != fingerprint([rows.distinct()]) != fingerprint([rows.limit(0)])


def test_prepare_resumes_and_refuses(spark, data, tmp_path, monkeypatch):
    args = spark, str(tmp_path), data["counts"], data["genes"], data["cells"]
    whole = Store.write_text
    monkeypatch.setattr(Store, "write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):  # after the tables, before the manifest
        prepare.prepare(*args)
    monkeypatch.setattr(Store, "write_text", whole)
    one = prepare.prepare(*args)
    two = prepare.prepare(*args)
    assert not one.resumed and two.resumed
    split = lambda p: {(r["cell_id"], r["split"]) for r in p.cells.select("cell_id", "split").collect()}
    table = lambda df: sorted(map(str, df.collect()))
    assert split(one) == split(two) and table(one.schema.stats) == table(two.schema.stats) and table(one.schema.codes) == table(two.schema.codes)
    assert one.schema.codes.count() > 3
    with pytest.raises(ChangedInput):
        prepare.prepare(*args[:2], data["counts"].where("value > 20"), *args[3:])
    with pytest.raises(ChangedInput):
        prepare.prepare(*args, seed=2)
    with pytest.raises(ValueError, match="dev_ratio"):
        prepare.prepare(*args, dev_ratio=1.5)
    prepare.patient_lists(spark, str(tmp_path), str(tmp_path / "lists"))
    lists = [{r[0] for r in spark.read.csv(str(tmp_path / "lists" / f"{s}_patients"), header=True).collect()} for s in ("train", "dev")]
    assert lists[0] and lists[1] and not lists[0] & lists[1]


@pytest.mark.parametrize("loss,penalty", [("log", "l2"), ("hinge", "elasticnet")])
def test_a_step_equals_the_dense_one(spark, data, loss, penalty):
    ids, z, _ = dense(data)
    p = sgd.SgdParams(loss=loss, penalty=penalty, alpha=0.05, eta0=0.3, learning_rate="constant")
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=z.shape[1]) / 5, 0.1
    rows = sgd.training_rows(data["cells"], sgd.sparse_rows(data["counts"], data["cells"], data["schema"].stats), p)
    start = sgd.initial(data["schema"].stats).join(spark.createDataFrame([(-1, b), *enumerate(map(float, w))], "gene_idx int, v double"), "gene_idx").select("gene_idx", "z0", F.col("v").alias("w"))
    got = {r["gene_idx"]: r["w"] for r in sgd.stepped(rows, start, p, 0).collect()}
    y = {r["cell_id"]: r["y"] for r in data["cells"].collect()}
    y = np.array([y[i] for i in ids], float)
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    s = z @ w + b
    t = 2 * y - 1
    r = weight * (1 / (1 + np.exp(-s)) - y if loss == "log" else np.where(t * s < 1, -t, 0))
    lasso = p.lasso
    moved = w * (1 - 0.3 * 0.05 * (1 - lasso)) - 0.3 * (z.T @ r) / len(y)
    want = np.sign(moved) * np.maximum(np.abs(moved) - 0.3 * 0.05 * lasso, 0)
    assert [got[k] for k in range(len(w))] == pytest.approx(list(want), abs=1e-9) and got[-1] == pytest.approx(b - 0.3 * r.mean(), abs=1e-9)
    p = {r["cell_id"]: r["p"] for r in sgd.predictions(rows, start).collect()}
    assert [p[i] for i in ids] == pytest.approx(list(1 / (1 + np.exp(-s))), abs=1e-9)


def test_a_broken_off_run_goes_on_as_an_unbroken_one(spark, data, tmp_path):
    learn, dev = data["cells"].where("cell_id % 3 > 0"), data["cells"].where("cell_id % 3 = 0")
    params = sgd.SgdParams(batch_size=800, n_epochs=3, patience=2, metric="AUROC")
    args = spark, data["counts"], learn, dev, data["schema"], params
    whole = sgd.fit(*args, str(tmp_path / "a"), "x")

    def stop(epoch, score):
        if epoch == 0:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sgd.fit(*args, str(tmp_path / "b"), "x", report=stop)
    again = sgd.fit(*args, str(tmp_path / "b"), "x")
    table = lambda f: {r["gene_idx"]: r["w"] for r in f.weights.collect()}
    assert table(again) == pytest.approx(table(whole), abs=1e-12) and len(whole.history) == 3
    assert [e for e, _ in again.history] == [0, 1, 2] and [s for _, s in again.history] == pytest.approx([s for _, s in whole.history])
    assert whole.best_score == max(s for _, s in whole.history) and whole.best_epoch == [s for _, s in whole.history].index(whole.best_score)
    with pytest.raises(ChangedInput):
        sgd.fit(*args, str(tmp_path / "b"), "other input")


def test_patience_counts_from_the_first_of_the_best():
    assert [sgd._waited(list(enumerate(s))) for s in ([], [1], [1, 2], [2, 1, 2], [3, 1, 1, 1])] == [0, 0, 0, 2, 3]
    assert sgd.metric_of({"AUROC": 0.5, "harmonic_avg": {"AUROC": float("nan")}}, "harmonic_avg/AUROC") == float("-inf")
    assert sgd.metric_of({"harmonic_avg": {"AUROC": 0.3}}, "harmonic_avg/AUROC") == 0.3 and sgd.metric_of({}, "a/b") == float("-inf")
    rates = [sgd.SgdParams(learning_rate=k, eta0=0.4).rate(3) for k in ("constant", "invscaling", "optimal")]
    assert rates[:2] == [0.4, 0.2] and 0 < rates[2]
    for bad in ({"loss": "x"}, {"penalty": "x"}, {"learning_rate": "x"}, {"patience": 0}):
        with pytest.raises(ValueError):
            sgd.SgdParams(**bad)
    with pytest.raises(ValueError, match="sampler"):
        batching.train_batches("nope", None, 1)


def plain_tree(x, b, g, h, p):
    """Best-first growth, one split at a time, every histogram counted: [(gene, low)] in the order taken, and the outputs."""
    soft = lambda v: max(0.0, abs(v) - p.reg_alpha)
    part = lambda i: soft(g[i].sum()) ** 2 / (h[i].sum() + p.reg_lambda + 1e-12)

    def best(i):
        found = None
        for gene in range(x.shape[1]):
            for k in sorted(set(b[i, gene]) - {0}):
                right = i[b[i, gene] >= k]
                left = i[b[i, gene] < k]
                if min(len(left), len(right)) < p.min_child_samples or min(h[left].sum(), h[right].sum()) < p.min_child_weight:
                    continue
                gain = part(left) + part(right) - part(i)
                if gain > p.min_split_gain + 1e-9 and (found is None or round(gain, 9) > round(found[0], 9)):
                    found = (gain, gene, k, left, right)
        return found

    leaves, taken = [(np.arange(len(x)), 0)], []
    while len(leaves) < p.num_leaves:
        options = [(best(i), n) for n, (i, d) in enumerate(leaves) if p.max_depth < 1 or d < p.max_depth]
        options = [(o, n) for o, n in options if o]
        if not options:
            break
        (gain, gene, k, left, right), n = max(options, key=lambda o: round(o[0][0], 9))
        d = leaves.pop(n)[1]
        leaves += [(left, d + 1), (right, d + 1)]
        taken.append((gene, x[b[:, gene] == k, gene].min()))
    out = np.zeros(len(x))
    for i, _ in leaves:
        out[i] = -p.learning_rate * math.copysign(soft(g[i].sum()), g[i].sum()) / (h[i].sum() + p.reg_lambda + 1e-12)
    return taken, out


@pytest.mark.parametrize("extra", [{}, {"max_depth": 2, "reg_alpha": 0.5, "num_leaves": 9}])
def test_trees_equal_plain_ones(spark, data, extra):
    p = trees.LeafwiseParams(**({"num_leaves": 6, "n_estimators": 2, "max_bin": 12, "reg_lambda": 0.5} | extra))
    ids, _, x = dense(data)
    model = trees.fit(spark, data["counts"], data["cells"], data["genes"], p)
    b = np.zeros(x.shape, int)
    for gene in range(x.shape[1]):
        own = np.sort(x[x[:, gene] > 0, gene])
        below = np.searchsorted(own, x[:, gene], "left")
        b[:, gene] = np.where(x[:, gene] > 0, below * (p.max_bin - 1) // len(own) + 1, 0)
    y = {r["cell_id"]: r["y"] for r in data["cells"].collect()}
    y = np.array([y[i] for i in ids], float)
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    score = np.full(len(y), model.base)
    rows = model.nodes.collect()
    for tree in range(2):
        q = 1 / (1 + np.exp(-score))
        taken, out = plain_tree(x, b, weight * (q - y), weight * q * (1 - q), p)
        got = sorted((r["gene_idx"], r["low"]) for r in rows if r["tree"] == tree and r["gene_idx"] >= 0)
        assert taken and np.array(got) == pytest.approx(np.array(sorted(taken)))
        score = score + out
    found = {r["cell_id"]: r["score"] for r in trees.predict(spark, model, data["counts"], data["cells"], data["genes"]).collect()}
    assert [found[i] for i in ids] == pytest.approx(list(score), abs=1e-9)


def separable(spark):
    """Cells whose label follows two genes, with some noise."""
    rng = np.random.default_rng(5)
    cells, counts = [], []
    for i in range(600):
        v = rng.poisson(3, 6)
        y = int((v[0] > 3) ^ (v[1] > 3)) if rng.random() > 0.05 else int(rng.random() < 0.5)
        cells.append((i, y, "expanded" if y else "no", f"p{i % 40}", "s", "c", "t", "l"))
        counts += [(i, g, float(n)) for g, n in enumerate(v) if n]
    return (
        spark.createDataFrame(counts, "cell_id long, gene_id long, value double"),
        spark.createDataFrame(cells, "cell_id long, y int, expansion string, patient string, study string, cancer_type string, tissue_type string, imputed_labels string"),
        spark.createDataFrame([(g, f"g{g}", g) for g in range(6)], "gene_id long, gene_name string, gene_idx long"),
    )


def test_trees_learn_what_linear_models_cannot(spark, tmp_path):
    counts, cells, genes = (artifacts.written(t, "separable") for t in separable(spark))
    p = trees.LeafwiseParams(num_leaves=8, n_estimators=5, learning_rate=0.4, max_bin=16, feature_fraction=0.9)
    trained, dev = inference.train(spark, "gbt", counts, genes, cells.drop("y"), p)
    assert dev["AUROC"] > 0.85  # on other patients; a single gene says nothing
    inference.save(trained, str(tmp_path / "m"))
    back = inference.load(spark, str(tmp_path / "m"))
    few = cells.where("cell_id < 50")
    assert sorted(inference.scores(spark, back, counts, few).collect()) == sorted(inference.scores(spark, trained, counts, few).collect())
    with pytest.raises(ValueError, match="boosting"):
        trees.LeafwiseParams(boosting="dart")


def test_one_sided_samples_keep_large_gradients_and_sums(spark):
    rows = spark.range(20_000).select(F.col("id").alias("cell_id"), ((F.pmod(F.xxhash64("id"), F.lit(2001)) - 1000) / 1000.0).alias("g"), F.lit(0.25).alias("h"), F.array().cast("array<struct<i:int,b:int>>").alias("e"))
    p = trees.LeafwiseParams(boosting="goss", top_rate=0.3, other_rate=0.2)
    got = trees._sampled(rows, p, 0)
    large = rows.where("abs(g) > 0.71")
    assert large.join(got, "cell_id", "left_anti").count() == 0
    n, h, size = got.agg(F.count("*"), F.sum("h"), F.sum(F.abs("g"))).first()
    assert n == pytest.approx(10_000, rel=0.05) and h == pytest.approx(5000, rel=0.05) and size == pytest.approx(rows.agg(F.sum(F.abs("g"))).first()[0], rel=0.05)
    half = trees._sampled(rows, trees.LeafwiseParams(bagging_fraction=0.5), 3)
    assert half.count() == pytest.approx(10_000, rel=0.05) and half.exceptAll(trees._sampled(rows.repartition(3), trees.LeafwiseParams(bagging_fraction=0.5), 3)).count() == 0


def test_vectors_are_dense_z_scores(spark, data):
    ids, z, _ = dense(data)
    got = {r["cell_id"]: r["x"] for r in inference.vectors(data["counts"], data["cells"], data["schema"]).collect()}
    assert np.allclose([got[i] for i in ids], z, atol=1e-9)


def test_evaluate_and_save_in_one_pass(spark, data, tmp_path):
    """Files, report and lists from one call; the plan behind the predictions runs once."""
    ran = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda v: (ran.add(1), v)[1], "double")
    p = data["cells"].select("cell_id", mark(F.pmod(F.xxhash64("cell_id"), F.lit(1000)) / 1000.0).alias("p"))
    rows = data["cells"].drop("y")
    out = evaluation.evaluate_and_save(spark, p, rows, str(tmp_path), "logistic", "dev")
    assert ran.value == rows.count() == out.seen["n"] and out.seen["bad"] == 0 and out.seen["positives"] > 0
    assert 0 <= out.seen["least"] <= out.seen["most"] < 1 and 0 < out.metrics["AUROC"] < 1 and "harmonic_avg" in out.metrics
    for name in ("logistic_predictions", "results_table_dev", "roc_curve_dev"):
        assert spark.read.csv(str(tmp_path / name), header=True).count() > 10
    said = (tmp_path / "results_dev.txt").read_text()
    assert said.startswith("Results (dev)\n=====") and f"AUROC           {out.metrics['AUROC']:.4f}" in said
    assert evaluation.evaluate_and_save(spark, p, rows.drop("expansion"), str(tmp_path / "b"), "svm").metrics == {}
    with pytest.raises(ValueError, match="have no prediction"):
        evaluation.evaluate_and_save(spark, p.where("cell_id > 5"), rows, str(tmp_path / "c"), "svm")
    with pytest.raises(ValueError, match="no predictions"):
        evaluation.evaluate_and_save(spark, p, rows.limit(0), str(tmp_path / "d"), "svm")


def test_numbers_as_text():
    assert [text.number(v) for v in (3, 0.5, 0.0, 5e-5, -1.25e-4, 123456.0, float("nan"))] == ["3", "0.5000", "0.0000", "5e-5", "-1.25e-4", "123456.0000", "nan"]
    assert text.numbers({"a": [0.5, (1, "x")], "b": {"c": 2.0}}) == {"a": ["0.50000", (1, "x")], "b": {"c": "2.00000"}}
    assert text.report({}, "T") == "T: no metrics" and text.one_line({"b": {"a": 0.5}, "c": 2}) == "b/a: 0.5000, c: 2"
    assert "s1  0.2500  nan" in text.report({"s1": {"a": 0.25}, "s2": {"b": 1.0}})


def test_rows_never_carry_the_weights(spark):
    """Scores by hand, genes beyond the weights and cells without counts included; no row is joined with an array of all genes."""
    weights = spark.createDataFrame([(-1, 0.0, 0.5), (0, -0.5, 2.0), (1, 0.25, -1.0)], "gene_idx int, z0 double, w double")
    rows = spark.createDataFrame([(1, [(0, 1.5), (1, 2.0)]), (2, []), (3, [(1, 1.0), (9, 7.0)])], "cell_id long, e array<struct<i:int,d:double>>")
    found = sgd.scored(rows, weights)
    base = 0.5 + 2.0 * -0.5 + -1.0 * 0.25
    assert {r["cell_id"]: r["score"] for r in found.collect()} == pytest.approx({1: base + 3.0 - 2.0, 2: base, 3: base - 1.0})
    assert found.columns == ["cell_id", "e", "score"] and "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
