"""Networks, search, artifacts, façade and stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.models import estimators, network, search, sgd
from tessera.operators import matrix as M
from tessera.operators import metrics
from tessera.operators import scoring as S
from tessera.plans import inference
from tessera.sources import artifacts, tables
from tessera.streaming import scorer

SF = "/root/testdata/sf0.001"


def numeric_gradient(f, w, name, at, eps=1e-6):
    up, down = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
    up[name][at] += eps
    down[name][at] -= eps
    return (f(up) - f(down)) / (2 * eps)


def test_mlp_gradient():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 6)), np.array([0, 1, 1, 0, 1.0])
    w = network.Dense.init(6, (4, 3), 1).weights
    _, g = network.gradient(w, x, y, 2.0)
    for name, at in (("w0", (1, 2)), ("b0", (1,)), ("w1", (0, 1)), ("w2", (2, 0)), ("b2", (0,))):
        assert g[name][at] == pytest.approx(numeric_gradient(lambda a: network.gradient(a, x, y, 2.0)[0], w, name, at), rel=1e-4, abs=1e-7)


def test_autoencoder_gradient():
    rng = np.random.default_rng(0)
    p = network.AeParams(hidden=(4,), latent=2)
    x, y = rng.normal(size=(5, 6)), np.array([0, 1, 1, 0, 1.0])
    w = network.ae_init(6, p)
    _, g = network.ae_gradient(w, x, y, p)
    for name, at in (("we0", (1, 2)), ("wd1", (0, 1)), ("wc", (1, 0)), ("be1", (0,)), ("bd0", (2,))):
        assert g[name][at] == pytest.approx(numeric_gradient(lambda a: network.ae_gradient(a, x, y, p)[0], w, name, at), rel=1e-4, abs=1e-7)


def test_mlp_gradient_with_heads_and_soft_labels():
    rng = np.random.default_rng(0)
    x, y, aux = rng.normal(size=(5, 6)), np.array([0, 0.3, 1, 0.9, 0.5]), {"tissue": np.array([0, 2, -1, 1, 2])}
    w = network.Dense.init(6, (4, 3), 1).with_heads((("tissue", 3),), 1).weights
    f = lambda a: network.gradient(a, x, y, 2.0, aux, 0.5)[0]
    _, g = network.gradient(w, x, y, 2.0, aux, 0.5)
    for name, at in (("w0", (1, 2)), ("wa:tissue", (1, 2)), ("ba:tissue", (0,)), ("w1", (0, 1))):
        assert g[name][at] == pytest.approx(numeric_gradient(f, w, name, at), rel=1e-4, abs=1e-7)


@pytest.mark.parametrize("loss", ["nb", "zinb"])
def test_count_loss_gradient(loss):
    rng = np.random.default_rng(0)
    p = network.AeParams(hidden=(4,), latent=2, loss=loss)
    x, y, t = rng.normal(size=(5, 6)), np.array([0, 1, 1, 0, 1.0]), rng.poisson(1.0, (5, 6)).astype(float)
    w = network.ae_init(6, p)
    f = lambda a: network.ae_gradient(a, x, y, p, t)[0]
    _, g = network.ae_gradient(w, x, y, p, t)
    for name, at in (("we0", (1, 2)), ("wd1", (0, 1)), ("btheta", (3,)), *((("bpi", (2,)),) if loss == "zinb" else ()), ("bd1", (4,))):
        assert g[name][at] == pytest.approx(numeric_gradient(f, w, name, at), rel=1e-3, abs=1e-6)


def test_training_variants(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0, 0.5], i % 2, 0.9 * (i % 2), i % 3, [float(i % 2), 2.0, 0.0]) for i in range(30)], "cell_id long, x array<double>, y int, y_soft double, k_code long, t array<double>")
    w, log = network.train_mlp(spark, rows, network.MlpParams(layers=(4,), epochs=4, aux=(("k", 3),), soft_start=2, optimizer="sgd", lr=1e-3))
    assert len(log) == 4 and "wa:k" in w
    _, log = network.train_ae(spark, rows, network.AeParams(hidden=(4,), latent=2, loss="zinb", epochs=6))
    assert log[-1] < log[0]
    with pytest.raises(ValueError, match="unknown loss"):
        network.ae_init(3, network.AeParams(loss="nope"))
    with pytest.raises(ValueError, match="unknown optimizer"):
        network.Optimizer(0.1, "nope")


def test_mlp_learns(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2, 0.5], i % 2) for i in range(40)], "cell_id long, x array<double>, y int")
    w, log = network.train_mlp(spark, rows, network.MlpParams(layers=(8,), epochs=25, lr=0.05))
    assert log[-1] < log[0] / 2
    p = {r["cell_id"]: r["p"] for r in network.predict(spark, rows, w).collect()}
    assert p[1] > 0.5 > p[0]


def test_search(spark):
    seen = []

    def objective(p):
        seen.append(p)
        if p["alpha"] > 1e-2:
            raise RuntimeError("no")
        return {"AUROC": -p["alpha"]}

    trials = search.run("logistic", objective, 8)
    assert search.best(trials).score == max(t.score for t in trials)
    again = search.run("logistic", objective, 8, done=search.from_table(search.as_table(spark, trials)))
    assert [t.params for t in again] == [t.params for t in trials]
    assert {r["state"] for r in search.summary(spark, trials).collect()} <= {"complete", "fail"}
    with pytest.raises(ValueError):
        search.run("nope", objective, 1)
    with pytest.raises(ValueError):
        inference.require_metric("AUPRC")


def test_artifacts(spark, tmp_path):
    path = tmp_path / "rows.txt"
    path.write_text("3\n\n 5 \n")
    assert sorted(r["cell_id"] for r in artifacts.selector(spark, str(path)).collect()) == [3, 5]
    path.write_text("")
    assert artifacts.selector(spark, str(path)).count() == 0
    artifacts.save_params(network.MlpParams(), str(tmp_path / "parameters.json"))
    assert artifacts.load_params(network.MlpParams, str(tmp_path), epochs=3).epochs == 3
    with pytest.raises(ValueError, match="unknown"):
        artifacts.load_params(network.MlpParams, str(tmp_path), nope=1)
    (tmp_path / "model_type.txt").write_text(' "MLP"\n')
    assert artifacts.read_model_type(str(tmp_path)) == "mlp"
    assert artifacts.versioned(str(tmp_path)).endswith("_v_1")
    with pytest.raises(FileNotFoundError):
        artifacts.read_model_type(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        artifacts.check_predictions(spark.range(1), spark.createDataFrame([(0, 1.5)], "cell_id long, p double"))


def test_train_save_load_and_infer(spark, tmp_path):
    counts, cells, genes = tables.counts(spark, SF), tables.cells(spark, SF), tables.genes(spark, SF)
    trained, dev = inference.train(spark, "logistic", counts, genes, cells)
    assert 0 <= dev["AUROC"] <= 1 and "average" in dev
    inference.save(trained, str(tmp_path / "m"))
    back = inference.load(spark, str(tmp_path / "m"))
    some = cells.where("cell_id < 80").drop("expansion")  # a limit gives other rows to another plan
    a = {r["cell_id"]: r["p"] for r in inference.run_inference(spark, trained, counts, some).predictions.collect()}
    found = inference.run_inference(spark, back, counts, some)
    assert not found.has_metrics and {r["cell_id"]: r["p"] for r in found.predictions.collect()} == pytest.approx(a)
    with pytest.raises(ValueError, match="unknown model type"):
        inference.train(spark, "nope", counts, genes, cells)


def test_stream_scores_like_batch(spark, tmp_path):
    counts, genes = tables.counts(spark, SF), tables.genes(spark, SF)
    orders = tables.read(spark, SF, "orders").select(F.col("o_orderkey").alias("cell_id"))
    stats = M.fit_stats(counts, genes, orders, log=True)
    w = genes.select("gene_id", (F.col("gene_idx") / 10).alias("w"))
    whole = counts.groupBy("cell_id").agg(F.collect_list(F.struct("gene_id", "value")).alias("entries"))
    whole.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={n}"))
    scorer.start(stream, stats.join(w, "gene_id"), sink, str(tmp_path / "ck")).awaitTermination()
    got = {r["cell_id"]: r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["cell_id"]: r["score"] for r in S.linear_sparse(counts, orders.join(counts, "cell_id", "left_semi"), stats, w).collect()}
    assert got == pytest.approx(want)


def test_linear_families_never_need_dense_rows(spark):
    """Trained on sparse differences and scored from non-zeros: as Spark ML on dense z-scores."""
    counts, cells, genes = (f(spark, SF) for f in (tables.counts, tables.cells, tables.genes))
    few = cells.where("cell_id % 8 < 2").withColumn("y", N.hard_label(F.col("expansion")))
    schema = inference.fit_schema(counts, genes, few)
    x = artifacts.written(inference.vectors(counts, few, schema).join(few.select("cell_id", "y"), "cell_id"), "rows")
    rows = artifacts.written(sgd.training_rows(few, sgd.sparse_rows(counts, few, schema.stats), sgd.SgdParams()), "rows")
    for kind in inference.LINEAR:
        p = estimators.LinearParams(max_epochs=50, alpha=0.1)
        model = estimators.fit(kind, estimators.features(estimators.weighted(x)), p)
        own = estimators.fit_sparse(kind, rows, sgd.initial(schema.stats), p)
        got = {r["cell_id"]: r["p"] for r in inference.linear_scores(spark, inference.Trained(kind, schema, own), counts, few).collect()}
        want = {r["cell_id"]: r["p"] for r in estimators.predict(kind, model, estimators.features(x)).collect()}
        assert len(got) > 100 and got.keys() == want.keys() and list(got.values()) == pytest.approx([want[k] for k in got], abs=1e-3)


def test_losses_skip_what_is_not_a_number(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1.0, 0.5), (nan, 0.5), (1.0, 1.0), (None, 0.5), (nan, nan)], "y double, p double")
    mean = lambda df: df.agg(F.avg(N.squared_error(F.col("y"), F.col("p")))).first()[0]
    assert mean(rows) == 0.125
    assert np.isnan(mean(rows.union(spark.createDataFrame([(0.0, nan)], rows.schema))))  # a prediction that is no number shows
    odd = spark.createDataFrame([(0.25, 1), (nan, 1), (inf, 0), (-inf, 1), (None, 0), (0.5, 0)], "p double, y int")
    assert sorted(r["p"] for r in metrics.valid(odd).collect()) == [0.25, 0.5]
    assert [r[0] for r in odd.where("p is not null").select(N.finite(F.col("p"))).collect()] == [0.25, 0.0, 0.0, 0.0, 0.5]
