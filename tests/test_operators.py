"""Algebraic checks, edge cases and error contracts on small literal tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators import batching as B
from tessera.operators import matrix as M
from tessera.operators import metrics as E
from tessera.operators import scoring as S
from tessera.operators import split as P
from tessera.operators import training as T

SF = "/root/testdata/sf0.001"


def counts(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, gene_id long, value double")


def genes(spark, n):
    return spark.createDataFrame([(g, f"g{g}", g) for g in range(n)], "gene_id long, gene_name string, gene_idx long")


def cells(spark, n):
    return spark.range(n).withColumnRenamed("id", "cell_id")


X = [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 4.0), (1, 2, 3.0), (2, 1, 5.0), (2, 2, 6.0)]


def test_rows_sum_to_target_and_empty_cells_stay_empty(spark):
    z = M.row_normalize(counts(spark, X)).groupBy("cell_id").agg(F.sum("z").alias("s")).collect()
    assert all(abs(r["s"] - 1e4) < 1e-6 for r in z)
    sums = {r["cell_id"]: r["total"] for r in M.row_sums(counts(spark, X), cells(spark, 4)).collect()}
    assert sums[3] == 0.0


def test_statistics_count_implicit_zeros_and_empty_cells(spark):
    got = M.fit_stats(counts(spark, X), genes(spark, 4), cells(spark, 4), log=True).orderBy("gene_idx").collect()
    dense = np.zeros((4, 4))
    for c, g, v in X:
        dense[c, g] = v
    total = dense.sum(1, keepdims=True)
    z = np.log1p(dense * np.where(total > 0, 1e4 / np.where(total > 0, total, 1), 1))
    assert np.allclose([r["mu"] for r in got], z.mean(0)) and np.allclose([r["sigma"] for r in got], z.std(0))
    assert got[3]["mu"] == 0 and got[3]["sigma"] == 0


def test_statistics_of_an_empty_matrix(spark):
    got = M.fit_stats(counts(spark, []), genes(spark, 2), cells(spark, 0)).collect()
    assert [(r["mu"], r["sigma"]) for r in got] == [(0.0, 0.0)] * 2


@pytest.mark.parametrize("over", ["target", "all"])
def test_sum_over_target_or_all_genes(spark, over):
    target = genes(spark, 2).withColumn("mu", F.lit(0.0)).withColumn("sigma", F.lit(1.0))
    z = M.preprocess(counts(spark, X), target, log=False, use_zscore=False, normalize_over=over).where("cell_id = 1").first()["z"]
    assert z == pytest.approx(1e4 if over == "target" else 4 / 7 * 1e4)


def test_sparse_score_equals_dense(spark):
    c, g, k = counts(spark, X), genes(spark, 4), cells(spark, 4)
    stats = M.fit_stats(c, g, k, log=True)
    w = spark.createDataFrame([(0, 0.5), (1, -1.0), (2, 2.0), (3, 0.3)], "gene_id long, w double")
    got = {r["cell_id"]: r["score"] for r in S.linear_sparse(c, k, stats, w, bias=0.1).collect()}
    st = {r["gene_id"]: r for r in stats.collect()}
    dense = np.zeros((4, 4))
    for i, j, v in X:
        dense[i, j] = v
    total = dense.sum(1, keepdims=True)
    z = np.log1p(dense * np.where(total > 0, 1e4 / np.where(total > 0, total, 1), 1))
    mu, sd = np.array([st[j]["mu"] for j in range(4)]), np.array([st[j]["sigma"] for j in range(4)])
    want = 0.1 + np.clip((z - mu) / (sd + 1e-10), -6, 6) @ np.array([0.5, -1.0, 2.0, 0.3])
    assert np.allclose([got[i] for i in range(4)], want)


@pytest.mark.parametrize("have", ["ABCDE", "ACE", "ABCDEFG", "ECADB", "FCAG"])
def test_alignment_scenarios(spark, have):
    target = spark.createDataFrame([(ord(x), i) for i, x in enumerate("ABCDE")], "gene_id long, gene_idx long")
    data = counts(spark, [(0, ord(x), float(i + 1)) for i, x in enumerate(have)])
    got = {r["gene_idx"]: r["value"] for r in M.align(data, target).collect()}
    assert got == {"ABCDE".index(x): float(i + 1) for i, x in enumerate(have) if x in "ABCDE"}


def test_gene_subset_errors(spark):
    g = genes(spark, 3)
    with pytest.raises(ValueError, match="empty"):
        M.require_genes(g, [])
    with pytest.raises(ValueError, match="unknown"):
        M.require_genes(g, ["g1", "nope"])
    assert M.require_genes(g, [0, 2]).count() == 2
    with pytest.raises(ValueError, match="out of range"):
        M.require_genes(g, [0, 3])


def test_labels(spark):
    rows = spark.createDataFrame([("expanded",), ("not_expanded",), ("expanded",), ("other",), (None,)], "e string")
    assert [r[0] for r in rows.select(N.hard_label(F.col("e"))).collect()] == [1, 0, 1, 0, 0]
    soft = spark.createDataFrame([(3.0, 2.0), (3.0, 0.0), (float("nan"), 2.0), (None, 2.0)], "s double, m double").select(N.soft_label(F.col("s"), F.col("m"))).collect()
    assert [r[0] for r in soft] == pytest.approx([0.5, 1 / (1 + math.exp(-1.5)), 0.0, 0.0])


SCORED = list(zip([0] * 5 + [1] * 5, [0.1, 0.2, 0.3, 0.6, 0.7, 0.4, 0.5, 0.8, 0.9, 0.95], ["A"] * 6 + ["B"] * 4, ["X"] * 6 + ["Y"] * 4))


def test_metrics_literals(spark):
    rows = spark.createDataFrame(SCORED, "y int, p double, imputed_labels string, tissue_type string")
    m = E.as_dict(E.report(rows).collect())
    assert m["AUROC"] == pytest.approx(sum((p > q) + 0.5 * (p == q) for y, p, *_ in SCORED if y for z, q, *_ in SCORED if not z) / 25)
    assert m["FNR"] == pytest.approx(0.4) and m["error_rate"] == pytest.approx(0.4)  # 0.5 is not above the threshold
    assert math.isnan(m["B__Y"]["AUROC"]) and m["positives_rate"] == 0.5
    assert m["average"]["AUROC"] == pytest.approx(m["A__X"]["AUROC"])


@pytest.mark.parametrize("values,want", [([2.0, 4.0, 8.0], 3 / (1 / 2 + 1 / 4 + 1 / 8)), ([2.0, 0.0, 8.0], 0.0), ([None, None], None), ([2.0, None, 8.0], 2 / (1 / 2 + 1 / 8))])
def test_harmonic_mean(spark, values, want):
    rows = spark.createDataFrame([("m", v) for v in values], "metric string, value double")
    got = E.harmonic_mean(rows).first()["value"]
    assert got == want if want is None else got == pytest.approx(want)


def people(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, study string, patient string, cancer_type string, tissue_type string, imputed_labels string, sample string")


def test_split_is_disjoint_and_stratified(spark):
    rows = people(spark, [(i, f"s{i % 2}", f"p{i % 20}", "AB"[(i % 20) // 10], "T", "L", "S") for i in range(200)])
    parts = P.checked_split(rows, 0.2)
    got = {r["patient_id"]: (r["cancer_type"], r["split"]) for r in parts.collect()}
    for kind in "AB":
        own = [s for c, s in got.values() if c == kind]
        assert own.count("dev") == 2 and len(own) == 10
    assert P.split_cells(rows, parts).count() == 200
    assert parts.exceptAll(P.checked_split(rows, 0.2)).isEmpty()


def test_split_errors(spark):
    with pytest.raises(ValueError, match="must not contain"):
        P.checked_split(people(spark, [(0, "a:b", "p", "A", "T", "L", "S")]))
    with pytest.raises(ValueError, match="exactly one cancer"):
        P.checked_split(people(spark, [(0, "a", "p", "A", "T", "L", "S"), (1, "a", "p", "B", "T", "L", "S")]))


def test_balanced_batches_repeat_the_rare_class(spark):
    rows = spark.createDataFrame([(i, int(i == 9)) for i in range(10)], "cell_id long, y int")
    got = B.balanced_labels(rows, 4).collect()
    for b in range(3):
        own = [r["y"] for r in got if r["batch_id"] == b]
        assert sorted(own) == [0, 0, 1, 1]
    with pytest.raises(ValueError, match="both classes"):
        B.check_classes(rows.where("y = 0"))


def test_balanced_types(spark):
    rows = spark.createDataFrame([(i, int(i % 3 == 0), "T" + str(i % 2), "L") for i in range(40)], "cell_id long, y int, tissue_type string, imputed_labels string")
    got = B.balanced_types(rows, 6).groupBy("batch_id", "stratum").count().collect()
    for b in {r["batch_id"] for r in got}:
        own = [r["count"] for r in got if r["batch_id"] == b]
        assert sum(own) == 6 and max(own) - min(own) <= 1
    with pytest.raises(ValueError, match="below"):
        B.balanced_types(rows, 2)


def test_codes_follow_first_appearance_and_unknown_policies(spark):
    rows = spark.createDataFrame([(0, "z"), (1, "a"), (2, None)], "cell_id long, tissue_type string")
    codes = M.category_codes(rows, "tissue_type")
    assert {r["category"]: r["code"] for r in codes.collect()} == {"z": 0, "a": 1, "nan": 2}
    new = spark.createDataFrame([(5, "q")], "cell_id long, tissue_type string")
    assert M.encode(new, codes, "tissue_type").first()["tissue_type_code"] == -1
    assert M.encode(new, codes, "tissue_type", "first").first()["tissue_type_code"] == 0
    assert {r["hot"] for r in M.one_hot(new, codes, "tissue_type").collect()} == {0}


def test_lgamma_and_losses(spark):
    rows = spark.createDataFrame([(x,) for x in (0.01, 0.5, 1.0, 2.0, 7.3, 100.0, 1000.0)], "x double")
    got = [r[0] for r in rows.select(N.lgamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(r["x"]) for r in rows.collect()], rel=1e-9, abs=1e-9)
    nll = spark.range(1).select(N.nb_log_likelihood(F.lit(3.0), F.lit(2.0), F.lit(1.5))).first()[0]
    p = 2.0 / 3.5
    assert nll == pytest.approx(math.lgamma(4.5) - math.lgamma(1.5) - math.lgamma(4) + 1.5 * math.log(1 - p) + 3 * math.log(p), rel=1e-5)


def test_training_control(spark):
    log = spark.createDataFrame([("r", e, s) for e, s in enumerate([0.1, 0.5, 0.4, 0.5, 0.3])], "run string, epoch long, score double")
    got = T.early_stopping(log, 2).orderBy("epoch").collect()
    assert [r["wait"] for r in got] == [0, 0, 1, 2, 3] and [r["stop"] for r in got] == [False, False, False, True, True]
    assert T.best_epoch(log).first()["epoch"] == 1
    assert T.plateau_lr([0.5, 0.4, 0.4, 0.4, 0.4], 1.0) == pytest.approx(0.1)
    with pytest.raises(ValueError, match="unknown schedule"):
        T.lr_schedule("nope", 0, 10)


def joins_of(df):
    """The joins' kinds of a plan, with how many keys each has, before any adaption at run time."""
    import re

    return re.findall(r"(SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin)(?: \(|\s+\[)([^\]\n]*)", df._jdf.queryExecution().executedPlan().toString())


def test_class_tables_never_gather_a_class_in_one_task(spark):
    """No join by a class alone (label, stratum, cancer type, sample) deals rows by it."""
    from tessera.operators import split
    from tessera.sources import tables

    cells = artifacts_of(spark, tables.cells(spark, SF).selectExpr("*", "case when expansion = 'expanded' then 1 else 0 end as y"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [(B.balanced_labels(cells, 64), "y"), (B.balanced_types(cells, 64), "stratum"), (split.split_patients(cells), "cancer_type"), (tables.clone_sizes(cells), "sample")]
        for df, key in plans:
            alone = [k for kind, k in joins_of(df) if kind != "BroadcastHashJoin" and "," not in k and k.startswith(key + "#")]
            assert not alone, (key, alone)
            assert any(kind == "BroadcastHashJoin" for kind, _ in joins_of(df))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def artifacts_of(spark, df):
    from tessera.sources import artifacts

    return artifacts.written(df, "cells")


def test_prepared_cells_are_not_broadcast(spark, tmp_path):
    """A row a cell is joined by key, even where its file is small."""
    from tessera.plans import prepare
    from tessera.sources import tables

    made = prepare.prepare(spark, f"file://{tmp_path}/p", tables.counts(spark, SF), tables.genes(spark, SF), artifacts_of(spark, tables.cells(spark, SF)))
    assert [kind for kind, _ in joins_of(made.cells)] == ["SortMergeJoin"]
