"""Augmented rows and text matrices: against plain Python, and again after other partitions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera
from tessera.operators import augment
from tessera.plans import inference
from tessera.sources import artifacts, matrices, tables

SF = "/root/testdata/sf0.001"


def digits(text, at):
    return int(hashlib.md5(text.encode()).hexdigest()[at : at + 8], 16)


def test_augmented_rows(spark):
    counts, genes = artifacts.written(tables.counts(spark, SF), "counts"), artifacts.written(tables.genes(spark, SF), "genes")
    cells = artifacts.written(tables.cells(spark, SF).where("cell_id % 8 = 1").select("cell_id", "expansion"), "cells")
    schema = inference.fit_schema(counts, genes, cells)
    make = lambda c, k: augment.dense(augment.rows(c, k, schema.stats, 0.3, 7, 4), schema.stats, 0.1, 7, 4).select("cell_id", "x", "clean")
    got = {r["cell_id"]: r for r in make(counts, cells).collect()}
    again = {r["cell_id"]: r for r in make(counts.repartition(7, "gene_id"), cells.repartition(5)).collect()}
    assert got.keys() == again.keys() and all(np.allclose(got[k]["x"], again[k]["x"], atol=1e-12) for k in got)
    stats = sorted(schema.stats.collect(), key=lambda r: r["gene_idx"])
    raw = {}
    for r in counts.collect():
        raw.setdefault(r["cell_id"], {})[r["gene_id"]] = float(r["value"])
    noise = []
    for cell, row in list(got.items())[:60]:
        own = raw.get(cell, {})
        left = {g: v for g, v in own.items() if digits(f"7:4:mask:{cell}:{g}", 0) / 2**32 >= 0.3}
        up = lambda d: 1e4 / sum(d.values()) if sum(d.values()) > 0 else 1.0
        for r, x, clean in zip(stats, row["x"], row["clean"], strict=True):
            assert clean == pytest.approx(own.get(r["gene_id"], 0.0) * up(own))
            z = max(-6, min(6, (math.log1p(left.get(r["gene_id"], 0.0) * up(left)) - r["mu"]) / (r["sigma"] + 1e-10)))
            key = f"7:4:noise:{cell}:{r['gene_idx']}"
            e = math.sqrt(-2 * math.log((digits(key, 0) + 1) / 2**32)) * math.cos(2 * math.pi * digits(key, 8) / 2**32)
            noise.append(e)
            assert x == pytest.approx(z + 0.1 * e, abs=1e-9)
    assert abs(np.mean(noise)) < 0.15 and np.std(noise) == pytest.approx(1, abs=0.12)
    other = augment.rows(counts, cells, schema.stats, 0.3, 7, 5).agg(F.sum(F.size("e"))).first()[0]
    assert other != augment.rows(counts, cells, schema.stats, 0.3, 7, 4).agg(F.sum(F.size("e"))).first()[0]
    assert augment.masked(counts, 0.3, 7, 4).count() == pytest.approx(0.7 * counts.count(), rel=0.05)
    with pytest.raises(ValueError, match="mask rate"):
        augment.masked(counts, 1.0)


def test_text_matrices(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("gene\tc1\tc2\nG1\t0\t2\nG2\t1.5\t0\n\n")
    (tmp_path / "b.tsv").write_text("gene\tc1\nG3\t4\nG2\t0\n")
    about = spark.createDataFrame([("a_c1", "lung")], "cell_id string, tissue string")
    counts, cells, genes = matrices.read_samples(spark, {"a": str(tmp_path / "a.tsv"), "b": str(tmp_path / "b.tsv")}, about)
    assert sorted(map(tuple, counts.collect())) == [("a_c1", "G2", 1.5), ("a_c2", "G1", 2.0), ("b_c1", "G3", 4.0)]
    assert sorted(map(tuple, cells.collect())) == [("a_c1", "a", "lung"), ("a_c2", "a", None), ("b_c1", "b", None)]
    assert sorted(map(tuple, genes.collect())) == [("G1", 0), ("G2", 1), ("G3", 2)]
    (tmp_path / "c.tsv").write_text("gene\tc1\tc2\nG1\t1\n")
    with pytest.raises(Exception, match="a line of 2 fields instead of 3"):
        matrices.sample_counts(spark, "c", str(tmp_path / "c.tsv"))[0].collect()
    (tmp_path / "d.tsv").write_text("gene\tc1\tc1\nG1\t1\t2\n")
    (tmp_path / "e.tsv").write_text("")
    for bad, why in (("d.tsv", "twice"), ("e.tsv", "empty")):
        with pytest.raises(ValueError, match=why):
            matrices.sample_counts(spark, "x", str(tmp_path / bad))
    with pytest.raises(ValueError, match="no samples"):
        matrices.read_samples(spark, {})
    matrices.write_sample(counts.where("cell_id like 'a%'"), str(tmp_path / "out"))
    back = matrices.sample_counts(spark, "s", str(tmp_path / "out"))[0]
    assert sorted(map(tuple, back.collect())) == [("s_a_c1", "G2", 1.5), ("s_a_c2", "G1", 2.0)]


def test_wide_text_matrices(spark, tmp_path):
    """A file of 5,000 cells: the plan has no part for each of them, and what isn't a matrix is refused."""
    counts = spark.range(20000).selectExpr("pmod(id * 7, 5000) as cell_id", "concat('g', id div 5000) as gene_name", "double(id % 5) as value").where("cell_id % 3 > 0 or gene_name = 'g0'")
    matrices.write_sample(counts, str(tmp_path / "wide"))
    lines = spark.read.text(str(tmp_path / "wide")).collect()
    assert len(lines) == 5 and lines[0]["value"].split("\t") == ["gene", *map(str, range(5000))]
    want = {(r["gene_name"], r["cell_id"]): r["value"] for r in counts.collect()}
    for r in lines[1:]:
        gene, *values = r["value"].split("\t")
        assert [float(v) for v in values] == [want.get((gene, c), 0.0) for c in range(5000)] and set(values) <= {"0.0", "1.0", "2.0", "3.0", "4.0"}
    back, cells = matrices.sample_counts(spark, "s", str(tmp_path / "wide"))
    assert cells.count() == 5000 and back.count() == sum(v != 0 for v in want.values())
    for bad, why in (([(1, "g", 1.0), (1, "g", 2.0)], "two values"), ([(None, "g", 1.0)], "no name")):
        with pytest.raises(Exception, match=why):
            matrices.write_sample(spark.createDataFrame(bad, "cell_id long, gene_name string, value double"), str(tmp_path / "bad"))


def test_package_exports_are_there_and_lazy():
    import subprocess
    import sys
    from pathlib import Path

    assert all(getattr(tessera, name) is not None for name in tessera.__all__)
    with pytest.raises(AttributeError):
        tessera.nope  # noqa: B018
    code = "import tessera, sys; assert not any(m.startswith(('pyspark', 'tessera.')) for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_hashes_of_many_texts_are_md5():
    from tessera.functions import hashes

    endings = [*map(str, range(1100)), "a" * 30]
    starts = [b"", b"3:2:noise:1:", b"3:2:noise:22:", b"3:2:noise:123456789:", b"y" * 51, b"y" * 54, b"z" * 70]
    u, v = hashes.Places(np.array(endings, "S")).digits(starts, 300)
    for i, start in enumerate(starts):
        for j in [*range(0, 1100, 7), 1099, 1100]:
            text = start.decode() + endings[j]
            assert (u[i, j], v[i, j]) == (digits(text, 0), digits(text, 8))
    assert hashes.Places(np.array([], "S1")).digits(starts)[0].shape == (7, 0)


def test_sums_of_augmented_rows_are_those_of_the_dense_rows(spark, monkeypatch):
    """In blocks of a few rows, and with cells that have no counts; the rows' arrays aren't expressions of Spark's, so no task evaluates them value by value."""
    monkeypatch.setattr(augment, "BLOCK", 100)
    counts = spark.createDataFrame([(c, g, 1.0 + c % 3) for c in range(50) for g in range(30) if (c + g) % 4 == 0], "cell_id long, gene_id long, value double")
    cells, genes = spark.range(53).select(F.col("id").alias("cell_id"), F.lit("t").alias("kind")), spark.range(30).select(F.col("id").alias("gene_id"), F.col("id").alias("gene_idx"))
    stats = augment.matrix.fit_stats(counts, genes, cells, True)
    rows = augment.rows(counts, cells, stats, 0.2, 3, 2)
    dense = {r["cell_id"]: r for r in augment.dense(rows, stats, 0.05, 3, 2).collect()}
    plan = augment.sums(rows, stats, 0.05, 3, 2)
    assert plan.columns == ["cell_id", "kind", "total", "squares", "most", "clean", "placed"] and "MapInArrow" in plan._jdf.queryExecution().toString()
    got = plan.collect()
    assert len(got) == 53 == len(dense)
    for r in got:
        x, clean = np.array(dense[r["cell_id"]]["x"]), dense[r["cell_id"]]["clean"]
        assert len(x) == 30 and r["kind"] == "t"
        assert np.allclose([r["total"], r["squares"], r["most"], r["clean"], r["placed"]], [x.sum(), (x * x).sum(), x.max(), sum(clean), (x * np.arange(1, 31)).sum()], atol=1e-9)
    bare = augment.sums(augment.rows(counts, cells, stats.limit(0), 0.2, 3, 2), stats.limit(0), 0.05, 3, 2).collect()
    assert [(r["total"], r["most"]) for r in bare] == [(0.0, None)] * 53


def test_noise_is_added_in_place():
    """To each value its own, at both ends of the drawn numbers too, in room that is used again."""
    u, v = np.array([0, 1, 77, 2**32 - 1] * 2, np.uint32), np.array([0, 2**31, 2**32 - 1, 5] * 2, np.uint32)
    x, spare = np.arange(8.0), np.full((2, 8), np.nan)
    for _ in range(2):
        augment.add_normal(x, u, v, 0.05, *spare)
    for i in range(8):
        e = math.sqrt(-2 * math.log((int(u[i]) + 1) / 2**32)) * math.cos(2 * math.pi * int(v[i]) / 2**32)
        assert x[i] == pytest.approx(i + 2 * 0.05 * e, abs=1e-13)
