"""Leaf-wise gradient-boosted trees on histograms of a count matrix's non-zeros.

A gene's normalised values fall in bins by rank among its non-zeros; an implicit zero is bin 0.
A split sends bins from k on to the right, so zeros are always left and a histogram needs
non-zeros only: what is right is summed from the top bin down, what is left is the leaf's
total less that.  Of two children the smaller one is counted, the other is its parent less that.
Trees grow best leaf first.  The children of several promising leaves are counted in one pass;
which splits are taken is then decided by gain, as if one leaf had been split at a time.
Histograms stay tables; a leaf's best split is all that reaches the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators import batching, matrix
from tessera.operators import prefix as P
from tessera.sources import artifacts

BOOSTING = ("gbdt", "goss")


@dataclass(frozen=True)
class LeafwiseParams:
    num_leaves: int = 31
    max_depth: int = -1
    learning_rate: float = 0.1
    n_estimators: int = 100
    min_child_samples: int = 20
    min_child_weight: float = 1e-3
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    min_split_gain: float = 0.0
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    boosting: str = "gbdt"
    top_rate: float = 0.2
    other_rate: float = 0.1
    max_bin: int = 255
    balanced: bool = True
    seed: int = 42

    def __post_init__(self):
        if self.boosting not in BOOSTING:
            raise ValueError(f"unknown boosting {self.boosting!r}; known: {BOOSTING}")
        if self.num_leaves < 2 or self.n_estimators < 1 or self.max_bin < 2:
            raise ValueError("num_leaves and max_bin must be at least 2, n_estimators at least 1")


def values(counts: DataFrame, cells: DataFrame, genes: DataFrame, use_log: bool = True) -> DataFrame:
    """(cell_id, gene_idx, x): normalised non-zeros of the fitted genes.  z-scores would give the same
    trees, as they keep the order of a gene's values."""
    rows = matrix.row_normalize(matrix.slice_rows(counts, cells).join(genes.select("gene_id", "gene_idx"), "gene_id"), log=use_log)
    return rows.select("cell_id", F.col("gene_idx").cast("int").alias("gene_idx"), F.col("z").alias("x"))


def bins(x: DataFrame, max_bin: int = 255) -> DataFrame:
    """(gene_idx, bin, low): bins from 1 on of about equal numbers of a gene's non-zeros, by exact rank, and the
    least value of each.  Equal values share a bin."""
    n = x.groupBy("gene_idx", "x").agg(F.count("*").alias("n"))
    ranked = P.running_sum(n, ["gene_idx"], F.floor(F.col("x") * 16), ["x"], "n", "below")
    total = n.groupBy("gene_idx").agg(F.sum("n").alias("total"))
    bin_ = (F.floor(F.col("below") * (max_bin - 1) / F.col("total")) + 1).cast("int")
    return ranked.join(total, "gene_idx").groupBy("gene_idx", bin_.alias("bin")).agg(F.min("x").alias("low"))


def binned(x: DataFrame, edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, e array<struct<i, b>>): a cell's non-zeros with their bins, one row a cell.  Edges are
    one array a gene (at most ``max_bin`` values)."""
    own = edges.groupBy("gene_idx").agg(F.array_sort(F.collect_list(F.struct("low", "bin"))).alias("edges"))
    at = F.filter("edges", lambda s: s["low"] <= F.col("x"))
    rows = x.join(own, "gene_idx").select("cell_id", F.struct(F.col("gene_idx").alias("i"), F.coalesce(F.try_element_at(at, F.lit(-1))["bin"], F.lit(0)).alias("b")).alias("one"))
    rows = rows.groupBy("cell_id").agg(F.array_sort(F.collect_list("one")).alias("e"))
    return cells.select("cell_id").join(rows, "cell_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<i:int,b:int>>")))


def histogram(rows: DataFrame) -> DataFrame:
    """(node, gene_idx, bin, g, h, n) of rows (node, g, h, e): sums over the non-zeros."""
    return rows.select("node", "g", "h", F.explode("e").alias("x")).groupBy("node", F.col("x.i").alias("gene_idx"), F.col("x.b").alias("bin")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def split_gains(hist: DataFrame, totals: DataFrame, p: LeafwiseParams) -> DataFrame:
    """(node, gene_idx, bin, gain, right_g, right_h, right_n) for each place where a node (node, all_g, all_h, all_n) may be split."""
    down = Window.partitionBy("node", "gene_idx").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.where("bin > 0").select("node", "gene_idx", "bin", *[F.sum(c).over(down).alias(f"right_{c}") for c in ("g", "h", "n")]).join(F.broadcast(totals), "node")  # as many rows as leaves
    soft = lambda g: F.greatest(F.abs(g) - p.reg_alpha, F.lit(0.0))
    part = lambda g, h: F.pow(soft(g), F.lit(2.0)) / (h + p.reg_lambda + 1e-12)
    left = {c: F.col(f"all_{c}") - F.col(f"right_{c}") for c in "ghn"}
    ok = (F.least(left["n"], "right_n") >= p.min_child_samples) & (F.least(left["h"], "right_h") >= p.min_child_weight)
    gain = part(left["g"], left["h"]) + part(F.col("right_g"), F.col("right_h")) - part(F.col("all_g"), F.col("all_h"))
    return rows.where(ok).withColumn("gain", gain).where(F.col("gain") > p.min_split_gain + 1e-9).select("node", "gene_idx", "bin", "gain", "right_g", "right_h", "right_n")


def best_splits(hist: DataFrame, totals: DataFrame, p: LeafwiseParams) -> DataFrame:
    """The best place of each node; of equal gains (to nine decimals) the first gene and bin."""
    gains = split_gains(hist, totals, p)
    rank = F.struct(F.round("gain", 9), -F.col("gene_idx"), -F.col("bin"))
    return gains.groupBy("node").agg(F.max_by(F.struct("gene_idx", "bin", "gain", "right_g", "right_h", "right_n"), rank).alias("s")).select("node", "s.*")


class Node:
    """A node of a growing tree: its sums, best split and children, as far as they are known."""

    def __init__(self, number: int, g: float, h: float, n: int, depth: int):
        self.number, self.g, self.h, self.n, self.depth = number, g, h, n, depth
        self.split: dict | None = None
        self.left: Node | None = None
        self.right: Node | None = None
        self.hist: DataFrame | None = None
        self.taken = False


def place(node: Node, leaf, taken_only: bool = False) -> Column:
    """What ``leaf`` gives for the leaf that a row (e) falls in."""
    if node.left is None or taken_only and not node.taken:
        return leaf(node)
    s = node.split
    own = F.coalesce(F.get(F.filter("e", lambda x: x["i"] == s["gene_idx"]), F.lit(0))["b"], F.lit(0))
    return F.when(own >= s["bin"], place(node.right, leaf, taken_only)).otherwise(place(node.left, leaf, taken_only))


def _chosen(root: Node, p: LeafwiseParams) -> list[Node]:
    """Marks the splits that best-first growth takes, and gives the leaves it would split next
    but whose children aren't counted yet, the best ones first, as many as could still be taken."""
    def reset(n: Node) -> None:
        n.taken = False
        for c in (n.left, n.right):
            if c:
                reset(c)

    reset(root)
    heap, leaves = [], 1
    add = lambda n: heapq.heappush(heap, (-round(n.split["gain"], 9), n.number, n)) if n.split and (p.max_depth < 1 or n.depth < p.max_depth) else None
    add(root)
    while heap and leaves < p.num_leaves:
        if heap[0][2].left is None:
            return [n for _, _, n in heapq.nsmallest(p.num_leaves - leaves, heap) if n.left is None]
        n = heapq.heappop(heap)[2]
        n.taken, leaves = True, leaves + 1
        add(n.left)
        add(n.right)
    return []


def grow(spark: SparkSession, rows: DataFrame, p: LeafwiseParams) -> Node:
    """A tree on rows (g, h, e)."""
    all_ = rows.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).first()
    root = Node(0, all_["g"] or 0.0, all_["h"] or 0.0, all_["n"], 0)
    root.hist = artifacts.written(histogram(rows.withColumn("node", F.lit(0))), "tree-histogram")
    _find(spark, [root], root.hist, p)
    count = 1
    while todo := _chosen(root, p):
        small, large = [], []
        for n in todo:
            s = n.split
            left = Node(count, n.g - s["right_g"], n.h - s["right_h"], n.n - s["right_n"], n.depth + 1)
            right = Node(count + 1, s["right_g"], s["right_h"], s["right_n"], n.depth + 1)
            n.left, n.right, count = left, right, count + 2
            small.append(min(left, right, key=lambda c: c.n))
            large.append((max(left, right, key=lambda c: (c.n, c is not small[-1])), small[-1], n))
        where = rows.withColumn("node", place(root, lambda n: F.lit(n.number))).where(F.col("node").isin([n.number for n in small]))
        counted = histogram(where)
        # the larger child: its parent's histogram less the smaller child's
        pairs = spark.createDataFrame([(s.number, b.number) for b, s, _ in large], "small int, node int")
        parents = None
        for b, _, n in large:
            own = n.hist.select(F.lit(b.number).alias("node"), "gene_idx", "bin", "g", "h", "n")
            parents = own if parents is None else parents.unionByName(own)
        counted = artifacts.written(counted, "tree-histogram")
        less = counted.withColumnRenamed("node", "small").join(F.broadcast(pairs), "small").select("node", "gene_idx", "bin", *[(-F.col(c)).alias(c) for c in ("g", "h", "n")])
        rest = parents.unionByName(less).groupBy("node", "gene_idx", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).where("n > 0")
        both = artifacts.written(counted.unionByName(rest), "tree-histogram")
        fresh = [c for n in todo for c in (n.left, n.right)]
        for c in fresh:
            c.hist = both.where(F.col("node") == c.number)
        _find(spark, fresh, both, p)
    return root


def _find(spark: SparkSession, nodes: list[Node], hist: DataFrame, p: LeafwiseParams) -> None:
    totals = spark.createDataFrame([(n.number, float(n.g), float(n.h), int(n.n)) for n in nodes], "node int, all_g double, all_h double, all_n long")
    found = {r["node"]: r.asDict() for r in best_splits(hist, totals, p).collect()}
    for n in nodes:
        n.split = found.get(n.number)


def _value(n: Node, p: LeafwiseParams) -> float:
    return -p.learning_rate * math.copysign(max(0.0, abs(n.g) - p.reg_alpha), n.g) / (n.h + p.reg_lambda + 1e-12)


MODEL = "tree int, node int, gene_idx int, low double, left int, right int, value double"


def _rows(tree: int, node: Node, low: dict, p: LeafwiseParams) -> list[tuple]:
    if not node.taken:
        return [(tree, node.number, -1, 0.0, -1, -1, _value(node, p))]
    s = node.split
    own = (tree, node.number, s["gene_idx"], low[s["gene_idx"], s["bin"]], node.left.number, node.right.number, 0.0)
    return [own, *_rows(tree, node.left, low, p), *_rows(tree, node.right, low, p)]


def _uniform(seed: int, tree: int, key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(tree), F.col(key)), F.lit(1 << 30)) / float(1 << 30)


def _sampled(rows: DataFrame, p: LeafwiseParams, tree: int) -> DataFrame:
    """The rows that a tree is grown on: a part by hash, or those of the largest gradients and a
    weighted part of the others; genes left out of a tree leave its rows."""
    if p.boosting == "goss":
        bound = rows.agg(F.percentile_approx(F.abs("g"), 1 - p.top_rate, 10_000).alias("bound"))  # one row
        rows = rows.crossJoin(F.broadcast(bound))
        top = F.abs("g") >= F.col("bound")
        up = F.when(top, 1.0).otherwise((1 - p.top_rate) / p.other_rate)
        rows = rows.where(top | (_uniform(p.seed, tree, "cell_id") < p.other_rate / (1 - p.top_rate))).withColumns({"g": F.col("g") * up, "h": F.col("h") * up}).drop("bound")
    elif p.bagging_fraction < 1:
        rows = rows.where(_uniform(p.seed, tree, "cell_id") < p.bagging_fraction)
    if p.feature_fraction < 1:
        rows = rows.withColumn("e", F.filter("e", lambda x: F.pmod(F.xxhash64(F.lit(p.seed), F.lit(-1 - tree), x["i"]), F.lit(1 << 30)) < int(p.feature_fraction * (1 << 30))))
    return rows


@dataclass
class Leafwise:
    """A fitted model: the first score, and a row for each node of each tree."""

    base: float
    nodes: DataFrame


def fit(spark: SparkSession, counts: DataFrame, cells: DataFrame, genes: DataFrame, params: LeafwiseParams | None = None, use_log: bool = True) -> Leafwise:
    """Trees on cells (cell_id, y)."""
    p = params or LeafwiseParams()
    x = artifacts.written(values(counts, cells, genes, use_log), "tree-values")
    edges = artifacts.written(bins(x, p.max_bin), "tree-bins")
    rows = cells.select("cell_id", F.col("y").cast("double").alias("y"), F.lit(1.0).alias("weight"))
    if p.balanced:
        rows = cells.join(F.broadcast(batching.class_weights(cells).select("y", "weight")), "y").select("cell_id", F.col("y").cast("double").alias("y"), "weight")  # two rows
    mean = rows.agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("m")).first()["m"]
    base = math.log(mean / (1 - mean)) if mean and 0 < mean < 1 else 0.0
    rows = artifacts.written(rows.join(binned(x, edges, cells), "cell_id").withColumn("score", F.lit(base)), "tree-rows")
    out: list[tuple] = []
    for tree in range(p.n_estimators):
        q = N.sigmoid(F.col("score"))
        g = rows.withColumn("g", F.col("weight") * (q - F.col("y"))).withColumn("h", F.col("weight") * q * (1 - q))
        own = artifacts.written(_sampled(g, p, tree), "tree-sample") if p.boosting == "goss" or p.bagging_fraction < 1 or p.feature_fraction < 1 else g
        root = grow(spark, own, p)
        if root.split is None:
            break  # nothing is gained any more
        used = _used(root)
        low = {(r["gene_idx"], r["bin"]): r["low"] for r in edges.join(F.broadcast(spark.createDataFrame(sorted(used), "gene_idx int, bin int")), ["gene_idx", "bin"]).collect()}
        out += _rows(tree, root, low, p)
        rows = artifacts.written(rows.withColumn("score", F.col("score") + place(root, lambda n: F.lit(_value(n, p)), taken_only=True)), "tree-rows")
    return Leafwise(base, spark.createDataFrame(out, MODEL))


def _used(node: Node) -> set[tuple[int, int]]:
    if not node.taken:
        return set()
    return {(node.split["gene_idx"], node.split["bin"])} | _used(node.left) | _used(node.right)


def predict(spark: SparkSession, model: Leafwise, counts: DataFrame, cells: DataFrame, genes: DataFrame, use_log: bool = True) -> DataFrame:
    """(cell_id, score, p) of cells; those without counts fall through with zeros."""
    nodes = model.nodes.orderBy("tree", "node").collect()  # trees times leaves
    genes_used = sorted({r["gene_idx"] for r in nodes if r["gene_idx"] >= 0})
    column = {g: k for k, g in enumerate(genes_used)}
    at = {(r["tree"], r["node"]): k for k, r in enumerate(nodes)}
    feature = np.array([column.get(r["gene_idx"], -1) for r in nodes], np.int64)
    low, value = (np.array([r[c] for r in nodes]) for c in ("low", "value"))
    left, right = (np.array([at.get((r["tree"], r[c]), -1) for r in nodes], np.int64) for c in ("left", "right"))
    roots, base = [at[t, 0] for t in sorted({r["tree"] for r in nodes})], model.base

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                x = np.zeros((part.num_rows, len(column) + 1))
                for k, own in enumerate(part["e"].to_pylist()):
                    for s in own:
                        x[k, column[s["i"]]] = s["x"]
                score = np.full(part.num_rows, base)
                for root in roots:
                    now = np.full(part.num_rows, root)
                    while (inner := feature[now] >= 0).any():
                        goes = x[np.arange(len(now)), feature[now]] >= low[now]
                        now = np.where(inner, np.where(goes, right[now], left[now]), now)
                    score += value[now]
                yield pa.RecordBatch.from_arrays([part["cell_id"], pa.array(score)], names=["cell_id", "score"])

    x = values(counts, cells, genes, use_log).where(F.col("gene_idx").isin(genes_used)) if genes_used else values(counts, cells, genes, use_log).limit(0)
    own = x.groupBy("cell_id").agg(F.collect_list(F.struct(F.col("gene_idx").alias("i"), "x")).alias("e"))
    rows = cells.select(F.col("cell_id").cast("long").alias("cell_id")).join(own, "cell_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<i:int,x:double>>")))
    scored = rows.mapInArrow(walk, "cell_id long, score double")
    return scored.withColumn("p", N.sigmoid(F.col("score")))
