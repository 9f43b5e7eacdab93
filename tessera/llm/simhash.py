"""SimHash near-duplicates through vantage-point shards.

A document's fingerprint has a bit for each of 64 places: the majority of that bit over
the XXH64 (seed 42) of its word shingles.  Equal fingerprints are one node from there on,
so copies cost nothing more.  A vantage-point tree, fitted on a bounded sample, cuts the
space of fingerprints into shards: at each branch those within a radius of the vantage
point go one way, the rest the other.  Every fingerprint has one home shard and is also
sent to each shard that the triangle bound doesn't rule out for a search of 3 bits; so a
pair within 3 bits meets in the home of either.  Inside a shard the same bounds prune the
search, pairs are checked exactly, and only a spanning star of each group leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import bucket_links, components

SEED = 42

#: Fingerprints that the tree is fitted on, at most about; all are routed through it.
SAMPLE = 32_768
#: Fingerprints in a shard, about, up to ``SHARDS`` shards; beyond, shards grow.
SHARD = 32_768
SHARDS = 4_096
#: Below this many comparisons a part of a shard is compared outright.
DIRECT = 1 << 18


def _hashes(text: str, k: int) -> np.ndarray:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    own = [b" ".join(words)] if len(words) < k else list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), own), np.uint64, len(own))


def _majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprint of each list of hashes: a bit is 1 if set in over half of them."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    for i in np.flatnonzero(sizes > 65_535):  # more than a 16-bit lane counts
        bits = sum(np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for part in np.array_split(hashes[i], len(hashes[i]) // 65_536 + 1))
        out[i] = np.packbits(2 * bits > sizes[i], bitorder="little").view("<u8")[0]
    some = np.flatnonzero((sizes > 0) & (sizes <= 65_535))
    if not len(some):
        return out
    flat = np.concatenate([hashes[i] for i in some])
    begin = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
    found = np.zeros(len(some), np.uint64)
    lane = np.uint64(0x0001000100010001)
    for k in range(16):
        sums = np.add.reduceat((flat >> np.uint64(k)) & lane, begin)
        for j in range(4):
            count = (sums >> np.uint64(16 * j)) & np.uint64(0xFFFF)
            found |= (2 * count > sizes[some].astype(np.uint64)).astype(np.uint64) << np.uint64(16 * j + k)
    out[some] = found
    return out


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, fp long) of every whole text: lower-cased A-Z, shingles of ``words`` words,
    repeats included; a shorter text is one shingle, one without words (or null) has 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = _majorities([_hashes(x or "", words) for x in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fp long")


def _apart(a: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(a ^ v)


class VantageTree:
    """Branches of a vantage-point tree, in arrays: point, radius, and the two children
    (a leaf's number is stored as -1 - leaf).  Inside: at most ``radius`` bits away."""

    def __init__(self, sample: np.ndarray, leaves: int, reach: int, seed: int = 7):
        self.point, self.radius, self.inner, self.outer, self.leaves = [], [], [], [], 0
        self.reach = reach
        rng = np.random.default_rng(seed)
        self.root = self._grow(np.unique(sample), leaves, rng)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, own: np.ndarray, leaves: int, rng) -> int:
        if leaves <= 1 or len(own) < 8:
            return self._leaf()
        best = best_cut(own, own, self.reach, rng)
        if best is None:
            return self._leaf()
        v, r = best
        me = len(self.point)
        for x, y in ((self.point, v), (self.radius, r), (self.inner, 0), (self.outer, 0)):
            x.append(y)
        inside = _apart(own, v) <= r
        share = max(1, min(leaves - 1, round(leaves * inside.mean())))
        self.inner[me] = self._grow(own[inside], share, rng)
        self.outer[me] = self._grow(own[~inside], leaves - share, rng)
        return me

    def route(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, is home) for each shard that a fingerprint's search touches."""
        rows, leaves, homes = [], [], []
        todo = [(self.root, np.arange(len(fp)), np.ones(len(fp), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -1 - node))
                homes.append(home)
                continue
            d, r = _apart(fp[at], self.point[node]).astype(np.int64), self.radius[node]
            i, o = d <= r + self.reach, d > r - self.reach
            todo.append((self.inner[node], at[i], home[i] & (d[i] <= r)))
            todo.append((self.outer[node], at[o], home[o] & (d[o] > r)))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def best_cut(own: np.ndarray, queries: np.ndarray, reach: int, rng, tries: int = 6):
    """The vantage point and radius, of a few tried on up to 2,048 rows, that leave the
    fewest comparisons; None if none saves a twentieth."""
    some = own if len(own) <= 2048 else rng.choice(own, 2048, replace=False)
    asked = queries if len(queries) <= 2048 else rng.choice(queries, 2048, replace=False)
    best, least = None, 0.95 * len(some) * len(asked)
    for v in rng.choice(own, min(tries, len(own)), replace=False):
        d, q = _apart(some, v).astype(np.int64), _apart(asked, v).astype(np.int64)
        have = np.cumsum(np.bincount(d, minlength=72))
        ask = np.cumsum(np.bincount(q, minlength=72))
        mid = int(np.searchsorted(have, have[-1] / 2))
        for r in range(max(0, mid - 2), min(63, mid + 2)):
            inside = have[r]
            cost = inside * ask[min(71, r + reach)] + (have[-1] - inside) * (ask[-1] - (ask[r - reach] if r >= reach else 0))
            if cost < least and 0 < inside < have[-1]:
                best, least = (v, r), cost
    return best


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        before = label.copy()
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (before == label).all():
            return label


def shard_links(home: np.ndarray, visitors: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of every group of fingerprints that pairs within ``reach`` bits
    connect, a pair being of two of ``home`` or one of it and one visitor."""
    every = np.concatenate([home, visitors])
    rng = np.random.default_rng(11)
    label = np.arange(len(every))
    kept: list[np.ndarray] = []
    count = 0

    def settle() -> None:
        nonlocal label, kept, count
        if kept:
            a, b = np.concatenate(kept, axis=1)
            label = spanning(len(every), np.concatenate([a, np.arange(len(every))]), np.concatenate([b, label]))
        kept, count = [], 0

    todo = [(np.arange(len(home)), np.arange(len(every)))]
    while todo:
        h, q = todo.pop()
        if not len(h) or not len(q):
            continue
        cut = best_cut(every[h], every[q], reach, rng) if len(h) * len(q) > DIRECT and len(h) > 64 else None
        if cut:
            v, r = cut
            dh, dq = _apart(every[h], v).astype(np.int64), _apart(every[q], v).astype(np.int64)
            todo.append((h[dh <= r], q[dq <= r + reach]))
            todo.append((h[dh > r], q[dq > r - reach]))
            continue
        step = max(1, (1 << 20) // len(h))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, j = np.nonzero(np.bitwise_count(every[part][:, None] ^ every[h][None, :]) <= reach)
            a, b = part[i], h[j]
            real = a != b
            kept.append(np.stack([a[real], b[real]]))
            count += len(a)
            if count > 1 << 21:
                settle()
    settle()
    ends = np.flatnonzero(label != np.arange(len(every)))
    return every[ends], every[label[ends]]


def near_links(spark: SparkSession, nodes: DataFrame, reach: int = 3, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that connect all fingerprints (distinct ``fp``) within ``reach`` bits."""
    n = nodes.count()
    some = nodes.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // sample))) == 0).limit(2 * sample)
    fitted = np.array([r.fp for r in some.collect()], np.int64).view(np.uint64)
    tree = VantageTree(fitted, max(1, min(SHARDS, n // shard)), reach)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False)
            row, leaf, home = tree.route(fp.view(np.uint64))
            for at in range(0, len(row), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[cut]), pa.array(fp[row[cut]]), pa.array(home[cut])], names=["leaf", "fp", "home"])

    def search(own: pd.DataFrame) -> pd.DataFrame:
        fp = own["fp"].to_numpy().view(np.uint64)
        home = own["home"].to_numpy().astype(bool)
        a, b = shard_links(fp[home], fp[~home], reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = nodes.select("fp").mapInArrow(route, "leaf long, fp long, home boolean")
    return routed.groupBy("leaf").applyInPandas(search, "a long, b long")


def near_groups(spark: SparkSession, docs: DataFrame, words: int = 5, reach: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document: near-duplicates, directly or through
    others, share the smallest doc_id among them.

    Null doc_id: a document like any other, but it doesn't name a group; a group of such
    documents alone has a null component_id.  Repeated rows: each has its row."""
    fps = common.written(spark, fingerprints(docs, words), "fingerprints")
    nodes = common.written(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    roots = components(spark, near_links(spark, nodes, reach))
    member = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    member = member.join(nodes, "fp")
    linked = member.join(member.groupBy("root").agg(F.min("first").alias("group_first")), "root").select("fp", "group_first")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("group_first", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: One-permutation MinHash: ranges of hashes whose least ones make bands.
BANDS, ROWS = 21, 6
BINS = 256
#: Members of a block of a bucket: two blocks at a time are compared in one task.
BLOCK = 1024


def _bands(own: np.ndarray) -> np.ndarray:
    """Keys of 21 bands of 6 bins of a sorted set: a bin holds the least hash in its range of
    256, an empty one borrows from the next full one."""
    at = np.searchsorted(own, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    full = np.diff(np.append(at, len(own))) > 0
    if not full.any():
        return np.zeros(0, np.uint64)
    places = np.flatnonzero(full)
    least = own[at[places]]
    part = least[np.searchsorted(places, np.arange(BANDS * ROWS)) % len(places)].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = (key ^ part[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def block_links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, group: np.ndarray, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each group that pairs (one of ``first``, one of ``second``) of sets
    connect whose resemblance, counted exactly, is ``alike`` or more; pairs of one group are done.

    Elements of two sets or more are the columns of a 0/1 matrix, in slices; its product with
    itself holds the sizes of all intersections."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    ids, times = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)[1:]
    column = np.cumsum(times > 1) - 1
    row, shared = np.repeat(np.arange(n), sizes), times[ids] > 1
    row, column = row[shared], column[ids[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    step = 4096
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        cut = slice(*np.searchsorted(column, [k, k + step]))
        part = np.zeros((n, step), np.float32)
        part[row[cut], column[cut] - k] = 1
        both += part @ part.T
    near = (both >= alike * (sizes[:, None] + sizes[None, :] - both) - 1e-6) & first[:, None] & second[None, :] & (group[:, None] != group[None, :])
    a, b = np.nonzero(near)
    label = spanning(n, a, b)
    ends = np.flatnonzero(label != np.arange(n))
    return ends, label[ends]


def similar_nodes(spark: SparkSession, rows: DataFrame, words: int = 5, reach: int = 3, alike: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (uid, doc_id, text): marks (uid, doc_id, h), h standing for a text's sequence of words;
    nodes (h, own, first), with the number of rows and the first one (known, doc_id, uid); and
    roots (h, root) of the nodes that aren't their group's smallest.

    A group is what links of a resemblance of ``alike`` or more connect, among pairs that share
    a band or whose fingerprints are within ``reach`` bits.  Three bits of 64 reach only the nearest of copies (see
    the README), and no bound of a vantage-point tree prunes a search of the ten or so bits that
    a resemblance of 0.8 needs; so banded MinHash keys add candidates.  Every link is decided by the
    whole sets of shingles: first of a bucket's members with one of them, then, where a bucket
    still has several groups, of all its pairs, block by block.  Documents without words are alike."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part["text"].to_pylist()]
                found = [_hashes(x, words) for x in texts]
                h = [xxhash.xxh64_intdigest(b" ".join(x.encode("utf-8", "surrogatepass").lower().split()), SEED) for x in texts]
                sets = [np.unique(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part["uid"], part["doc_id"], pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(_majorities(found).view(np.int64)), pa.array([_bands(x).view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int32())],
                    names=["uid", "doc_id", "h", "fp", "bands", "n"],
                )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["h"], pa.array([np.unique(_hashes(x or "", words)).tobytes() for x in part["text"].to_pylist()], pa.binary())], names=["h", "s"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= alike * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(ok, pa.bool_())), batch["b"].filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None  # members of the block pair that is being read

        def settle() -> pa.RecordBatch:
            h, g, b = (np.array([m[k] for m in held], np.int64) for k in range(3))
            x, y = block_links([np.frombuffer(m[3], np.uint64) for m in held], b == now[1], b == now[2], g, alike)
            return pa.RecordBatch.from_arrays([pa.array(h[x]), pa.array(h[y])], names=["a", "b"])

        for batch in batches:
            for key, lo, hi, h, g, b, s in zip(*(batch[c].to_pylist() for c in ("key", "lo", "hi", "h", "g", "b", "s")), strict=True):
                if (key, lo, hi) != now:
                    if len(held) > 1:
                        yield settle()
                    held, now = [], (key, lo, hi)
                held.append((h, g, b, s))
        if len(held) > 1:
            yield settle()

    marks = common.written(spark, rows.select("uid", "doc_id", "text").mapInArrow(work, "uid long, doc_id long, h long, fp long, bands array<long>, n int"), "near-marks")
    first = F.min(F.struct(F.when(F.col("doc_id").isNull(), 1).otherwise(0).alias("known"), "doc_id", "uid")).alias("first")
    nodes = common.written(spark, marks.groupBy("h").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.count("*").alias("own")), "near-nodes")
    chief = nodes.groupBy("fp").agg(F.min("h").alias("a"))
    same = nodes.join(chief, "fp").where("h != a").select("a", F.col("h").alias("b"))
    near = near_links(spark, chief.select("fp"), reach)
    name = lambda fp, h: chief.select(F.col("fp").alias(fp), F.col("a").alias(h))
    near = near.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(name("fa", "a"), "fa").join(name("fb", "b"), "fb").select("a", "b")
    prints = common.written(spark, same.unionByName(near).distinct(), "near-prints")

    banded = common.written(spark, nodes.select("h", "n", F.explode("bands").alias("key")), "near-bands")
    shared = banded.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key")
    banded = common.written(spark, banded.join(shared, "key", "left_semi"), "near-buckets")
    asked = prints.select(F.col("a").alias("h")).union(prints.select("b")).union(banded.select("h")).distinct()
    asked = common.written(spark, nodes.join(asked, "h", "left_semi").select("h", F.col("first.uid").alias("uid")), "near-asked")
    sets = rows.select("uid", "text").join(common.small_side(asked), "uid").select("h", "text").mapInArrow(shingled, "h long, s binary")
    sets = common.written(spark, sets, "near-sets")

    def sure(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(count, "a long, b long")

    def finish(left: DataFrame) -> DataFrame:
        n = F.ceil(F.col("m") / BLOCK).cast("int")
        left = left.withColumn("b", F.pmod(F.xxhash64("h"), n).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), n - 1)))
        left = left.select("key", F.least("b", "with").alias("lo"), F.greatest("b", "with").alias("hi"), "h", "g", "b").join(sets, "h")
        at = ["key", "lo", "hi"]
        left = left.repartition(common.tasks(spark), *at).sortWithinPartitions(*at)
        return left.select(*at, "h", "g", "b", "s").mapInArrow(blocks, "a long, b long")

    fits = lambda x, y: F.least(x("n"), y("n")) >= F.greatest(x("n"), y("n")) * alike - 1e-9
    roots = components(spark, bucket_links(spark, banded, sure(prints), sure, fits, finish=finish))
    return marks.select("uid", "doc_id", "h"), nodes.select("h", "own", "first"), roots.withColumnRenamed("node", "h")


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` in a box, with doc_id, text and a number of each row, written."""
    own = [c for c in ("doc_id", "text") if c in docs.columns]
    return common.written(spark, common.boxed(docs, *own).withColumn("uid", F.monotonically_increasing_id()), "near-rows")


def similar_groups(spark: SparkSession, docs: DataFrame, words: int = 5, reach: int = 3, alike: float = 0.8) -> DataFrame:
    """(doc_id, h, component_id) of every row: groups as ``similar_nodes`` has them, named by
    their smallest doc_id.

    Null doc_id: a document like any other, but it doesn't name a group; a group of such
    documents alone has a null component_id.  Null and empty texts are alike.  Repeated rows:
    each has its row."""
    rows = numbered(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    marks, nodes, roots = similar_nodes(spark, rows, words, reach, alike)
    grouped = nodes.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    named = grouped.groupBy("root").agg(F.min("first").alias("least")).select("root", F.col("least.doc_id").alias("component_id"))
    named = common.written(spark, grouped.join(named, "root").select("h", "own", "component_id"), "near-named")
    return common.spread_join(marks, named, "h", "own").select("doc_id", "h", "component_id")


def drop_near(spark: SparkSession, docs: DataFrame, words: int = 5, reach: int = 3, alike: float = 0.8) -> DataFrame:
    """The documents with one of each group of ``similar_groups``: that of the smallest doc_id.

    Rows are told apart by a number of their own, so different texts of one doc_id are different
    documents.  Null doc_id: a document like any other, after all others.  Repeated rows leave
    one.  Null and empty texts are one group.  Empty table: no rows.  Columns are those of ``docs``."""
    rows = numbered(spark, docs)
    with common.passing(spark):
        _, nodes, roots = similar_nodes(spark, rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string")), words, reach, alike)
        stay = nodes.join(roots, "h", "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("first").alias("least")).select(F.col("least.uid").alias("uid"))
        stay = common.written(spark, stay, "near-stay", outlives=True)
    return common.unboxed(rows.join(common.small_side(stay), "uid", "left_semi"), docs.columns, "doc_id", "text")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and their groups within 3 bits, for all
    ``documents``.  Null or empty text: fingerprint zero, linked like any other.  Empty
    table: no rows.  Other columns: ignored."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_groups(spark, docs, words=3, reach=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
