"""Jaccard join of documents' word n-grams through a token-group matrix.

Distinct sets are partitioned into groups of similar ones, by their least hashes.  The matrix
holds which tokens each group's sets have between them.  A set's overlap with all of a group's
tokens bounds its overlap with any member, so a group is opened for a set only if enough of the
set's tokens are in its union; opened groups are compared exactly.

The bound is applied twice.  Two sets of a similarity of ``alike`` share at least k tokens among the
rarest ones of each (its prefix: all but ceil(alike * size) - k, in one order of all tokens); of the
smaller one, all but ceil(2 alike / (1 + alike) * size) - k do.  So the matrix that Spark joins has
those short prefixes only, is asked by sets at least as large, and a pair (set, group) needs k tokens.  A token
that only sets of unlike sizes share is left out of it.  Where a
group is opened, the whole union is counted.  The order is by frequency, from counts in a table of a
fixed size (``CELLS``): a poor estimate makes more pairs, never fewer links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import SEED, block_links

#: Sets in a group, about, and sets that are asked of an opened group at a time.
GROUP = 256
#: Tokens that two prefixes share.
SHARED = 3
#: Cells of the table of token frequencies, and cells in one of its blocks.
CELLS = 1 << 22
BLOCK = 1 << 16
#: Levels of frequency for each doubling of it.
LEVELS = 16
#: The greatest frequency that is told from others.
MOST = (1 << 16) - 1
#: Tokens that a task holds before it hands them on.
HELD = 1 << 20
#: Sets in which a task meets a token up to which their sizes are looked at.
REPEATS = 8
#: Words that a Python worker remembers the hashes of.
REMEMBERED = 200_000
#: Odd numbers that give a word's place in a shingle its weight.
WEIGHTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


class WordHashes(dict):
    """XXH64 of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_words = WordHashes()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of k words, A-Z lower-cased; of fewer words, the whole
    sequence as one; of none, an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([_words[b" ".join(words)]], np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += w[i : i + n] * np.uint64(WEIGHTS[i])
    h ^= h >> np.uint64(32)
    h *= np.uint64(WEIGHTS[0])
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def size_class(n: int, percent: int) -> int:
    """Classes of set sizes, 0 to 127: two sets of a similarity of ``percent`` are in the same or in neighbouring ones."""
    return min(127, int(np.log(n) / np.log(max(1.2, 101 / percent))))  # a hundredth more than needed, for rounding


def measured(rows: DataFrame, k: int, cells: int) -> DataFrame:
    """Of rows (uid, doc_id, text): (uid, doc_id, n, h1, h2, m1, m2), a set's size, hash and two least
    tokens, and rows (block, counts), a task's frequencies of tokens by cell."""
    names = ["uid", "doc_id", "n", "h1", "h2", "m1", "m2", "block", "counts"]
    types = [pa.int64()] * 7 + [pa.int32(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen = np.zeros(cells, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(x, k) for x in part["text"].to_pylist()]
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
                m = np.array([[*x[:2], *[0] * (2 - len(x[:2]))] for x in sets], np.uint64).view(np.int64)
                own = [part["uid"], part["doc_id"], pa.array([len(x) for x in sets], pa.int64()), *[pa.array(np.ascontiguousarray(v)) for v in (h[:, 0], h[:, 1], m[:, 0], m[:, 1])]]
                yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(sets), t) for t in types[7:]]], names=names)
                np.add.at(seen, _cell(np.concatenate(sets), cells), 1)
        counts = np.minimum(seen, MOST).astype("<u2").reshape(-1, min(BLOCK, cells))
        some = np.flatnonzero(counts.any(axis=1))
        own = [pa.array(some, pa.int32()), pa.array([zlib.compress(counts[b].tobytes(), 1) for b in some], pa.binary())]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), t) for t in types[:7]], *own], names=names)

    return rows.select("uid", "doc_id", "text").mapInArrow(work, "uid long, doc_id long, n long, h1 long, h2 long, m1 long, m2 long, block int, counts binary")


def frequencies(spark: SparkSession, marks: DataFrame, cells: int) -> np.ndarray:
    """The table of token frequencies of all rows, as levels (a byte) of their logarithms; its size doesn't grow."""

    size = min(BLOCK, cells)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, part in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total.setdefault(b, np.zeros(size, np.int64))
                total[b] += np.frombuffer(zlib.decompress(part), "<u2")
        for b, own in total.items():
            level = (LEVELS * np.log2(np.clip(own, 1, MOST))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])

    parts = marks.where("block is not null").select("block", "counts").repartition(common.tasks(spark), "block")
    out = np.zeros((cells // size, size), np.uint8)
    for row in parts.mapInArrow(add, "block int, levels binary").collect():
        out[row.block] = np.frombuffer(row.levels, np.uint8)
    return out.reshape(-1)


def prefixes(rows: DataFrame, held: Broadcast, k: int, percent: int, shared: int) -> DataFrame:
    """(uid, n, short, tokens): the tokens of each set's prefix, rarest first; the first ``short`` are those of the
matrix.  Sets too small to be like a different one have no row.  ``held``: the table of frequencies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                uids, sizes, shorts, tokens = [], [], [], []
                for uid, text in zip(part["uid"].to_pylist(), part["text"].to_pylist(), strict=True):
                    own = shingle_set(text, k)
                    n = len(own)
                    if 100 * n < percent * (n + 1):
                        continue
                    least = np.argsort(often[_cell(own, len(often))], kind="stable")
                    size = lambda overlap: n - max(shared, overlap) + shared  # noqa: B023, E731
                    uids.append(uid)
                    sizes.append(n)
                    shorts.append(size(-(-2 * percent * n // (100 + percent))))
                    tokens.append(own[least[: size(-(-percent * n // 100))]].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shorts, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["uid", "n", "short", "tokens"])

    return rows.select("uid", "text").mapInArrow(work, "uid long, n long, short long, tokens array<long>")


def partners(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which entries of tokens t meet another of the same token that they may be linked to.  n: 256 * node + 2 * size's
    class + whether the token is of the short prefix, as the smaller one's must be; or -1, a mark for nodes handed on before."""
    marked = np.isin(t, t[n < 0])
    kind = np.where(n < 0, -2, n >> 1 & 127)
    order = np.lexsort((kind, t))
    t, kind, short = t[order], kind[order], (n[order] & 1).astype(np.int64)
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (kind[1:] != kind[:-1])
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    many, shorts = np.diff(np.append(begin, len(t))), np.add.reduceat(short, begin) if len(t) else begin
    next_ = (t[begin][1:] == t[begin][:-1]) & (kind[begin][1:] == kind[begin][:-1] + 1)  # the run after is of the class above
    above, below = np.append(next_, False), np.insert(next_ & (shorts[:-1] > 0), 0, False)[: len(begin)]
    in_class = (many[run] > 1) & (shorts[run] > 0)
    out = np.zeros(len(t), bool)
    out[order] = in_class | below[run] | above[run] & (short > 0)
    return (out | marked) & (n >= 0)


def shared_tokens(spark: SparkSession, prefixed: DataFrame, buckets: int, percent: int, held: int = HELD, repeats: int = REPEATS) -> DataFrame:
    """(token, node, short) of rows (node, n, short, tokens): every token that two nodes have whose sizes allow a link,
    the smaller one among its first ``short`` ones, with each of those nodes, and whether it is among its first ones.

    Most tokens are of one node, and most of the others of nodes of unlike sizes.  Entries come packed to a bucket of
    tokens, which tells those apart.  Nodes of a token that a task has met more than ``repeats`` times are handed on at
    once, and the bucket gets one mark for them.  So a token in very many nodes comes to its bucket a few times a task."""
    names = ["bucket", "tokens", "nodes", "token", "node"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t, n = np.concatenate(tokens), np.concatenate(nodes)
            tokens.clear()
            nodes.clear()
            order = np.argsort(t, kind="stable")
            t, n = t[order], n[order]
            new = np.diff(t, prepend=~t[:1]) != 0
            long = np.diff(np.append(np.flatnonzero(new), len(t)))
            often = np.repeat(long > repeats, long)
            for at in range(0, int(often.sum()), 50_000):
                x, y = t[often][at : at + 50_000].view(np.int64), n[often][at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int32()), *[pa.nulls(len(x), pa.binary())] * 2, pa.array(x), pa.array(y)], names=names)
            n = np.where(often, -1, n)[new | ~often]
            t = t[new | ~often]
            b = (t >> np.uint64(32)).astype(np.int64) * buckets >> 32
            cut = [*np.flatnonzero(np.diff(b, prepend=-1)), len(t)]
            rows = [(int(b[lo]), t[lo:hi].tobytes(), n[lo:hi].tobytes()) for lo, hi in zip(cut, cut[1:], strict=False)]
            for at in range(0, len(rows), 64):
                x, y, z = zip(*rows[at : at + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.binary()), pa.array(z, pa.binary()), *[pa.nulls(len(x), pa.int64())] * 2], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part["tokens"]
                tokens.append(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                long = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
                node = np.repeat(part["node"].to_numpy(zero_copy_only=False), long)
                kind = np.repeat(np.array([2 * size_class(n, percent) for n in part["n"].to_pylist()], np.int64), long)
                nodes.append((node << 8) + kind + (place < np.repeat(part["short"].to_numpy(zero_copy_only=False), long)))
                if sum(map(len, tokens)) > held:
                    yield from flush()
        if tokens:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[bytes, bytes]] = []
        now = None

        def settle() -> Iterator[pa.RecordBatch]:
            t, n = (np.concatenate([np.frombuffer(x[k], dt) for x in own]) for k, dt in ((0, np.uint64), (1, np.int64)))
            met = partners(t, n)
            t, n = t[met].view(np.int64), n[met]
            for at in range(0, len(t), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(t[at : at + 50_000]), pa.array(n[at : at + 50_000])], names=["token", "node"])

        for batch in batches:
            for b, x, y in zip(batch["bucket"].to_pylist(), batch["tokens"].to_pylist(), batch["nodes"].to_pylist(), strict=True):
                if b != now and own:
                    yield from settle()
                    own = []
                now = b
                own.append((x, y))
        if own:
            yield from settle()

    packed = prefixed.select("node", "n", "short", "tokens").mapInArrow(pack, "bucket int, tokens binary, nodes binary, token long, node long")
    packed = common.written(spark, packed, "ngram-packed")
    met = packed.where("bucket is not null").select("bucket", "tokens", "nodes").repartition(common.tasks(spark), "bucket").sortWithinPartitions("bucket")
    found = packed.where("token is not null").select("token", "node").unionByName(met.mapInArrow(merge, "token long, node long"))
    found = common.written(spark, found.select("token", F.shiftright("node", 8).alias("node"), (F.col("node") % 2 == 1).alias("short")), "ngram-shared")
    common.dropped(spark, packed)
    return found


def grouped(spark: SparkSession, nodes: DataFrame, size: int) -> DataFrame:
    """(node, gid, n) of sets (node, n, m1, m2): those of one least token are a group; if more than ``size``
    are, they are dealt out to as few groups as hold them, by a hash of the second least, or by their own where
    those of the same two are too many still."""
    of = lambda df, by, name: df.groupBy(*by).agg(F.count("*").alias(name)).where(F.col(name) > size)
    large = common.written(spark, of(nodes, ["m1"], "c1"), "ngram-large")
    wide = nodes.join(large, "m1", "left")
    second = common.written(spark, of(wide.where("c1 is not null"), ["m1", "m2"], "c2"), "ngram-large-second")
    wide = wide.join(second, ["m1", "m2"], "left")
    part = lambda by, c: F.pmod(F.xxhash64(by), F.ceil(F.col(c) / size))
    inner = F.when(F.col("c2").isNotNull(), F.struct(F.col("m2").alias("m2"), part("node", "c2").alias("part")))
    inner = inner.when(F.col("c1").isNotNull(), F.struct(F.lit(None).cast("long").alias("m2"), part("m2", "c1").alias("part")))
    return wide.select("node", F.xxhash64("m1", inner["m2"], inner["part"]).alias("gid"), "n")


def _opened(held: list, members: int, percent: int) -> tuple[list[int], list[int]]:
    """Links of a group's members and the sets asked of it; ``held``: (asked, node, label, set), members first."""
    sets = [x[3] for x in held]
    ends: tuple[list[int], list[int]] = ([], [])
    union = np.unique(np.concatenate(sets[:members]))
    asked = []
    for i in range(members, len(sets)):
        own = sets[i]
        at = np.minimum(np.searchsorted(union, own), len(union) - 1)
        if 100 * int((union[at] == own).sum()) >= percent * len(own):  # no member can share more
            asked.append(i)
    rounds = [asked[at : at + 2 * GROUP] for at in range(0, len(asked), 2 * GROUP)] if members < len(held) else [list(range(members))]
    for some in rounds:
        at = some if members == len(held) else [*range(members), *some]
        first = np.array([i < members for i in at])
        second = np.ones(len(at), bool) if members == len(held) else ~first
        a, b = block_links([sets[i] for i in at], first, second, np.array([held[i][2] for i in at]), percent / 100)
        ends[0].extend(held[at[i]][1] for i in a)
        ends[1].extend(held[at[i]][1] for i in b)
    return ends


def similar_sets(spark: SparkSession, rows: DataFrame, k: int = 4, percent: int = 85, size: int = GROUP, shared: int = SHARED, cells: int = CELLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (uid, doc_id, text): marks (uid, doc_id, n, h1, h2); nodes (node, h1, h2, first, own), the
    distinct sets with any token; and roots (node, root) of those that aren't their group's smallest.

    Links are of all pairs of sets with 100 * intersection >= percent * union.  First groups are opened for their
    own members, then each set is asked of the leading group of each of its tokens; what is
    connected by then isn't asked again, the rest of the matrix is joined whole."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, members = [], None, 0

        def settle() -> pa.RecordBatch:
            a, b = _opened(held, members, percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for gid, part, asked, node, label, text in zip(*(batch[c].to_pylist() for c in ("gid", "part", "asked", "node", "label", "text")), strict=True):
                if (gid, part) != now or len(held) >= members + 4 * size and asked:
                    if len(held) > 1:
                        yield settle()
                    if (gid, part) != now:
                        held, now, members = [], (gid, part), 0
                    else:
                        del held[members:]
                held.append((asked, node, label, shingle_set(text, k)))
                members += not asked
        if len(held) > 1:
            yield settle()

    marks = common.written(spark, measured(rows, k, cells), "ngram-marks")
    held = spark.sparkContext.broadcast(frequencies(spark, marks, cells))
    marks = marks.where("uid is not null").select("uid", "doc_id", "n", "h1", "h2", "m1", "m2")
    nodes = marks.where("n > 0").groupBy("h1", "h2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("own"), *[F.first(c).alias(c) for c in ("n", "m1", "m2")])
    nodes = common.written(spark, nodes, "ngram-nodes")
    able = nodes.where(100 * F.col("n") >= percent * (F.col("n") + 1))  # a smaller set is like equal ones only
    groups = common.written(spark, grouped(spark, able.select("node", "n", "m1", "m2"), size), "ngram-groups")
    repeated = nodes.where("own > 1").select("h1", "h2", "node")
    copies = common.written(spark, marks.where("n > 0").join(common.small_side(repeated), ["h1", "h2"]).where("uid != node").select(F.col("uid").alias("node")), "ngram-copies")
    prefixed = prefixes(rows, held, k, percent, shared).withColumnRenamed("uid", "node").join(common.small_side(copies, 1_000_000), "node", "left_anti")
    n_tokens = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * common.tasks(spark), n_tokens * (100 - percent) // (100 * HELD) + 1)
    shared_by = shared_tokens(spark, prefixed, buckets, percent)
    held.destroy()
    both = common.written(spark, shared_by.join(groups, "node").select("token", "node", "short", "gid", "n"), "ngram-posts")
    common.dropped(spark, shared_by)
    many = groups.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1")
    several = groups.join(many, "gid", "left_semi")
    wanted = both.groupBy("node").agg(F.count("*").alias("c")).where(F.col("c") >= shared).select("node").union(several.select("node")).distinct()
    wanted = common.written(spark, wanted.select(F.col("node").alias("uid")), "ngram-wanted")
    texts = rows.select("uid", "text").join(common.small_side(wanted, 1_000_000), "uid", "left_semi")
    texts = common.written(spark, texts.withColumnRenamed("uid", "node"), "ngram-texts")

    def links_of(members: DataFrame, asked: DataFrame | None = None) -> DataFrame:
        """Links in groups (node, gid, label), or of sets asked of them (node, gid, label)."""
        own = members.select("gid", F.lit(0).alias("part"), F.lit(0).alias("asked"), "node", "label")
        if asked is not None:
            parts = asked.groupBy("gid").agg(F.ceil(F.count("*") / (8 * size)).cast("int").alias("parts"))
            own = members.join(parts, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("asked"), "node", "label")
            asked = asked.join(parts, "gid").select("gid", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("asked"), "node", "label")
            own = own.unionByName(asked)
        # texts are wide (their sets are wider still), so that they are dealt out once, by group, if what asks for them is few
        own = texts.join(common.small_side(common.written(spark, own, "ngram-asking")), "node").repartition(common.tasks(spark), "gid", "part").sortWithinPartitions("gid", "part", "asked")
        found = own.select("gid", "part", "asked", "node", "label", "text").mapInArrow(opened, "a long, b long")
        return common.written(spark, found, "ngram-found")

    def labelled(df: DataFrame, roots: DataFrame) -> DataFrame:
        return df.join(roots.select("node", "root"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")

    def unlike(posts: DataFrame, matrix: DataFrame, larger: bool) -> DataFrame:
        """(node, gid, label) of sets and groups of the matrix (token, gid, lo, hi, first, last) that may hold links between labels."""
        pairs = posts.withColumnRenamed("gid", "home").join(matrix, "token")
        pairs = pairs.where((F.col("home") != F.col("gid")) & ((F.col("first") != F.col("label")) | (F.col("last") != F.col("label"))))
        most = F.col("n") if larger else 100 * F.col("n") / percent
        pairs = pairs.where((F.col("lo") <= most) & (percent * F.col("n") <= 100 * F.col("hi")))
        return pairs.groupBy("node", "gid").agg(F.count("*").alias("c"), F.first("label").alias("label")).where(F.col("c") >= shared).select("node", "gid", "label")

    links = links_of(several.withColumn("label", F.col("node")))
    for whole in (False, True):
        roots = components(spark, links)
        tagged = common.written(spark, labelled(both, roots), "ngram-tagged")
        mixed = tagged.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
        tagged = common.written(spark, tagged.join(mixed, "token", "left_semi"), "ngram-mixed")
        matrix = tagged.where("short").groupBy("token", "gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("m"))
        if whole:
            asked = unlike(tagged, matrix, True)
        else:  # the group with most sets of a token, asked by all others
            leader = matrix.groupBy("token").agg(F.max_by(F.struct("gid", "lo", "hi", "first", "last"), F.struct("m", "gid")).alias("one")).select("token", "one.*")
            asked = unlike(tagged.withColumn("gid", F.lit((1 << 63) - 1)), leader, False).join(groups.select("node", F.col("gid").alias("home")), "node").where("home != gid").drop("home")
        asked = common.written(spark, asked, "ngram-asked")
        opening = labelled(groups.join(asked.select("gid").distinct(), "gid", "left_semi"), roots)
        links = links.unionByName(links_of(opening, asked))
    return marks, nodes, components(spark, links)


def similar_groups(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 85, size: int = GROUP, shared: int = SHARED, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``: documents whose sets of k-word shingles have
    a Jaccard similarity of ``percent`` or more, directly or through others, share their smallest doc_id.

    Null, empty or blank text: an empty set, linked with nothing (component_id its own doc_id).  Fewer than k words: the
    whole sequence.  Null doc_id: a document like any other, but it doesn't name a group; a group of such
    documents alone has a null component_id.  Repeated rows: each has its row; ties don't arise, as all links
    count.  Texts are taken whole at any length.  Other columns are ignored; an empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.written(spark, docs.withColumn("uid", F.monotonically_increasing_id()), "ngram-rows")
    marks, nodes, roots = similar_sets(spark, rows, k, percent, size, shared, cells)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.written(spark, named.join(least, "root").select("h1", "h2", "own", "component_id"), "ngram-named")
    found = marks.withColumn("h", F.struct("h1", "h2"))
    linked = common.spread_join(found.where("n > 0"), named.select(F.struct("h1", "h2").alias("h"), "own", "component_id"), "h", "own").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(marks.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all ``documents`` linked at a Jaccard similarity of 0.85 of their 4-word shingles."""
    return similar_groups(spark, common.read_table(spark, sf_dir, "documents"), k=4, percent=85)
