"""Alignment of two tokenizers' ids over the same bytes, by a dictionary of groups.

Where a token of either tokenizer ends at one byte, a group ends.  A group is written as its
ids, ``a1,a2|b1``; such a text is its key.  Groups recur far more than they are new: a task
interns them and expands each one's links once, then counts for each id pair the documents
that hold it.  The dictionary of all distinct groups gets the sums of its links' counts, once a
group, and documents get theirs by joining their groups' keys back, each with its frequency.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import _byte_letters

#: Words of texts whose groups a Python worker remembers, those met least lately going first; and groups and pairs
#: of ids, after which it hands on what it counted and starts anew.
REMEMBERED = 100_000
INTERNED = 400_000
#: A group with this share of all (document, group) rows is broadcast: at most so many are.
COMMON = 100_000


class Vocabularies:
    """The two tokenizers and the bytes of their ids: A a byte-level BPE of the tokenizers library,
    B a sentencepiece model that adds a space."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {ord(c): b for b, c in _byte_letters().items()}
        self.a_bytes = {i: bytes(letters[ord(c)] for c in token) for token, i in self.a.get_vocab(with_added_tokens=False).items() if all(ord(c) in letters for c in token)}
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        self.a_list, self.b_list = ([own.get(i, b"") for i in range(n)] for own, n in ((self.a_bytes, self.a.get_vocab_size()), (self.b_bytes, len(pieces))))
        self.a_size, self.b_size = (np.array(list(map(len, own)), np.int64) for own in (self.a_list, self.b_list))
        # a space is always a piece's beginning: texts can be cut there
        self.by_words = not any("▁" in p.lstrip("▁") for _, p in pieces) and self.b.encode("x  y") == self.b.encode("x") + self.b.encode(" y")
        self.odd = re.compile(r"^\s| \s| $").search

    def encode(self, texts: list[str]) -> tuple[list[str], list[list[int]], list[list[int]]]:
        """The texts whose ids give the bytes of space + text back, with their A ids (of space + text) and B ids."""
        a, b = [e.ids for e in self.a.encode_batch([" " + x for x in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)
        joined = lambda own, ids: b"".join([own[i] for i in chain.from_iterable(ids)])
        every = "".join([f" {x}" for x in texts]).encode()
        if joined(self.a_list, a) != every or joined(self.b_list, b) != every:
            kept = [k for k, x in enumerate(texts) if joined(self.a_list, [a[k]]) == joined(self.b_list, [b[k]]) == f" {x}".encode()]
            texts, a, b = [texts[k] for k in kept], [a[k] for k in kept], [b[k] for k in kept]
        return texts, a, b

    def groups(self, texts: list[str], a: list[list[int]], b: list[list[int]]):
        """(A ids, ends in them, B ids, ends in them, ends of texts), the groups of all texts in a row: a group ends where
        tokens of both end, and so does every text."""
        flat_a, flat_b = (np.array(list(chain.from_iterable(own)), np.int64) for own in (a, b))
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        bounds = np.cumsum([len(x) + 1 if x.isascii() else len(x.encode()) + 1 for x in texts])
        return flat_a, np.searchsorted(ends_a, both) + 1, flat_b, np.searchsorted(ends_b, both) + 1, np.searchsorted(both, bounds) + 1

    def links(self, key: str) -> list[tuple[int, int]]:
        """(A id, B id) for each two tokens of a group whose bytes overlap: one more at each end inside."""
        a, b = ([int(i) for i in side.split(",")] for side in key.split("|"))
        i = j = 0
        x, y = len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        out = [(a[0], b[0])]
        while x != y:
            if x < y:
                i += 1
                x += len(self.a_bytes[a[i]])
            else:
                j += 1
                y += len(self.b_bytes[b[j]])
            out.append((a[i], b[j]))
        return out


_vocabularies: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """The worker's two tokenizers."""
    if (a_path, b_path) not in _vocabularies:
        _vocabularies[a_path, b_path] = Vocabularies(a_path, b_path)
    return _vocabularies[a_path, b_path]


class Interned:
    """Groups and id pairs that a task has seen, by number, with the documents that hold each."""

    def __init__(self, own: Vocabularies):
        self.own = own
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, np.ndarray | None] = {}  # the groups of a word, in order; None: its bytes don't come back
        self.older: dict[str, np.ndarray | None] = {}
        self.lost = False  # whether there is any such word
        self.number: dict = {}
        self.names: list[str] = []
        self.pair_number: dict[tuple[int, int], int] = {}
        self.pairs: list[int] = []  # of all groups in a row
        self.shape: list[tuple[int, int, int, int]] = []  # A ids, B ids, first pair, distinct pairs
        self.group_docs, self.pair_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.names) > INTERNED or len(self.pair_number) > INTERNED

    def _intern(self, a: tuple[int, ...], b: tuple[int, ...]) -> int:
        """The number of a group; a new one's links are expanded here, once."""
        n = self.number.get((a, b))
        if n is None:
            n = self.number[a, b] = len(self.names)
            self.names.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
            links = {self.pair_number.setdefault(x, len(self.pair_number)) for x in self.own.links(self.names[n])}
            self.shape.append((len(a), len(b), len(self.pairs), len(links)))
            self.pairs += links
        return n

    def _numbers(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> list[np.ndarray]:
        """The groups of each text, by number."""
        if not texts:
            return []
        flat_a, ends_a, flat_b, ends_b, bounds = self.own.groups(texts, a, b)
        from_a, from_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
        out = np.empty(len(ends_a), np.int64)
        single = (ends_a - from_a == 1) & (ends_b - from_b == 1)
        keys, at = np.unique(flat_a[from_a[single]] << 32 | flat_b[from_b[single]], return_inverse=True)
        out[single] = np.array([self._intern((k >> 32,), (k & 0xFFFFFFFF,)) for k in keys.tolist()], np.int64)[at]
        list_a, list_b = flat_a.tolist(), flat_b.tolist()
        for k in np.flatnonzero(~single).tolist():
            out[k] = self._intern(tuple(list_a[from_a[k] : ends_a[k]]), tuple(list_b[from_b[k] : ends_b[k]]))
        ends = bounds.tolist()
        return [out[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, {}
        new = []
        for w in words:
            if w not in self.words:
                if w in self.older:
                    self.words[w] = self.older[w]
                else:
                    new.append(w)
        known, a, b = self.own.encode(new)
        if len(known) < len(new):
            self.words.update(dict.fromkeys(new))
            self.lost = True
        self.words.update(zip(known, self._numbers(known, a, b), strict=True))

    def documents(self, texts: list[str | None]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, hash, keys, times) of each text, None if it has no tokens."""
        own = self.own
        cut = [x.split(" ") if x and own.by_words and not own.odd(x) else None for x in texts]
        self._learn({w for ws in cut if ws for w in ws})
        whole, a, b = own.encode([x for x, ws in zip(texts, cut, strict=True) if x and ws is None])
        whole = dict(zip(whole, self._numbers(whole, a, b), strict=True))
        words = self.words
        found = [[words[w] for w in ws] if ws else [whole.get(x)] if x else [None] for x, ws in zip(texts, cut, strict=True)]
        shape = np.array(self.shape, np.int64).reshape(-1, 4)
        pairs = np.array(self.pairs, np.int64)
        grown = lambda counts, n: np.concatenate([counts, np.zeros(n - len(counts), np.int64)])
        self.group_docs, self.pair_docs = grown(self.group_docs, len(self.names)), grown(self.pair_docs, len(self.pair_number))
        out: list[tuple | None] = []
        for parts in found:
            if parts[0] is None or self.lost and any(x is None for x in parts):
                out.append(None)
                continue
            g = np.concatenate(parts)
            u, times = np.unique(g, return_counts=True)
            n_a, n_b, first, links = shape[u].T
            begin = np.cumsum(links) - links
            self.pair_docs[np.unique(pairs[np.repeat(first - begin, links) + np.arange(int(links.sum()))])] += 1
            self.group_docs[u] += 1
            names = self.names
            text = ";".join([names[k] for k in g.tolist()])
            out.append((int((n_a * times).sum()), int((n_b * times).sum()), len(g), hashlib.sha256(text.encode()).hexdigest(), [names[k] for k in u.tolist()], times.tolist()))
        return out

    def counted(self) -> tuple[list[tuple[str, int]], list[tuple[tuple[int, int], int]]]:
        """(group, documents) and (pair, documents) of all that were met."""
        return list(zip(self.names, self.group_docs.tolist(), strict=True)), list(zip(self.pair_number, self.pair_docs.tolist(), strict=True))


#: Rows of three kinds: a document, a group of the dictionary, an id pair.
SCHEMA = "uid long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, keys array<string>, times array<int>, key string, a int, b int, docs long"


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of ``SCHEMA`` for (uid, doc_id, text): each document, and each task's groups and pairs
    with its documents that hold them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Interned(vocabularies(a_path, b_path))

        def flush() -> Iterator[pa.RecordBatch]:
            for rows, names in zip(seen.counted(), (("key",), ("a", "b")), strict=True):
                rows = [r for r in rows if r[1]]
                for at in range(0, len(rows), 20_000):
                    some = rows[at : at + 20_000]
                    own = {"key": [k for k, _ in some]} if names == ("key",) else {"a": [k[0] for k, _ in some], "b": [k[1] for k, _ in some]}
                    yield _batch(schema, len(some), docs=[n for _, n in some], **own)
            seen.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(seen.documents(part["text"].to_pylist()))
                v = [x or (0, 0, 0, "", [], []) for x in found]
                names = ("n_a", "n_b", "n_groups", "groups_sha256", "keys", "times")
                yield _batch(schema, len(v), uid=part["uid"], doc_id=part["doc_id"], **{c: [x[k] for x in v] for k, c in enumerate(names)})
                if seen.full():
                    yield from flush()
        yield from flush()

    return docs.select("uid", "doc_id", "text").mapInArrow(work, SCHEMA)


def group_sums(spark: SparkSession, rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, own, n_best, count_sum) of each distinct group of rows of ``SCHEMA``: how many of its links
    are the most frequent of their A id, and the sum of its links' counts of documents."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                found = [(k, n, a, b) for k, n in zip(part["key"].to_pylist(), part["own"].to_pylist(), strict=True) for a, b in own.links(k)]
                key, n, a, b = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(n, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["key", "own", "a", "b"])

    pairs = rows.where("a is not null").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    pairs = common.written(spark, pairs, "crosswalk-pairs")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))  # a row an id of A at most
    groups = rows.where("key is not null").groupBy("key").agg(F.sum("docs").alias("own"))
    links = groups.mapInArrow(expand, "key string, own long, a int, b int").join(pairs, ["a", "b"]).join(most, "a")
    return links.groupBy("key").agg(F.first("own").alias("own"), F.sum(F.when(F.col("docs") == F.col("most"), 1).otherwise(0)).alias("n_best"), F.sum("docs").alias("count_sum"))


def crosswalk(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, common_groups: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of (doc_id, text).

    Null or empty text, or one that either tokenizer's bytes don't give back: zeros and ''.
    Null doc_id: a document like any other.  Repeated rows: a document each, and each counts.
    Ties: links that share the highest count of their A id are all best.  Other columns are ignored;
    no documents, no rows.  Texts are taken whole at any length."""
    docs = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.written(spark, aligned(docs, a_path, b_path), "crosswalk-rows")
    sums = common.written(spark, group_sums(spark, rows, a_path, b_path), "crosswalk-groups")
    held = rows.where("uid is not null").select("uid", F.explode(F.arrays_zip("keys", "times")).alias("e")).select("uid", F.col("e.keys").alias("key"), F.col("e.times").alias("times"))
    total = sums.agg(F.sum("own")).first()[0] or 0
    usual = sums.where(F.col("own") * common_groups >= total).select("key", "n_best", "count_sum")  # at most ``common_groups`` rows
    add = [F.sum(F.col("times") * F.col(c)).alias(c) for c in ("n_best", "count_sum")]
    # the rows of usual groups are summed where they are; only the others are shuffled
    held = held.join(F.broadcast(usual), "key", "left").groupBy("uid", F.when(F.col("count_sum").isNull(), F.col("key")).alias("key"))
    held = common.written(spark, held.agg(*add, F.sum("times").alias("times")), "crosswalk-held")
    rare = held.where("key is not null").select("uid", "key", "times").join(sums.where(F.col("own") * common_groups < total), "key")
    each = held.where("key is null").select("uid", "n_best", "count_sum").unionByName(rare.groupBy("uid").agg(*add))
    each = each.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = rows.where("uid is not null").select("uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")  # a group of m + n tokens has m + n - 1
    return own.join(each, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", links, zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of byte_bpe_50k (A) and piece_bpe_32k (B) over all ``documents``."""
    import public_tokenizers

    docs = common.read_table(spark, sf_dir, "documents")
    return crosswalk(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
