"""Token ids on disk as one wavelet matrix per shard.

A wavelet matrix holds a sequence of numbers as bit planes, highest bit first; each plane
puts the numbers with a zero bit before those with a one, in their order.  With counts of
ones at every 512th bit it answers, without unpacking the shard: the token at a place
(``access``), how often a token stands before a place (``rank``), how often at all
(``count``) and where its k-th occurrence is (``select``).

File: ``TWM1``; a header of nine unsigned 64-bit numbers (bits, tokens, documents, slice,
number in the slice, lengths of three compressed tables, planes' length); compressed
tables of document ids, of null ids and of document lengths; then per plane its number of
zeros, its compressed size, the plane.  What follows the last plane is ignored (Spark's
text writer ends a file with a line end).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAGIC = b"TWM1"
HEAD = struct.Struct("<9Q")
BLOCK = 512  # bits between counts of ones

#: Tokens after which a task begins its next shard; a longer document has one of its own.
SHARD_TOKENS = 2_000_000


class WaveletMatrix:
    """Bit planes of a sequence of unsigned numbers."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.bits = planes, zeros, n, len(planes)
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        n = len(ids)
        bits = bits or max(1, int(ids.max()).bit_length() if n else 1)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << b)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            low = now[np.flatnonzero(~one)]
            zeros.append(len(low))
            now = np.concatenate([low, now[np.flatnonzero(one)]])
        return cls(planes, zeros, n)

    def decode(self) -> np.ndarray:
        """All numbers, in order, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above, z = np.empty(self.n, kind), self.zeros[level]
            above[np.flatnonzero(~one)] = now[:z]
            above[np.flatnonzero(one)] = now[z:] | kind(1 << (self.bits - 1 - level))
            now = above
        return now

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        if self._ones is None:
            step = BLOCK // 8
            self._ones = []
            for p in self.planes:
                sums = np.add.reduceat(np.bitwise_count(p), np.arange(0, len(p), step), dtype=np.int64) if len(p) else np.zeros(0, np.int64)
                self._ones.append(np.concatenate([[0], np.cumsum(sums)]))
        block = i // BLOCK
        found, at = int(self._ones[level][block]), block * BLOCK // 8
        part = self.planes[level][at : i // 8]
        found += int(np.bitwise_count(part).sum()) if len(part) else 0
        return found + (int(self.planes[level][i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            one = self.planes[level][i // 8] >> (i % 8) & 1
            value = value << 1 | int(one)
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if one else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of a number before place i."""
        if value >> self.bits or value < 0:
            return 0
        lo, hi = 0, min(max(i, 0), self.n)
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of occurrence k (from 0): the smallest place after which rank exceeds k."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.rank(value, mid + 1) > k else (mid + 1, hi)
        return lo


class Shard:
    """A shard: document ids (None: null), their lengths, and the wavelet matrix of their ids."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix, part: int = 0, number: int = 0):
        self.doc_ids, self.lengths, self.matrix, self.part, self.number = doc_ids, lengths, matrix, part, number

    def dumps(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        ids = pack(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        null = pack(np.array([d is None for d in self.doc_ids], np.uint8).tobytes())
        lengths = pack(np.asarray(self.lengths, "<u8").tobytes())
        planes = b"".join(struct.pack("<2Q", z, len(c)) + c for z, c in zip(self.matrix.zeros, (pack(p.tobytes()) for p in self.matrix.planes), strict=True))
        return MAGIC + HEAD.pack(self.matrix.bits, self.matrix.n, len(self.doc_ids), self.part, self.number, len(ids), len(null), len(lengths), len(planes)) + ids + null + lengths + planes

    @classmethod
    def loads(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        bits, n, docs, part, number, *sizes, _ = HEAD.unpack_from(data, 4)
        unpack = zstandard.ZstdDecompressor().decompress
        at, tables = 4 + HEAD.size, []
        for size, kind in zip(sizes, ("<i8", np.uint8, "<u8"), strict=True):
            tables.append(np.frombuffer(unpack(data[at : at + size]), kind) if docs else np.zeros(0, kind))
            at += size
        planes, zeros = [], []
        for _ in range(bits):
            z, size = struct.unpack_from("<2Q", data, at)
            at += 16
            planes.append(np.frombuffer(unpack(data[at : at + size]), np.uint8))
            zeros.append(z)
            at += size
        ids = [None if gone else int(d) for d, gone in zip(tables[0], tables[1], strict=True)]
        return cls(ids, tables[2].astype(np.int64), WaveletMatrix(planes, zeros, n), part, number)


def write_shards(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end: int | None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every whole text (null: empty), appends ``end``, and writes shards under
    ``path`` in ascending doc_id order (null first; rows of equal id by their text's hash).

    A range partition by doc_id gives each task a run of ids; a task holds one shard at a
    time.  Spark's committer puts the files in place, so a lost task leaves none behind."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, docs, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        tok = encoder(tokenizer)

        def shard() -> pd.DataFrame:
            raw = np.frombuffer(b"".join(ids), "<u4")
            data = Shard(docs, np.array([len(x) // 4 for x in ids], np.uint64), WaveletMatrix.build(raw), part, number).dumps()
            return pd.DataFrame({"data": [data]})

        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.iloc[at : at + 512]
                for d, x in zip(rows["doc_id"].tolist(), tok.encode(rows["text"].tolist(), end), strict=True):
                    docs.append(None if pd.isna(d) else int(d))
                    ids.append(x)
                    size += len(x) // 4
                    if size >= shard_tokens:
                        yield shard()
                        number, docs, ids, size = number + 1, [], [], 0
        if docs:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("decimal(20)").cast("string").alias("doc_id"), "text", F.col("doc_id").alias("_order"))
    rows = rows.repartitionByRange("_order").sortWithinPartitions("_order", F.xxhash64("text")).select("doc_id", "text")
    blobs = rows.mapInPandas(build, "data binary")
    blobs.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards: slice, shard and place in it (their order is that of
    doc_id), doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                s = Shard.loads(bytes(data))
                ids, ends = s.matrix.decode().astype("<u4"), np.cumsum(s.lengths)
                for a in range(0, len(ends), 1000):
                    cut = range(a, min(a + 1000, len(ends)))
                    yield pd.DataFrame({"part": s.part, "shard": s.number, "place": list(cut), "doc_id": pd.array([s.doc_ids[k] for k in cut], "Int64"), "n_tokens": s.lengths[a : a + 1000], "ids": [ids[ends[k] - s.lengths[k] : ends[k]].tobytes() for k in cut]})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, "part long, shard long, place long, doc_id long, n_tokens long, ids binary")


def op6_wavelet_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Writes all ``documents`` as token shards and reads them back.

    Null text: one id, the end id.  Null doc_id: null, before all others.  Repeated rows:
    each its own document.  Empty table: no rows.  Other columns: ignored."""
    import public_tokenizers

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = common.new_path(spark, "token-shards")
    write_shards(spark, docs, path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end=0)
    found = read_documents(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    found = common.written(spark, found, "token-counts")
    out = common.running(found, "part", ["shard", "place"], "n_tokens", "start")
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")
