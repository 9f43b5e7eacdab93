"""Document fingerprints: bottom-k sketches of word shingles.

A sketch keeps the k smallest distinct hashes of a text's shingles (all of them if there
are fewer), which makes it a uniform sample of the set.  Sketches of parts merge to that of
the whole; two of them estimate resemblance and containment, one the number of distinct
shingles.  For sets of up to k shingles every figure is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 128
WORDS = 5
SEED = 42
SPAN = float(1 << 64)


class BottomK:
    """The k smallest distinct hashes of a set, in order."""

    def __init__(self, hashes: np.ndarray, k: int = K):
        self.k, self.hashes = k, np.unique(hashes.astype(np.uint64, copy=False))[:k]

    def merged(self, other: BottomK) -> BottomK:
        return BottomK(np.concatenate([self.hashes, other.hashes]), min(self.k, other.k))

    def distinct(self) -> float:
        """Estimated size of the set."""
        n = len(self.hashes)
        return float(n) if n < self.k else (self.k - 1) * SPAN / float(self.hashes[-1])

    def _shared(self, other: BottomK) -> tuple[int, int]:
        both = self.merged(other).hashes
        return int((np.isin(both, self.hashes) & np.isin(both, other.hashes)).sum()), len(both)

    def resemblance(self, other: BottomK) -> float:
        """Estimated shared part of the union; two empty sets are alike."""
        shared, n = self._shared(other)
        return shared / n if n else 1.0

    def containment(self, other: BottomK) -> float:
        """Estimated part of this set that is in the other; an empty set is contained."""
        own = self.distinct()
        if not own:
            return 1.0
        both = self.merged(other)
        return min(1.0, self.resemblance(other) * both.distinct() / own)

    def dumps(self) -> str:
        return base64.b64encode(self.k.to_bytes(4, "little") + self.hashes.astype("<u8").tobytes()).decode()

    @classmethod
    def loads(cls, text: str) -> BottomK:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[4:], "<u8"), int.from_bytes(raw[:4], "little"))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only


def shingle_hashes(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of every run of n words; of the whole sequence if it is shorter."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    own = [b" ".join(words)] if len(words) < n else list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), own), np.uint64, len(own))


def edited(text: str, follows: str) -> tuple[str, int]:
    """The text with its last quarter (rounded down) replaced by as much of another's start,
    and the number of code points kept."""
    cut = len(text) // 4
    return text[: len(text) - cut] + follows[:cut], len(text) - cut


def _both(text: str, follows: str, words: list[bytes], hashes: np.ndarray) -> tuple[str, BottomK]:
    """The edited text and its sketch; shingles of the words that stay aren't hashed again."""
    new, kept = edited(text, follows)
    own = words_of(new)
    same = max(0, len(words_of(text[:kept])) - 1)  # the last of them may go on
    head = max(0, same - WORDS + 1) if len(words) >= WORDS and len(own) >= WORDS else 0
    return new, BottomK(np.concatenate([hashes[:head], shingle_hashes(own[head:])]))


def sketches(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """(doc_id, n_chars, fingerprint, n_distinct) of every whole text (null: empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            found = [BottomK(shingle_hashes(words_of(x), words), k) for x in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(list(map(len, texts)), pa.int64()), pa.array([s.dumps() for s in found], pa.string()), pa.array([s.distinct() for s in found], pa.float64())], names=["doc_id", "n_chars", "fingerprint", "n_distinct"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_chars long, fingerprint string, n_distinct double")


def followed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (slice, doc_id, text, lent) so that within each slice, in order of doc_id, a
    document is followed by the one after it in the whole table; the last one of a slice by a
    ``lent`` row, the first of the next slice (after the last slice: the table's first).

    Slices are cut at quantiles of doc_id, about four to a task.  Null doc_id comes first;
    rows of equal doc_id stand in order of their text's hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = 4 * common.tasks(spark)
    cuts = rows.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("q")).first()["q"]
    cuts = sorted({float(x) for x in cuts or [0]})
    # A document is in the slice of the cuts at or below it; as floats, near ids share a slice, in order.
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    rows = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_x", outputCol="_slice").transform(rows)
    rows = rows.withColumn("slice", F.col("_slice").cast("int")).drop("_x", "_slice")
    order = F.struct(F.when(F.col("doc_id").isNull(), 0).otherwise(1).alias("known"), F.col("doc_id"), F.col("h"))
    firsts = rows.groupBy("slice").agg(F.min(order).alias("o")).orderBy("slice").collect()  # one row a slice
    given = [(r["o"]["doc_id"], r["o"]["h"], firsts[k - 1]["slice"]) for k, r in enumerate(firsts)]
    lent = spark.createDataFrame(given, "lent_id long, lent_h long, lent_to int")
    rows = rows.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("lent_id")) & (F.col("h") == F.col("lent_h")), "left")
    own = F.struct("slice", F.lit(False).alias("lent"))
    both = F.array(own, F.struct(F.col("lent_to").alias("slice"), F.lit(True).alias("lent")))
    out = rows.select("doc_id", "text", "h", F.explode(F.when(F.col("lent_to").isNull(), F.array(own)).otherwise(both)).alias("to"))
    out = out.select("to.slice", "to.lent", "doc_id", "h", "text")
    return out.repartition(common.tasks(spark), "slice").sortWithinPartitions("slice", "lent", F.col("doc_id").asc_nulls_first(), "h").drop("h")


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts, and their likeness.

    Null text: empty, alike to any empty one.  Texts under five words: one shingle.  Null
    doc_id: before all others.  Repeated rows: each is followed by the other.  A lone
    document follows itself.  Empty table: no rows.  Other columns: ignored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None  # the row that waits for the one after it: slice, doc_id, text, words, hashes, sketch
        for batch in batches:
            rows = []
            for at, lent, doc_id, text in zip(*(batch[c].to_pylist() for c in ("slice", "lent", "doc_id", "text")), strict=True):
                if before is not None and before[0] == at and lent and before[2] == text:
                    words, hashes, own = before[3:]
                else:
                    words = words_of(text)
                    hashes = shingle_hashes(words)
                    own = BottomK(hashes)
                if before is not None and before[0] == at:
                    new, mark = _both(before[2], text, before[3], before[4])
                    rows.append((before[1], len(before[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), before[5].dumps(), mark.dumps(), before[5].resemblance(mark), before[5].resemblance(own)))
                before = None if lent else (at, doc_id, text, words, hashes, own)
            for k in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1000], strict=True), kinds, strict=True)], names=names)

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return followed(spark, docs).mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
