"""Packing token sequences by cutting-stock column generation.

A document's whole multiples of the sequence length fill sequences of their own; what
remains of it is an item.  Items fall in classes by length (steps of 16 tokens, so 256
classes for 4096).  The histogram of classes, a few hundred counts, is all that the driver
sees: a linear program over patterns (how many items of each class share a sequence) is
solved by column generation, a knapsack dynamic program pricing new patterns, its rounded
solution is completed by first-fit decreasing.  Spark then ranks the items of each class
and hands ranks to the patterns' places.  Items of patterns that stay too empty, which no
choice of whole items can avoid, form one stream that is cut at sequence borders; the
stream's last part is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

LENGTH = 4096
STEP = 16
#: A pattern with more free steps than this goes to the stream.
FREE = 2


def cutting_stock(demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns (items of each size 1..len(demand)) and how often each is used, covering
    ``demand`` exactly with sums of sizes of at most ``capacity``.

    Revised simplex over the classes in demand; a new column is the best knapsack of the
    current prices.  Fractions are rounded down, what remains goes first-fit decreasing."""
    sizes = np.flatnonzero(demand > 0) + 1
    if not len(sizes):
        return []
    need = demand[sizes - 1].astype(float)
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    cost = np.ones(m)
    for step in range(rounds):
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
        price = cost @ inverse
        worst = int(np.argmin(price))
        if price[worst] < -1e-9:  # a surplus column pays
            column, own = np.zeros(m), 0.0
            column[worst] = -1.0
        else:
            column = knapsack(sizes, price, capacity)
            own = 1.0
            if price @ column <= 1 + 1e-7:
                break
        through = inverse @ column
        x = inverse @ need
        ratio = np.full(m, np.inf)
        up = through > 1e-9
        ratio[up] = np.maximum(x[up], 0) / through[up]
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], cost[out] = column, own
        pivot = inverse[out] / through[out]
        inverse = inverse - np.outer(through, pivot)
        inverse[out] = pivot
    x = np.linalg.solve(basis, need)
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-x):
        if cost[k] and x[k] >= 1:
            pattern = np.zeros(len(demand), np.int64)
            pattern[sizes - 1] = np.rint(basis[:, k]).astype(np.int64)
            used = pattern > 0
            times = min(int(x[k] + 1e-6), int((left[used] // pattern[used]).min()))
            if times > 0:
                plan.append((pattern, times))
                left -= pattern * times
    while left.any():  # first-fit decreasing: each round fills one pattern and repeats it as often as it can
        pattern, room = np.zeros(len(demand), np.int64), capacity
        for size in np.flatnonzero(left)[::-1] + 1:
            n = min(int(left[size - 1]), room // int(size))
            pattern[size - 1] = n
            room -= n * int(size)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """How many items of each size give the highest sum of prices within capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = int(np.searchsorted(sizes, c, side="right"))
        best[c] = best[c - 1]
        if fit:
            worth = best[c - sizes[:fit]] + price[:fit]
            k = int(np.argmax(worth))
            if worth[k] > best[c] + 1e-12:
                best[c], pick[c] = worth[k], k
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return column


def tokenized(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(part, uid, doc_id, n, ids), written: the ids of every whole text (null: empty) and
    ``end``.  ``uid`` numbers rows within ``part``, so that repeated or null doc_ids stay apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, tok = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        kind = "<u2" if tok.tok.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                ids = tok.encode(some["text"].to_pylist(), end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part)), pa.array((np.int64(part) << 33) + np.arange(at, at + len(ids))), some["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids], pa.binary())],
                    names=["part", "uid", "doc_id", "n", "ids"],
                )
                at += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.written(spark, rows.mapInArrow(work, "part long, uid long, doc_id long, n long, ids binary"), "packing-ids")


def placed(spark: SparkSession, lengths: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces (uid, start, length, sequence_id, offset) of rows (part, uid, n)."""
    step = STEP if length % STEP == 0 and length > STEP else 1
    rows = lengths.withColumn("whole", F.floor(F.col("n") / length).cast("long")).withColumn("rest", F.col("n") % length)
    rows = rows.withColumn("size", F.ceil(F.col("rest") / step).cast("int"))
    items = rows.where("rest > 0")
    demand = np.zeros(length // step, np.int64)
    for r in items.groupBy("size").count().collect():  # one row a class
        demand[r["size"] - 1] = r["count"]
    places, sequences, streamed = [], 0, []
    at = np.zeros(len(demand), np.int64)  # next rank of each class
    for pattern, times in cutting_stock(demand, length // step):
        sizes = np.flatnonzero(pattern)
        full = int((pattern[sizes] * (sizes + 1)).sum()) >= length // step - FREE
        slot = 0
        for k in sizes[::-1]:
            n = int(pattern[k])
            end = int(at[k]) + n * times
            places.append((int(k) + 1, int(at[k]), end, n, slot, sequences if full else -1))
            at[k] = end
            slot += n
        sequences += times if full else 0

    # Ranks of the items of a class: inside a slice, after the items of the slices before.
    slices = items.groupBy("size", "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("size", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("size", "part").orderBy("uid")) - 1
    ranked = items.withColumn("inside", inside).join(slices, ["size", "part"]).withColumn("rank", F.col("base") + F.col("inside"))
    plan = spark.createDataFrame(places or [(0, 0, 0, 1, 0, -1)], "size int, first long, past long, each long, slot long, base_sequence long")
    given = ranked.drop("base", "inside").join(F.broadcast(plan), "size").where("rank >= first and rank < past")  # a plan of a few thousand rows at most
    given = common.written(spark, given.select("part", "uid", "n", "whole", "rest", "each", "slot", "base_sequence", (F.col("rank") - F.col("first")).alias("nth")), "packing-ranks")

    start = F.col("whole") * length
    fixed = given.where("base_sequence >= 0").withColumn("sequence_id", F.col("base_sequence") + F.floor(F.col("nth") / F.col("each")).cast("long"))
    fixed = fixed.withColumn("slot", F.col("slot") + F.col("nth") % F.col("each"))
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fixed = fixed.select("uid", start.alias("start"), F.col("rest").alias("length"), "sequence_id", F.coalesce(F.sum("rest").over(ahead), F.lit(0)).alias("offset"))

    loose = given.where("base_sequence < 0")
    total = loose.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    last = total // length * length
    tail, begin = [], last
    for b in range(length.bit_length() - 1, -1, -1):  # what ends the stream, in powers of two
        if (total - last) >> b & 1:
            tail.append((begin, begin + (1 << b)))
            begin += 1 << b
    loose = common.running(loose, "part", ["uid"], "rest", "from").withColumn("to", F.col("from") + F.col("rest"))
    chunk = F.explode(F.sequence(F.floor(F.col("from") / length).cast("long"), F.floor((F.col("to") - 1) / length).cast("long")))
    pieces = loose.select("uid", start.alias("start"), "from", "to", chunk.alias("chunk"))
    parts = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(sequences + last // length + k).cast("long").alias("id")) for k, (a, b) in enumerate(tail)]) if tail else F.array().cast("array<struct<a:bigint,b:bigint,id:bigint>>")
    own = F.array(F.struct((F.col("chunk") * length).alias("a"), ((F.col("chunk") + 1) * length).alias("b"), (F.col("chunk") + sequences).alias("id")))
    pieces = pieces.withColumn("at", F.explode(F.when(F.col("chunk") < last // length, own).otherwise(parts)))
    lo, hi = F.greatest("from", "at.a"), F.least("to", "at.b")
    pieces = pieces.where(lo < hi).select("uid", (F.col("start") + lo - F.col("from")).alias("start"), (hi - lo).alias("length"), F.col("at.id").alias("sequence_id"), (lo - F.col("at.a")).alias("offset"))

    taken = sequences + last // length + len(tail)
    wholes = common.running(rows.where("whole > 0").select("part", "uid", "whole"), "part", ["uid"], "whole", "first")
    wholes = wholes.select("uid", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k"))
    wholes = wholes.select("uid", (F.col("k") * length).alias("start"), F.lit(length).cast("long").alias("length"), (F.col("first") + F.col("k") + taken).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return fixed.unionByName(pieces).unionByName(wholes)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, sequence_id, offset, doc_tokens and its ids
    (binary, little-endian unsigned 32-bit).

    Null text: the end id alone.  Null or repeated doc_id: each row a document of its own.
    Very long texts: sequences of their own, then an item.  Empty table: no rows."""
    tokens = tokenized(spark, docs, tokenizer, end)
    where = placed(spark, tokens.select("part", "uid", "n"), length)
    own = where.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))  # a document's: its tokens over 4096, and a few

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "sequence_id", "offset", "doc_tokens", "ids"]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<u4" if len(r["ids"]) == 4 * r["n"] else "<u2").astype("<u4")
                rows += [(r["doc_id"], p["start"], p["length"], p["sequence_id"], p["offset"], r["n"], ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in r["pieces"]]
            for k in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1000], strict=True), kinds, strict=True)], names=names)

    joined = tokens.select("uid", "doc_id", "n", "ids").join(own.hint("shuffle_hash"), "uid").drop("uid")
    return joined.mapInArrow(cut, "doc_id long, start long, length long, sequence_id long, offset long, doc_tokens long, ids binary")


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Packs all ``documents`` into sequences of 4096; see ``pack``."""
    import public_tokenizers

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack(spark, docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
