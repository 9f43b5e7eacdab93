"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of characters given the three before them.  A count of every
4-gram over all training texts is the only thing gathered; lower orders count distinct left
neighbours, as Kneser-Ney asks, and follow from it.  A fitted model holds sorted arrays of
n-gram codes; beside each code stands its interpolated log probability in every language, so
one look-up scores an n-gram in all of them.  A text gets the language of the lowest cross-
entropy per character.  The score is a softmax over languages whose temperature is
calibrated on training rows; ``accepted`` tells if it reaches the cutoff that all but a given
share of correctly labelled training rows reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: 4-grams times languages up to which the model is fitted on the driver and sent to the
#: executors whole; a larger one stays in tables and is joined.  Both give the same results.
MODEL_CELLS = 1 << 22
#: Training rows, at most about, on which temperature and cutoff are calibrated.
CALIBRATION = 2_000
#: Characters after which more text doesn't make the score surer.
SURE_CHARS = 400
#: Distinct 4-grams that a task gathers before it passes its counts on.
HELD = 1 << 20

#: Anything but letters and the marks that stand on them, by Unicode category.
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> str:
    """Lower-cased letters with their marks, all else a single space; one space before and
    after.  Nothing if there is no letter."""
    bare = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {bare} " if LETTER.search(bare) else ""


def grams(text: str) -> np.ndarray:
    """Codes of all 4-grams of prepared text (two spaces stand before it): four 16-bit
    characters each, the last one lowest.  Characters beyond 16 bits share codes by hash."""
    if not text:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(("  " + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    big = c > 0xFFFF
    if big.any():
        c[big] = 0xE000 + c[big] % 0x1900
    return c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (text, lang); a task sums up before it sends."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}
        size = 0

        def settle() -> None:
            for lang, parts in fresh.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    every = np.concatenate([held[lang][0], g])
                    g, back = np.unique(every, return_inverse=True)
                    n = np.bincount(back, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = g, n
            fresh.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (g, n) in held.items():
                for k in range(0, len(g), 50_000):
                    part = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[part])), pa.array(g[part].view(np.int64)), pa.array(n[part])], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = grams(letters(text))
                fresh.setdefault(lang, []).append(own)
                size += len(own)
                if size > 4_000_000:
                    settle()
                    size = 0
                    if sum(len(g) for g, _ in held.values()) > HELD:
                        yield from out()
        settle()
        yield from out()

    return docs.select("text", "lang").mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted codes of 4-grams to 1-grams, and of contexts of 3 to 1 characters; beside each
    a row of log probabilities (or of backoff weights) with a column a language."""

    langs: list[str]
    codes: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    cutoff: float = 0.0

    @staticmethod
    def _find(codes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(codes):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
        return at, codes[at] == asked

    def log_probs(self, asked: np.ndarray) -> np.ndarray:
        """Log probability of each 4-gram's last character in each language."""
        out = np.zeros((len(asked), len(self.langs)))
        left = np.arange(len(asked))
        for order in range(4, 0, -1):
            mask = np.uint64((1 << 16 * order) - 1)
            at, known = self._find(self.codes[4 - order], asked[left] & mask)
            out[left[known]] += self.logs[4 - order][at[known]]
            left = left[~known]
            if not len(left):
                return out
            if order > 1:  # in no language: what each leaves to the shorter context
                at, known = self._find(self.contexts[4 - order], (asked[left] & mask) >> np.uint64(16))
                out[left[known]] += self.backoff[4 - order][at[known]]
        out[left] += self.floor
        return out

    def entropies(self, text: str) -> tuple[np.ndarray, int]:
        """Cross-entropy per character in each language, and the number of characters."""
        asked, n = np.unique(grams(text), return_counts=True)
        total = int(n.sum())
        return -(n @ self.log_probs(asked)) / max(1, total), total

    def score(self, text: str | None) -> tuple[str, float]:
        """The language and the score of a raw text; ``und`` and 0 if it has no letter."""
        bare = letters(text)
        if not bare or not self.langs:
            return "und", 0.0
        h, n = self.entropies(bare)
        p = self.shares(h[None, :], np.array([n]))[0]
        k = int(np.argmin(h))
        return self.langs[k], float(min(1.0, p[k]))

    def shares(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = -h * np.minimum(n, SURE_CHARS)[:, None] / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from the 4-gram codes and counts of each language."""
    langs = sorted(counts)
    levels = []  # per language: codes and counts of orders 4 to 1
    for lang in langs:
        g, n = counts[lang]
        order = np.argsort(g, kind="stable")
        g, n = g[order], n[order].astype(float)
        own = [(g, n)]
        for order in (3, 2, 1):  # distinct left neighbours of each shorter n-gram
            g, left = np.unique(own[-1][0] & np.uint64((1 << 16 * order) - 1), return_counts=True)
            own.append((g, left.astype(float)))
        levels.append(own)
    codes = [np.unique(np.concatenate([own[k][0] for own in levels])) if levels else np.zeros(0, np.uint64) for k in range(4)]
    contexts = [np.unique(codes[k] >> np.uint64(16)) for k in range(3)]
    size = max(1, len(codes[3])) + 1  # characters seen anywhere, and one for all others
    logs = [np.zeros((len(codes[k]), len(langs))) for k in range(4)]
    backoff = [np.zeros((len(contexts[k]), len(langs))) for k in range(3)]
    floor = np.zeros(len(langs))  # of a character seen nowhere
    for col, own in enumerate(levels):
        lower = np.full(len(codes[3]), 1 / size)
        for k in (3, 2, 1, 0):
            g, n = own[k]
            ones, twos = float((n == 1).sum()), float((n == 2).sum())
            cut = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            count = np.zeros(len(codes[k]))
            count[np.searchsorted(codes[k], g)] = n
            if k == 3:
                total, kinds = max(1.0, n.sum()), len(g)
                prob = np.maximum(count - cut, 0) / total + (cut * kinds / total if kinds else 1.0) * lower
                floor[col] = np.log((cut * kinds / total if kinds else 1.0) / size)
            else:
                context = np.searchsorted(contexts[k], codes[k] >> np.uint64(16))
                total = np.bincount(context, count, len(contexts[k]))
                kinds = np.bincount(context, count > 0, len(contexts[k]))
                rest = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
                backoff[k][:, col] = np.log(rest)
                shorter = np.searchsorted(codes[k + 1], codes[k] & np.uint64((1 << 16 * (3 - k)) - 1))
                prob = np.maximum(count - cut, 0) / np.maximum(total, 1)[context] + rest[context] * lower[shorter]
            logs[k][:, col] = np.log(prob)
            lower = prob
    return Model(langs, codes, logs, contexts, backoff, floor)


@dataclass
class Tables:
    """The same model in tables: counts of orders 1 to 4 (lang, gram, n), totals and kinds of
    contexts of orders 2 to 4 (lang, context, total, kinds), and one row a language."""

    own: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    langs: DataFrame
    shape: Model

    def log_probs(self, asked: DataFrame) -> DataFrame:
        """(gram, lang, lp) of each of the distinct 4-grams asked for, in each language."""
        now = asked.crossJoin(F.broadcast(self.langs))
        p = F.lit(1.0) / F.col("size")
        for k in range(1, 5):
            part = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1 if k < 4 else -1))
            counts = common.small_side(self.own[k].select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), "n"))
            now = now.withColumn("p", p).withColumn("_part", part).join(counts, (F.col("lang") == F.col("_lang")) & (F.col("_part") == F.col("_gram")), "left")
            if k > 1:
                context = common.small_side(self.contexts[k].select(F.col("lang").alias("_of"), "context", "total", "kinds"))
                now = now.join(context, (F.col("lang") == F.col("_of")) & (F.shiftrightunsigned("_part", 16) == F.col("context")), "left")
            else:
                now = now.withColumn("total", F.col("total1")).withColumn("kinds", F.col("kinds1"))
            cut = F.col(f"cut{k}")
            seen = F.greatest(F.coalesce("n", F.lit(0.0)) - cut, F.lit(0.0)) / F.col("total") + cut * F.col("kinds") / F.col("total") * F.col("p")
            now = now.withColumn("next", F.when(F.col("total").isNull(), F.col("p")).otherwise(seen)).select("gram", *self.langs.columns, F.col("next").alias("p"))
            p = F.col("p")
        return now.select("gram", "lang", F.log("p").alias("lp"))

    def entropies(self, spark: SparkSession, docs: DataFrame) -> DataFrame:
        """(t, found, chars) of each distinct text with letters, by its hash t: an array of
        (cross-entropy per character, lang), and the number of characters."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t, text in zip(batch["t"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    g, n = np.unique(grams(letters(text)), return_counts=True)
                    if len(g):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), t)), pa.array(g.view(np.int64)), pa.array(n)], names=["t", "gram", "n"])

        own = docs.select(F.xxhash64("text").alias("t"), "text").mapInArrow(work, "t long, gram long, n long").dropDuplicates(["t", "gram"])
        own = common.written(spark, own, "language-pieces")
        probs = common.written(spark, self.log_probs(own.select("gram").distinct()), "language-probs")
        sums = own.join(probs, "gram").groupBy("t", "lang").agg(F.sum(F.col("n") * F.col("lp")).alias("s"), F.sum("n").alias("chars"))
        found = sums.groupBy("t").agg(F.sort_array(F.collect_list(F.struct((-F.col("s") / F.col("chars")).alias("h"), "lang"))).alias("found"), F.first("chars").alias("chars"))
        return common.written(spark, found, "language-entropies")


def tabled(spark: SparkSession, counts: DataFrame) -> Tables:
    """Interpolated Kneser-Ney as ``fit`` has it, by aggregations over all n-grams."""
    own = {4: counts.select("lang", "gram", F.col("n").cast("double").alias("n"))}
    for k in (3, 2, 1):
        short = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        own[k] = common.written(spark, own[k + 1].groupBy("lang", short.alias("gram")).agg(F.count("*").cast("double").alias("n")), "language-counts")
    contexts = {k: common.written(spark, own[k].groupBy("lang", F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("n").alias("total"), F.count("*").cast("double").alias("kinds")), "language-contexts") for k in (4, 3, 2)}
    size = own[1].select("gram").distinct().count() + 1
    langs = None
    for k in range(1, 5):
        ones, twos = (F.sum(F.when(F.col("n") == x, 1.0).otherwise(0.0)) for x in (1, 2))
        cut = F.when(ones > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), ones / F.greatest(ones + 2 * twos, F.lit(1.0))))).otherwise(0.5).alias(f"cut{k}")
        more = [F.sum("n").alias("total1"), F.count("*").cast("double").alias("kinds1")] if k == 1 else []
        row = own[k].groupBy("lang").agg(cut, *more)
        langs = row if langs is None else langs.join(row, "lang")
    langs = common.written(spark, langs.withColumn("size", F.lit(float(size))), "language-langs")
    names = sorted(r["lang"] for r in langs.select("lang").collect())
    return Tables(own, contexts, langs, Model(names, [], [], [], [], np.zeros(len(names))))


def calibrate(model: Model, h: np.ndarray, size: np.ndarray, want: np.ndarray, reject: float) -> None:
    """Sets temperature and cutoff by rows' entropies, numbers of characters and languages."""
    best = np.inf
    for t in 2.0 ** np.arange(-2, 9):
        model.temperature, before = float(t), model.temperature
        p = model.shares(h, size)[np.arange(len(want)), want]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if loss < best:
            best = loss
        else:
            model.temperature = before
    p = model.shares(h, size)
    right = p.argmax(axis=1) == want
    model.cutoff = float(np.quantile(p.max(axis=1)[right], reject)) if right.any() else 0.0


def train(spark: SparkSession, rows: DataFrame, cells: int = MODEL_CELLS, reject: float = 0.01) -> Model | Tables:
    """The model of rows with text and non-null lang, calibrated on some of them."""
    counts = common.written(spark, gram_counts(rows), "language-grams")
    held = counts.count() * counts.select("lang").distinct().count() <= cells
    if held:
        table = counts.toArrow()
        lang, gram, n = (table[c].to_numpy() for c in ("lang", "gram", "n"))
        model = shape = fit({x: (gram[lang == x].view(np.uint64), n[lang == x]) for x in sorted(set(lang.tolist()))})
    else:
        model = tabled(spark, counts)
        shape = model.shape
    if shape.langs:
        total = rows.count()
        some = rows.where(F.pmod(F.xxhash64("text"), F.lit(max(1, total // CALIBRATION))) == 0).select("text", "lang").limit(2 * CALIBRATION)
        if held:
            found = [(*model.entropies(letters(r["text"])), shape.langs.index(r["lang"])) for r in some.collect() if letters(r["text"]) and r["lang"] in shape.langs]
        else:
            some = common.written(spark, some, "language-sample")
            known = model.entropies(spark, some).join(some.select(F.xxhash64("text").alias("t"), "lang"), "t").collect()
            found = [(np.array([x["h"] for x in sorted(r["found"], key=lambda x: shape.langs.index(x["lang"]))]), r["chars"], shape.langs.index(r["lang"])) for r in known if r["lang"] in shape.langs]
        if found:
            calibrate(shape, np.stack([x[0] for x in found]), np.array([x[1] for x in found]), np.array([x[2] for x in found]), reject)
    return model


def identify(spark: SparkSession, docs: DataFrame, model: Model | Tables) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if isinstance(model, Tables):
        m = model.shape
        found = model.entropies(spark, rows).withColumnRenamed("t", "_t")
        scale = F.least("chars", F.lit(SURE_CHARS)) / F.lit(m.temperature)
        score = 1 / F.aggregate("found", F.lit(0.0), lambda total, x: total + F.exp((F.col("found")[0]["h"] - x["h"]) * scale))
        found = found.select("_t", F.col("found")[0]["lang"].alias("lang_pred"), F.least(F.lit(1.0), score).alias("score"))
        out = rows.select("doc_id", F.xxhash64("text").alias("t")).join(found, F.col("t") == F.col("_t"), "left")
        out = out.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))
        return out.withColumn("accepted", F.col("score") >= max(m.cutoff, 1e-12))
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.score(x) for x in batch["text"].to_pylist()]
            score = np.array([s for _, s in found], float)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x for x, _ in found], pa.string()), pa.array(score), pa.array(score >= max(m.cutoff, 1e-12))], names=["doc_id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all ``documents``, learned from those whose crc32(doc_id) mod 5 isn't 0.

    Null text or no letter: ``und``, score 0.  Null lang: predicted, not learned from.  Null
    doc_id: predicted, neither held out nor learned from.  Repeated rows: each has its row.
    Ties: of languages of equal cross-entropy the first by name.  Very long texts: whole, by
    their distinct 4-grams.  No labelled row: all are ``und``."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(spark, docs.where((fold != 0) & F.col("lang").isNotNull()))
    out = identify(spark, docs, model)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
