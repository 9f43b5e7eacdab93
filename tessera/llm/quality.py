"""Quality rules whose learned cutoffs have a proven limit on false rejections.

Every rule rejects documents of which one measure exceeds a cutoff.  Cutoffs are chosen
per stratum (language) from labelled documents of that stratum alone.  A cutoff is safe if the
exact binomial tail shows that it rejects at most a share alpha of the stratum's good documents.
A measure's cutoffs are tested from the loosest to the strictest, in an order fixed beforehand,
up to the first that isn't safe: such a sequence needs no correction of its own.  Over strata and
measures the level ``DELTA`` is divided by the number of sequences (Bonferroni), so with
probability 1 - DELTA every chosen cutoff of every stratum keeps its promise.

A stratum's share of false rejections, all measures together, is limited to ``ALPHA`` where its
labels can prove that; with fewer labels to the least share that they could prove, up to
``MOST`` (a function of the number of labels only, so fixed before any is looked at).  A stratum
whose labels can't prove even that has the base rules alone.

All work on documents is in SQL functions; the driver sees one histogram of the labelled
documents (strata x measures x cutoffs).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: White space of the contracts, for SQL functions that take characters or a pattern.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Each measure is a share in per mille; a rule rejects what lies above its cutoff.
MEASURES = ("symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "long_word_share")
#: Share of a stratum's good documents that its learned rules may reject together, at best and at
#: worst (see above), and the chance that this fails anywhere.
ALPHA = 0.018
MOST = 0.12
DELTA = 0.05
CUTOFFS = (5, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)

def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once (a lambda's variable, not its text)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words stand in a window of words that occurs at least twice in the text.

    Windows are compared by a hash of their words' hashes.  Most texts repeat none, which a set of the hashes shows;
    else hashes are sorted with their places, and the windows of repeated ones are laid
    over the words: the time is n log n in the number of words."""

    def covered(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))

        def repeated(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
            twice = F.filter(s, lambda _, i: ((i > 0) & same(i, i - 1)) | same(i, i + 1))
            return F.array_sort(F.transform(twice, lambda x: x["p"]))

        def laid(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(F.array_sort(placed), lambda s: let(repeated(s), laid))

    n = F.size(words)
    own = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
    found = let(let(own, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n > window, found).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and the measures, all from the whole text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    only = lambda pattern: F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))
    share = lambda part, whole: F.coalesce(F.try_divide(1000 * part, whole), F.lit(0.0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = docs.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": only(SYMBOLS).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "_upper": only(r"\p{Lu}"),
        "_marks": only("!?"),
        "_long": F.size(F.filter("_words", lambda w: F.length(w) > 25)),
    })
    return out.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
        "upper_share": share(F.col("_upper"), F.col("word_chars")),
        "mark_share": share(F.col("_marks"), F.col("word_chars")),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("_n_lines")),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "long_word_share": share(F.col("_long"), F.col("n_words")),
    }).drop("_words", "_lines", "_n_lines", "_upper", "_marks", "_long")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exact up to rounding."""
    if k >= n:
        return 1.0
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(term(i)) for i in range(k + 1)))


def measure_alpha(n: int, strata: int) -> float | None:
    """The share of good documents that one measure's rule may reject, for a stratum of n labels:
    an equal part of ``ALPHA``, or else the least that no rejection among n would prove (and a
    hundredth more); None if the measures together would exceed ``MOST``."""
    level = DELTA / (strata * len(MEASURES))
    alpha = max(ALPHA / len(MEASURES), 1.01 * (1 - level ** (1 / n))) if n else 1.0
    return alpha if alpha * len(MEASURES) <= MOST else None


def safe_cutoffs(found: dict[str | None, tuple[int, dict[tuple[str, int], int]]]) -> dict[str | None, dict[str, int]]:
    """Per stratum and measure, the strictest safe cutoff.  ``found``: per stratum the number
    of good documents, and how many of them each (measure, cutoff) rejects."""
    level = DELTA / max(1, len(found) * len(MEASURES))
    out: dict[str | None, dict[str, int]] = {}
    for stratum, (n, rejected) in found.items():
        out[stratum] = {}
        alpha = measure_alpha(n, len(found))
        for m in MEASURES if alpha else ():
            for c in sorted(CUTOFFS, reverse=True):
                # Were the true share above alpha, so few rejections would be seen with a chance of at most ``level``.
                if binomial_tail(rejected.get((m, c), 0), n, alpha) > level:
                    break
                out[stratum][m] = c
    return out


def learned_rules(features: DataFrame, labels: DataFrame) -> dict[str | None, dict[str, int]]:
    """Cutoffs per stratum, of the strata that have labels.

    ``features`` has doc_id, lang, base_failed and the measures; ``labels`` doc_id and
    quality.  A document with several labels is good only if none says otherwise."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1 and doc_id is not null").select("doc_id")
    held = features.where(~F.col("base_failed")).join(good, "doc_id")
    counts = [F.sum((F.col(m) > c).cast("int")).alias(f"{m}_{c}") for m in MEASURES for c in CUTOFFS]
    rows = held.groupBy("lang").agg(F.count("*").alias("n"), *counts).collect()  # one row a stratum
    return safe_cutoffs({r["lang"]: (r["n"], {(m, c): r[f"{m}_{c}"] or 0 for m in MEASURES for c in CUTOFFS}) for r in rows})


def verdict(rules: dict[str | None, dict[str, int]]) -> Column:
    """Whether a measured document stays: false if the base rules or a rule of its stratum reject it."""
    out = F.lit(True)
    for stratum, own in rules.items():
        if own:
            out = F.when(F.col("lang").eqNullSafe(F.lit(stratum)), ~_any([F.col(m) > x for m, x in own.items()])).otherwise(out)
    return ~F.col("base_failed") & out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for all ``documents``, cutoffs learned from ``labels``.

    Null or empty text: no words, so the base rules reject it.  Null lang: a stratum of its
    own.  Null doc_id: measured like any other, never labelled.  Repeated rows: each has its
    row.  Ties: a measure at its cutoff passes.  Very long texts: measured whole, in time n log n.
    No or few labels: the base rules alone.  Other columns: ignored."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    features = common.written(spark, measured(docs).drop("text"), "quality-measures")
    rules = learned_rules(features, common.read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return features.withColumn("kept", verdict(rules)).select(*BASE, "kept")


OP4_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), g as (
  select rid, i, array_to_string(w[i:i + 7], ' ') as g from (select rid, w, unnest(range(1, len(w) - 6)) as i from d where len(w) > 8)
), c as (
  select rid, count(distinct j) as covered from (select rid, unnest(range(i, i + 8)) as j from (select *, count(*) over (partition by rid, g) as n from g) where n > 1) group by rid
), f as (
  select d.rid, doc_id, lang, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines,
         coalesce(covered, 0)::bigint as n_repeat_words, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_upper, length(regexp_replace(text, '[^!?]', '', 'g')) as n_marks,
         len(list_filter(w, lambda x: length(x) > 25)) as n_long
  from d left join c on d.rid = c.rid
), b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f
), v as (
  select rid, doc_id, lang, base_failed, unnest([{'m': 'symbol_share', 'v': coalesce(1000.0::double * n_symbols / nullif(word_chars, 0), 0)}, {'m': 'upper_share', 'v': coalesce(1000.0::double * n_upper / nullif(word_chars, 0), 0)},
    {'m': 'mark_share', 'v': coalesce(1000.0::double * n_marks / nullif(word_chars, 0), 0)}, {'m': 'dup_line_share', 'v': coalesce(1000.0::double * n_dup_lines / nullif(n_lines, 0), 0)},
    {'m': 'repeat_share', 'v': coalesce(1000.0::double * n_repeat_words / nullif(n_words, 0), 0)}, {'m': 'long_word_share', 'v': coalesce(1000.0::double * n_long / nullif(n_words, 0), 0)}], recursive := true)
  from b
), good as (
  select doc_id from labels where doc_id is not null group by 1 having min(quality) = 1
), h as (
  select coalesce(lang, chr(0)) as stratum, m, v from v where not base_failed and doc_id in (select doc_id from good)
), cut as (
  select unnest([5, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900]) as c
), seen as (
  select stratum, m, c, count(*) as n, sum(case when v > c then 1 else 0 end)::bigint as k from h, cut group by all
), levels as (
  select *, 0.05::double / ((select count(distinct stratum) from h) * 6) as level from seen
), tested as (
  select *, greatest(0.018::double / 6, 1.01::double * (1 - power(level, 1.0::double / n))) as alpha from levels
), tail as (
  select *, case when 6 * alpha > 0.12::double or k >= n then 1 else (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(alpha) + (n - i) * ln(1 - alpha))) from (select unnest(range(0, k::bigint + 1)) as i)) end as p from tested
), chosen as (
  select stratum, m, min(case when c > worst then c end) as c from (select *, coalesce(max(case when p > level then c end) over (partition by stratum, m), -1) as worst from tail) group by 1, 2
), judged as (
  select v.rid, bool_or(coalesce(v.v > o.c, false)) as rejected
  from v left join chosen o on o.stratum = coalesce(v.lang, chr(0)) and o.m = v.m group by 1
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept from b join judged on b.rid = judged.rid
"""


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns.

    Rows are measured once and written with their measures, from which the rules are learned
    and which they then filter: writing costs far less than measuring, and rows need no key."""
    rows = common.written(spark, measured(common.boxed(docs, "doc_id", "text", "lang")), "quality-measured")
    rules = learned_rules(rows.select("doc_id", "lang", "base_failed", *MEASURES), labels)
    return common.unboxed(rows.where(verdict(rules)), docs.columns, "doc_id", "text", "lang")
