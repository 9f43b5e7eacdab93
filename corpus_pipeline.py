"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage works on all that the one before it kept and returns the columns that it was
given, whatever their names; ``run`` writes its rows as Parquet in
the shared folder and reads them back, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, lines, mixing, packing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; labels choose the cutoffs.

    Null or empty text: too few words, so rejected.  Null lang: a stratum of its own.  Repeated
    rows, null ids: each row is judged by its text.  Few labels: the base rules alone."""
    labels = common.read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.keep_good(spark, docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document (or line) has, or nearly has.

    Null text: stays null.  Repeated rows of one doc_id and text: one document, each row the
    same.  n_chars is that of the new text."""
    return lines.dedup_lines(spark, docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, 0.8).

    Rows are told apart by a number of their own: different texts of one doc_id both stay,
    repeated rows leave one; null ids come last in a group.  Null and empty texts are one group."""
    return simhash.drop_near(spark, docs, words=5, reach=3, alike=0.8)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null source: a source of its own, the last.  Null or empty text: size 0, a place in the order."""
    return mixing.sampled(spark, docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids; copies of a document are packed apart."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing_sources),
    ("packing", packing_sequences),
]

#: SQL has no XXH64, no tokenizer and no linear program; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``.  Empty table: no rows."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(spark, stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
