"""Text matrices of genes by cells, one file a sample, as counts, cells and genes.

A file's first line names its cells; each other line is a gene and its values.  The driver
reads the first lines only; lines are split where Spark splits files, in any store that
Spark reads, and become non-zeros, so that no task transposes a matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COUNTS = "cell_id string, gene_name string, value double"


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file, or of the first file of a folder."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        names = sorted(x.getPath().toString() for x in fs.listStatus(at) if not x.getPath().getName().startswith(("_", ".")))
        if not names:
            raise ValueError(f"{path} has no files")
        at = jvm.org.apache.hadoop.fs.Path(names[0])
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(at)
    source = fs.open(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(source) if codec else source, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    if line is None:
        raise ValueError(f"{path} is empty")
    return line


def sample_counts(spark: SparkSession, sample: str, path: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(counts, cells) of one sample: cells are named ``<sample>_<cell>``; only non-zeros have rows.

    A cell named twice and a line of another number of values are errors, the second when rows are read."""
    header = first_line(spark, path)
    names = header.split(sep)[1:]
    if len(set(names)) < len(names):
        raise ValueError(f"{path} names a cell twice")
    cells = spark.createDataFrame([(k, f"{sample}_{c}") for k, c in enumerate(names)], "pos int, cell_id string")  # as many as the file has columns
    lines = spark.read.text(path).where((F.col("value") != header) & (F.trim("value") != ""))
    parts = lines.select(F.split("value", f"\\Q{sep}\\E", -1).alias("p"))
    wrong = F.raise_error(F.concat(F.lit(f"{path}: a line of "), F.size("p").cast("string"), F.lit(f" fields instead of {len(names) + 1}")))
    parts = parts.withColumn("p", F.when(F.size("p") == len(names) + 1, F.col("p")).otherwise(wrong.cast("array<string>")))
    long = parts.select(F.get("p", F.lit(0)).alias("gene_name"), F.posexplode(F.slice("p", 2, F.size("p") - 1)).alias("pos", "v")).withColumn("value", F.col("v").cast("double"))
    counts = long.where("value != 0").join(F.broadcast(cells), "pos").select("cell_id", "gene_name", "value")
    return counts, cells.select("cell_id", F.lit(sample).alias("sample"))


def read_samples(spark: SparkSession, paths: dict[str, str], metadata: DataFrame | None = None, sep: str = "\t") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, cells, genes) of several samples' files, whose genes may differ: what a sample lacks is zero.

    ``metadata``: a row a cell_id; its columns are attached, cells without a row keep nulls.  Genes are
    numbered by name."""
    if not paths:
        raise ValueError("no samples")
    counts, cells, names = None, None, None
    for sample, path in paths.items():
        own, its_cells = sample_counts(spark, sample, path, sep)
        lines = spark.read.text(path).where(F.trim("value") != "").select(F.substring_index("value", sep, 1).alias("gene_name"), F.col("value").alias("line"))
        genes = lines.where(F.col("line") != first_line(spark, path)).select("gene_name")
        counts, cells = (own, its_cells) if counts is None else (counts.unionByName(own), cells.unionByName(its_cells))
        names = genes if names is None else names.unionByName(genes)
    if metadata is not None:
        cells = cells.join(metadata, "cell_id", "left")
    order = Window.orderBy("gene_name")  # as many rows as genes
    genes = names.distinct().withColumn("gene_idx", (F.row_number().over(order) - 1).cast("long"))
    return counts, cells, genes


def write_sample(counts: DataFrame, path: str, sep: str = "\t") -> None:
    """Counts (cell_id, gene_name, value) as such a file: one line a gene, all cells of the counts as columns, in order.
    For samples whose cells fit a line; a folder of one file, its first line the header.  A cell without
    a name and two values of a gene in a cell are errors."""
    names = counts.agg(F.array_sort(F.collect_set("cell_id")).alias("names"))  # one row, a line's length
    n = names.select(F.size("names").cast("long").alias("n"))
    entries = counts.join(names.select(F.posexplode("names").alias("pos", "cell_id")), "cell_id", "left")
    pos = F.when(F.col("cell_id").isNull(), F.raise_error(F.lit("a cell has no name")).cast("int")).otherwise(F.col("pos"))
    wide = entries.groupBy("gene_name").agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).cast("string").alias("v")))).alias("e"))
    wide = wide.withColumn("before", F.concat(F.array(F.lit(-1)), F.transform("e", lambda x: x["pos"]))).crossJoin(F.broadcast(n))  # one row
    zeros = lambda k: F.repeat(F.lit(f"{sep}0.0"), k.cast("int"))
    twice = F.raise_error(F.concat(F.lit("a cell has two values of gene "), F.col("gene_name"))).cast("string")

    def part(x: Column) -> Column:  # the zeros between two entries and the second one
        gap = x["e"]["pos"] - x["b"] - 1
        return F.when(gap < 0, twice).otherwise(F.concat(zeros(gap), F.lit(sep), x["e"]["v"]))

    pairs = F.arrays_zip(F.col("e"), F.slice("before", 1, F.size("e")).alias("b"))
    line = F.concat(F.array_join(F.transform(pairs, part), ""), zeros(F.col("n") - F.element_at("before", -1) - 1))
    lines = wide.select(F.lit(1).alias("k"), "gene_name", F.concat("gene_name", line).alias("value"))
    header = names.select(F.lit(0).alias("k"), F.lit("").alias("gene_name"), F.concat_ws(sep, F.lit("gene"), F.col("names").cast("array<string>")).alias("value"))
    header.unionByName(lines).repartition(1).sortWithinPartitions("k", "gene_name").select("value").write.mode("overwrite").text(path)
