"""Scores of a stream of count rows.

The scoring of a cell needs all of its entries, and nothing else: a micro-batch whose rows
are whole cells (``entries``, an array) is scored without state, in append mode.  Entries
that come one by one are gathered by cell under a watermark first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import numeric as N


def score_cells(cells: DataFrame, model: DataFrame, bias: float = 0.0, log: bool = True) -> DataFrame:
    """(cell_id, score, p) of rows (cell_id, entries array<struct<gene_id, value>>), batch or
    stream.  ``model`` has gene_id, mu, sigma and w; it becomes one map, the size of the gene
    list, that every row looks its entries up in."""
    m = model.withColumn("z0", N.zscore(F.lit(0.0), F.col("mu"), F.col("sigma")))
    one = m.agg(F.map_from_entries(F.collect_list(F.struct("gene_id", F.struct("mu", "sigma", "w", "z0")))).alias("_m"), F.sum(F.col("w") * F.col("z0")).alias("_base"))
    rows = cells.crossJoin(F.broadcast(one))  # one row
    total = F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["value"])
    rows = rows.withColumn("_f", N.scaling_factor(total))

    def part(a, e):
        g = F.try_element_at("_m", e["gene_id"])
        z = e["value"] * F.col("_f")
        z = F.log1p(z) if log else z
        return a + F.coalesce(g["w"] * (N.zscore(z, g["mu"], g["sigma"]) - g["z0"]), F.lit(0.0))

    score = F.lit(bias) + F.col("_base") + F.aggregate("entries", F.lit(0.0), part)
    return rows.withColumn("score", score).select("cell_id", "score", N.sigmoid(F.col("score")).alias("p"))


def gathered(entries: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Cells of a stream of (ts, cell_id, gene_id, value): entries of a window, closed by the
    watermark; late ones are dropped."""
    rows = entries.withWatermark("ts", delay).groupBy(F.window("ts", window), "cell_id", "gene_id").agg(F.sum("value").alias("value"))
    return rows.groupBy("window", "cell_id").agg(F.collect_list(F.struct("gene_id", "value")).alias("entries"))


def start(cells: DataFrame, model: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, log: bool = True) -> StreamingQuery:
    """Scores every micro-batch and hands it to ``sink`` with its number; a sink that writes by
    number sees each batch's rows once."""
    return cells.writeStream.foreachBatch(lambda df, n: sink(score_cells(df, model, log=log), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
