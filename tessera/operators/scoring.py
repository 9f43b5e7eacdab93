"""Linear scores of clipped z-scores without making the matrix dense.

score(c) = b + sum_g w_g z0_g + sum over the cell's non-zeros of w_g (z_cg - z0_g), where
z0_g is the z-score of an implicit zero.  It costs a pass over the non-zeros, is exact with
clipping, and right for cells without counts and for genes that the data lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N

from . import matrix as M


def linear_sparse(counts: DataFrame, cells: DataFrame, stats: DataFrame, weights: DataFrame, bias: float = 0.0, log: bool = True, use_zscore: bool = True, normalize_over: str = "all") -> DataFrame:
    """(cell_id, score, p); ``weights`` has gene_id and w; a gene without weight counts for nothing."""
    model = stats.join(weights, "gene_id").withColumn("z0", N.zscore(F.lit(0.0), F.col("mu"), F.col("sigma")) if use_zscore else F.lit(0.0))
    base = model.agg(F.coalesce(F.sum(F.col("w") * F.col("z0")), F.lit(0.0)).alias("base"))
    z = M.preprocess(counts, model, log=log, use_zscore=use_zscore, normalize_over=normalize_over)
    own = z.groupBy("cell_id").agg(F.sum(F.col("w") * (F.col("z") - F.col("z0"))).alias("own"))
    rows = cells.select("cell_id").join(own, "cell_id", "left").crossJoin(F.broadcast(base))  # one row
    score = F.lit(bias) + F.col("base") + F.coalesce("own", F.lit(0.0))
    return rows.select("cell_id", score.alias("score"), N.sigmoid(score).alias("p"))


def linear_dense(entries: DataFrame, stats: DataFrame, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """(cell_id, score, p) of one row an element (cell_id, gene_idx, z)."""
    model = stats.join(weights, "gene_idx")
    z = entries.join(model, "gene_idx").withColumn("s", F.col("w") * N.zscore(F.col("z"), F.col("mu"), F.col("sigma")))
    score = F.col("own") + F.lit(bias)
    return z.groupBy("cell_id").agg(F.sum("s").alias("own")).select("cell_id", score.alias("score"), N.sigmoid(score).alias("p"))


def softmax(rows: DataFrame, key: str, logit: str, out: str = "p") -> DataFrame:
    """Probabilities of a row's classes (one row a class), without overflow."""
    own = Window.partitionBy(key)
    e = rows.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(own)))
    return e.withColumn(out, F.col("_e") / F.sum("_e").over(own)).drop("_e")
