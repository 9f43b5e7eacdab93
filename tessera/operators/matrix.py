"""Operators on long-form count matrices (cell_id, gene_id, value; zeros implicit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N


def slice_rows(rows: DataFrame, chosen: DataFrame | None, key: str = "cell_id") -> DataFrame:
    """Rows whose key is among ``chosen``; all rows if there is no choice."""
    return rows if chosen is None else rows.join(chosen.select(key), key, "left_semi")


def align(counts: DataFrame, target: DataFrame) -> DataFrame:
    """Counts in the order of a fitted gene list: genes that it lacks go, genes that the data
    lack stay implicit zeros."""
    return counts.join(target.select("gene_id", "gene_idx"), "gene_id")


def align_dense(rows: DataFrame, places: list[int]) -> DataFrame:
    """Arrays ``x`` gathered by place, -1 (or beyond the end) giving zero."""
    at = F.array(*[F.lit(p) for p in places])
    return rows.withColumn("x", F.transform(at, lambda i: F.coalesce(F.when(i >= 0, F.get("x", i)), F.lit(0.0))))


def index_map(target: DataFrame, genes: DataFrame) -> DataFrame:
    """For each target gene its index in the data, -1 if the data lack it."""
    own = genes.select("gene_id", F.col("gene_idx").alias("data_idx"))
    return target.join(own, "gene_id", "left").withColumn("data_idx", F.coalesce("data_idx", F.lit(-1).cast("long")))


def gene_diff(target: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes that the data lack (missing) and genes that the target lacks (superfluous)."""
    missing = target.join(genes, "gene_id", "left_anti").select(F.lit("missing").alias("kind"), "gene_id")
    extra = genes.join(target, "gene_id", "left_anti").select(F.lit("superfluous").alias("kind"), "gene_id")
    return missing.unionByName(extra)


def gene_overlap(target: DataFrame, genes: DataFrame) -> DataFrame:
    return target.select("gene_id").intersect(genes.select("gene_id"))


def require_genes(genes: DataFrame, names: list[str] | list[int]) -> DataFrame:
    """The genes of a subset by name or by index; an empty subset, an unknown name and an index
    out of range are errors."""
    if not names:
        raise ValueError("gene subset is empty")
    if all(isinstance(x, int) for x in names):
        found = genes.where(F.col("gene_idx").isin(names))
        lost = sorted(set(names) - {r["gene_idx"] for r in found.select("gene_idx").collect()})
        if lost:
            raise ValueError(f"gene indices out of range: {lost}")
        return found
    found = genes.where(F.col("gene_name").isin(names))
    unknown = sorted(set(names) - {r["gene_name"] for r in found.select("gene_name").collect()})
    if unknown:
        raise ValueError(f"unknown genes: {unknown}")
    return found


def row_sums(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, total); with ``cells``, also those without counts, at 0."""
    sums = counts.groupBy("cell_id").agg(F.sum("value").alias("total"))
    if cells is None:
        return sums
    return cells.select("cell_id").join(sums, "cell_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def row_normalize(counts: DataFrame, target: float = N.TARGET_SUM, log: bool = False) -> DataFrame:
    """Every cell scaled to ``target`` (a sum that isn't positive: unscaled), then log1p if asked.

    One shuffle by cell_id; a filter on genes that follows stays above the cell's sum."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    z = F.col("value") * N.scaling_factor(total, target)
    return counts.withColumn("z", F.log1p(z) if log else z)


def row_normalize_dense(rows: DataFrame, target: float = N.TARGET_SUM) -> DataFrame:
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    factor = N.scaling_factor(F.col("_total"), target)
    return rows.withColumn("_total", total).withColumn("_f", factor).withColumn("z", F.transform("x", lambda v: v * F.col("_f"))).drop("_total", "_f")


def gene_moments(normalized: DataFrame, value: str = "z") -> DataFrame:
    """(gene_id, s, ss): sums of values and squares over the non-zeros; partial sums merge."""
    return normalized.groupBy("gene_id").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))


def gene_stats(moments: DataFrame, genes: DataFrame, n_cells: DataFrame) -> DataFrame:
    """(gene_id, gene_idx, mu, sigma) over all cells, zeros counted: the mean, and the
    population deviation with variance floored at 0.  ``n_cells`` is one row with ``n``, the
    number of cells, which the non-zeros don't tell."""
    rows = genes.join(moments, "gene_id", "left").crossJoin(F.broadcast(n_cells.limit(1)))  # one row
    mu = F.coalesce(F.try_divide(F.coalesce("s", F.lit(0.0)), "n"), F.lit(0.0))
    rows = rows.withColumn("mu", mu)
    var = F.coalesce(F.try_divide(F.coalesce("ss", F.lit(0.0)), "n"), F.lit(0.0)) - F.col("mu") * F.col("mu")
    return rows.withColumn("sigma", F.sqrt(F.greatest(var, F.lit(0.0)))).select("gene_id", "gene_idx", "mu", "sigma")


def fit_stats(counts: DataFrame, genes: DataFrame, cells: DataFrame, log: bool = False, target: float = N.TARGET_SUM) -> DataFrame:
    """The fitted schema of ``counts``: per gene, mean and deviation of normalised values."""
    return gene_stats(gene_moments(row_normalize(counts, target, log)), genes, cells.agg(F.count("*").alias("n")))


def preprocess(counts: DataFrame, stats: DataFrame, log: bool = True, use_zscore: bool = True, normalize_over: str = "target", target: float = N.TARGET_SUM) -> DataFrame:
    """Aligned, normalised and z-scored non-zeros (cell_id, gene_id, gene_idx, value, z).

    ``normalize_over``: a cell's sum is over the fitted genes ('target') or over all genes of
    the data ('all')."""
    if normalize_over not in ("target", "all"):
        raise ValueError(f"normalize_over: {normalize_over}")
    if normalize_over == "target":
        rows = row_normalize(counts.join(stats, "gene_id"), target, log)
    else:
        rows = row_normalize(counts, target, log).join(stats, "gene_id")
    return rows.withColumn("z", N.zscore(F.col("z"), F.col("mu"), F.col("sigma"))) if use_zscore else rows


def zero_values(stats: DataFrame) -> DataFrame:
    """Per gene, the z-score of an implicit zero."""
    return stats.select("gene_id", "gene_idx", N.zscore(F.lit(0.0), F.col("mu"), F.col("sigma")).alias("z0"))


def explode_dense(rows: DataFrame, array: str = "x", out: str = "x") -> DataFrame:
    """One row an array element: (…, gene_idx, value)."""
    keep = [c for c in rows.columns if c != array]
    return rows.select(*keep, F.posexplode(array).alias("gene_idx", out))


def mask_counts(counts: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """Each non-zero entry dropped with a probability of ``rate``, by a hash of its place."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "cell_id", "gene_id")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return counts.where(u >= rate)


def add_noise(rows: DataFrame, std: float, seed: int = 1, value: str = "z") -> DataFrame:
    """Gaussian noise on a column (training only)."""
    return rows.withColumn(value, F.col(value) + std * F.randn(seed))


def category_codes(cells: DataFrame, feature: str, order: str = "cell_id") -> DataFrame:
    """(feature, category, code) by first appearance; null is the category 'nan'."""
    first = cells.groupBy(F.coalesce(F.col(feature).cast("string"), F.lit("nan")).alias("category")).agg(F.min(order).alias("first"))
    code = (F.row_number().over(Window.orderBy("first", "category")) - 1).cast("long")  # as many rows as categories
    return first.select(F.lit(feature).alias("feature"), "category", code.alias("code"))


def encode(cells: DataFrame, codes: DataFrame, feature: str, on_unknown: str = "minus_one") -> DataFrame:
    """Adds ``<feature>_code``: an unknown category is -1 ('minus_one') or 0 ('first')."""
    if on_unknown not in ("minus_one", "first"):
        raise ValueError(f"on_unknown: {on_unknown}")
    own = codes.where(F.col("feature") == feature).select(F.col("category").alias("_c"), F.col("code").alias(f"{feature}_code"))
    out = cells.join(own, F.coalesce(F.col(feature).cast("string"), F.lit("nan")) == F.col("_c"), "left").drop("_c")
    return out.withColumn(f"{feature}_code", F.coalesce(f"{feature}_code", F.lit(-1 if on_unknown == "minus_one" else 0).cast("long")))


def one_hot(cells: DataFrame, codes: DataFrame, feature: str) -> DataFrame:
    """(cell_id, feature, code, hot): a row for each category of the feature; an unknown one is all zeros."""
    coded = encode(cells.select("cell_id", feature), codes, feature)
    own = codes.where(F.col("feature") == feature).agg(F.max("code").alias("top"))
    rows = coded.crossJoin(F.broadcast(own))  # one row: the highest code
    rows = rows.select("cell_id", F.lit(feature).alias("feature"), f"{feature}_code", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("code"))
    return rows.select("cell_id", "feature", "code", (F.col(f"{feature}_code") == F.col("code")).cast("int").alias("hot"))


def qc_metrics(counts: DataFrame, marked: DataFrame) -> DataFrame:
    """Per cell: total counts, genes with counts, and percent of counts on marked genes."""
    rows = counts.join(marked.select("gene_id", F.lit(1).alias("m")), "gene_id", "left")
    return rows.groupBy("cell_id").agg(F.sum("value").alias("total_counts"), F.count("*").alias("n_genes"), (100 * F.sum(F.when(F.col("m") == 1, F.col("value")).otherwise(F.lit(0.0))) / F.sum("value")).alias("pct_marked"))


def qc_filter_cells(qc: DataFrame, min_genes: int, max_marked: float) -> DataFrame:
    return qc.where((F.col("n_genes") >= min_genes) & (F.col("pct_marked") < max_marked)).select("cell_id")


def qc_filter_genes(counts: DataFrame, kept_cells: DataFrame, min_cells: int) -> DataFrame:
    """Genes with counts in enough of the cells that passed (cells are filtered first)."""
    rows = slice_rows(counts, kept_cells)
    return rows.groupBy("gene_id").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
