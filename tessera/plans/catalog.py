"""The registered queries on count matrices, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators import batching as B
from tessera.operators import matrix as M
from tessera.operators import metrics as E
from tessera.operators import scoring as S
from tessera.operators import split as P
from tessera.operators import training as T
from tessera.sources import tables as D
from tessera.sources.tables import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

r6 = N.r6


def query(oracle: str | None):
    """Registers a query under its name, and its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def R(x: str) -> str:
    return f"round({x}, 6) + 0.0::double"


# Parts of SQL that several queries share.
FACTOR = "case when sum(value) over (partition by cell_id) > 0 then 10000.0::double / sum(value) over (partition by cell_id) else 1.0::double end"
NORM = f"select cell_id, gene_id, value, value * {FACTOR} as z from counts"
NORM_LOG = f"select cell_id, gene_id, value, ln(1 + value * {FACTOR}) as z from counts"
N_CELLS = "(select count(*) from orders)"
STATS = f"select g.gene_id, g.gene_idx, coalesce(s, 0) / {N_CELLS} as mu, sqrt(greatest(coalesce(ss, 0) / {N_CELLS} - pow(coalesce(s, 0) / {N_CELLS}, 2), 0)) as sigma from genes g left join (select gene_id, sum(z) as s, sum(z * z) as ss from norm group by 1) m on g.gene_id = m.gene_id"
Z = "greatest(-6.0::double, least(6.0::double, ({x} - {mu}) / ({sd} + 1e-10::double)))"
DENSE_NORM = "select cell_id, gene_idx, x, x * case when sum(x) over (partition by cell_id) > 0 then 10000.0::double / sum(x) over (partition by cell_id) else 1.0::double end as z from entries"
DENSE_STATS = "select gene_idx, avg(x) as mu, stddev_pop(x) as sigma from entries group by 1"
CELLS_Y = "select *, case when expansion = 'expanded' then 1 else 0 end as y from cells"


def cells_y(spark: SparkSession, d: str) -> DataFrame:
    return D.cells(spark, d).withColumn("y", N.hard_label(F.col("expansion")))


def stats(spark: SparkSession, d: str, log: bool = False) -> DataFrame:
    return M.fit_stats(D.counts(spark, d), D.genes(spark, d), D.read(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id")), log)


def dense_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.explode_dense(D.dense(spark, d).select("cell_id", "x")).groupBy("gene_idx").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"))


def weights(spark: SparkSession, d: str) -> DataFrame:
    """Fixed weights of the demonstration scorer: a function of the gene's index."""
    return D.genes(spark, d).select("gene_id", ((F.col("gene_idx") % 7 - 3) / 20.0).alias("w"))


WEIGHTS = "select gene_id, (gene_idx % 7 - 3) / 20.0::double as w from genes"


# -- Scans, slices, unions ---------------------------------------------------------------


@query(sql("select * from counts", "counts"))
def scan_counts(spark, d):
    return D.counts(spark, d)


@query(sql("select c.* from counts c where exists (select 1 from orders where o_orderkey = cell_id and o_orderstatus = 'F')", "counts"))
def slice_rows(spark, d):
    chosen = D.read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("cell_id"))
    return M.slice_rows(D.counts(spark, d), chosen)


@query(sql("select 'returned_' || l_orderkey as cell_key, l_suppkey as gene_id, sum(l_quantity) as value from lineitem where l_returnflag = 'R' group by 1, 2 union all select 'kept_' || l_orderkey, l_suppkey, sum(l_quantity) from lineitem where l_returnflag <> 'R' group by 1, 2"))
def union_samples(spark, d):
    rows = D.read(spark, d, "lineitem")
    parts = []
    for name, own in (("returned", rows.where("l_returnflag = 'R'")), ("kept", rows.where("l_returnflag <> 'R'"))):
        parts.append(own.groupBy(F.concat(F.lit(name + "_"), "l_orderkey").alias("cell_key"), F.col("l_suppkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value")))
    return parts[0].unionByName(parts[1])


@query("select * from (values ('logistic', 'linear', true), ('svm', 'linear', true), ('gbt', 'trees', true), ('mlp', 'network', true), ('autoencoder', 'network', true)) t(model_type, family, trainable)")
def model_registry(spark, d):
    from tessera.models.registry import FAMILIES

    return spark.createDataFrame([(k, f, True) for k, f in FAMILIES.items()], "model_type string, family string, trainable boolean")


# -- Labels ------------------------------------------------------------------------------


@query(sql("select * from clones", "clones"))
def clone_sizes(spark, d):
    return D.clone_sizes(D.cells(spark, d).select("sample", "clone_id")).select("sample", "clone_id", "clone_id_size", "median_clone_size")


@query(sql("select cell_id, clone_id_size, median_clone_size, expansion from cells", "cells"))
def expansion_label(spark, d):
    return D.cells(spark, d).select("cell_id", "clone_id_size", "median_clone_size", "expansion")


@query(sql("select cell_id, y from y", "cells", y=CELLS_Y))
def hard_labels(spark, d):
    return cells_y(spark, d).select("cell_id", "y")


@query(sql(f"select cell_id, {R('1 / (1 + exp(-2.0::double * (clone_id_size / case when median_clone_size > 0 then median_clone_size else 1 end - 1.5)))')} as y_soft from cells", "cells"))
def soft_labels(spark, d):
    return D.cells(spark, d).select("cell_id", r6(N.soft_label(F.col("clone_id_size"), F.col("median_clone_size"), beta=2.0)).alias("y_soft"))


# -- Genes -------------------------------------------------------------------------------


@query(sql("select c.cell_id, t.gene_idx, c.value from counts c join target t on c.gene_id = t.gene_id", "counts", "target"))
def gene_align(spark, d):
    return M.align(D.counts(spark, d), D.target_genes(spark, d)).select("cell_id", "gene_idx", "value")


@query(sql("select cell_id, j as gene_idx, coalesce(case when 63 - j >= 0 then embedding[64 - j]::double end, 0.0::double) as x from dense, range(0, 70) t(j)", "dense"))
def gene_align_dense(spark, d):
    places = [63 - j if j < 64 else -1 for j in range(70)]
    out = M.explode_dense(M.align_dense(D.dense(spark, d).select("cell_id", "x"), places))
    return out.select("cell_id", F.col("gene_idx").cast("long").alias("gene_idx"), "x")


@query(sql("select t.gene_id, t.gene_idx, coalesce(g.gene_idx, -1) as data_idx from target t left join genes g on t.gene_id = g.gene_id", "target", "genes"))
def gene_index_map(spark, d):
    return M.index_map(D.target_genes(spark, d), D.genes(spark, d))


@query(sql("select 'missing' as kind, gene_id from target where gene_id not in (select gene_id from genes) union all select 'superfluous', gene_id from genes where gene_id not in (select gene_id from target)", "target", "genes"))
def gene_diff(spark, d):
    return M.gene_diff(D.target_genes(spark, d), D.genes(spark, d))


@query(sql("select gene_id from target intersect select gene_id from genes", "target", "genes"))
def gene_overlap(spark, d):
    return M.gene_overlap(D.target_genes(spark, d), D.genes(spark, d))


@query(sql(f"select n.cell_id, n.gene_id, {R('n.z')} as z from norm n join target t on n.gene_id = t.gene_id", "counts", "target", norm=NORM))
def gene_subset_norm(spark, d):
    subset = D.target_genes(spark, d)
    return M.row_normalize(D.counts(spark, d)).join(subset, "gene_id").select("cell_id", "gene_id", r6(F.col("z")).alias("z"))


@query(sql("select c.cell_id, g.gene_name, c.value from counts c join genes g on c.gene_id = g.gene_id", "counts", "genes"))
def gene_id_convert(spark, d):
    return D.counts(spark, d).join(D.genes(spark, d), "gene_id").select("cell_id", "gene_name", "value")


# -- Normalisation -----------------------------------------------------------------------


@query(sql("select o_orderkey as cell_id, coalesce(sum(value), 0) as total from orders left join counts on o_orderkey = cell_id group by 1", "counts"))
def row_sums(spark, d):
    return M.row_sums(D.counts(spark, d), D.read(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id")))


@query(sql(f"select o_orderkey as cell_id, {R('case when coalesce(sum(value), 0) > 0 then 10000.0::double / sum(value) else 1 end')} as factor from orders left join counts on o_orderkey = cell_id group by 1", "counts"))
def scaling_factors(spark, d):
    return row_sums(spark, d).select("cell_id", r6(N.scaling_factor(F.col("total"))).alias("factor"))


@query(sql(f"select cell_id, gene_id, {R('z')} as z from norm", "counts", norm=NORM))
def row_normalize(spark, d):
    return M.row_normalize(D.counts(spark, d)).select("cell_id", "gene_id", r6(F.col("z")).alias("z"))


@query(sql("select cell_id, gene_idx, round(z, 3) + 0.0::double as z from norm", "entries", norm=DENSE_NORM))
def row_normalize_dense(spark, d):
    rows = M.row_normalize_dense(D.dense(spark, d).select("cell_id", "x")).select("cell_id", "z")
    return M.explode_dense(rows, "z", "z").select("cell_id", F.col("gene_idx").cast("long").alias("gene_idx"), (F.round("z", 3) + F.lit(0.0)).alias("z"))


@query(sql(f"select cell_id, gene_id, {R('z')} as z from norm", "counts", norm=NORM_LOG))
def log_normalize(spark, d):
    return M.row_normalize(D.counts(spark, d), log=True).select("cell_id", "gene_id", r6(F.col("z")).alias("z"))


@query(sql(f"select n.cell_id, s.gene_idx, {R(Z.format(x='n.z', mu='s.mu', sd='s.sigma'))} as z from norm n join stats s on n.gene_id = s.gene_id", "counts", "genes", norm=NORM, stats=STATS))
def zscore_sparse(spark, d):
    return M.preprocess(D.counts(spark, d), stats(spark, d), log=False).select("cell_id", "gene_idx", r6(F.col("z")).alias("z"))


@query(sql(f"select cell_id, e.gene_idx, {R(Z.format(x='e.x', mu='s.mu', sd='s.sigma'))} as z from entries e join stats s on e.gene_idx = s.gene_idx", "entries", stats=DENSE_STATS))
def zscore_dense(spark, d):
    rows = M.explode_dense(D.dense(spark, d).select("cell_id", "x")).join(dense_stats(spark, d), "gene_idx")
    return rows.select("cell_id", F.col("gene_idx").cast("long").alias("gene_idx"), r6(N.zscore(F.col("x"), F.col("mu"), F.col("sigma"))).alias("z"))


@query(sql(f"select gene_id, gene_idx, {R(Z.format(x='0', mu='mu', sd='sigma'))} as z0 from stats", "counts", "genes", norm=NORM, stats=STATS))
def zscore_zero_value(spark, d):
    return M.zero_values(stats(spark, d)).select("gene_id", "gene_idx", r6(F.col("z0")).alias("z0"))


@query(sql(f"select n.cell_id, s.gene_idx, n.value, {R(Z.format(x='n.z', mu='s.mu', sd='s.sigma'))} as z from norm n join stats s on n.gene_id = s.gene_id", "counts", "genes", norm=NORM_LOG, stats=STATS))
def preprocess_full(spark, d):
    return M.preprocess(D.counts(spark, d), stats(spark, d, log=True), log=True).select("cell_id", "gene_idx", "value", r6(F.col("z")).alias("z"))


@query(sql("select n.cell_id, s.gene_idx, round((n.z - s.mu) / (s.sigma + 1e-10::double) * (s.sigma + 1e-10::double) + s.mu, 4) + 0.0::double as z from norm n join stats s on n.gene_id = s.gene_id", "counts", "genes", norm=NORM, stats=STATS))
def inverse_zscore(spark, d):
    rows = M.row_normalize(D.counts(spark, d)).join(stats(spark, d), "gene_id")
    z = N.zscore(F.col("z"), F.col("mu"), F.col("sigma"), bound=None)
    return rows.select("cell_id", "gene_idx", (F.round(N.inverse_zscore(z, F.col("mu"), F.col("sigma")), 4) + F.lit(0.0)).alias("z"))


@query(sql("select cell_id, gene_id, round(exp(greatest(-10.0::double, least(10.0::double, z))) - 1, 4) + 0.0::double as z from norm", "counts", norm=NORM_LOG))
def inverse_log(spark, d):
    return M.row_normalize(D.counts(spark, d), log=True).select("cell_id", "gene_id", (F.round(N.inverse_log(F.col("z")), 4) + F.lit(0.0)).alias("z"))


@query(sql(
    f"select cell_id, gene_idx, {R('m * case when sum(m) over (partition by cell_id) > 0 then 10000.0::double / sum(m) over (partition by cell_id) else 1 end')} as mean from soft",
    "entries", stats=DENSE_STATS,
    raw="select cell_id, e.gene_idx, exp(greatest(-10.0::double, least(10.0::double, x * (sigma + 1e-10::double) + mu))) - 1 as v from entries e join stats s on e.gene_idx = s.gene_idx",
    soft="select cell_id, gene_idx, greatest(v, 0) + ln(1 + exp(-abs(v))) as m from raw",
))
def inverse_chain(spark, d):
    rows = M.explode_dense(D.dense(spark, d).select("cell_id", "x")).join(dense_stats(spark, d), "gene_idx")
    mean = N.softplus(N.inverse_log(N.inverse_zscore(F.col("x"), F.col("mu"), F.col("sigma"))))
    rows = rows.select("cell_id", F.col("gene_idx").cast("long").alias("gene_idx"), mean.alias("value"))
    return M.row_normalize(rows).select("cell_id", "gene_idx", r6(F.col("z")).alias("mean"))


@query(sql("select * from counts where ('0x' || substr(md5('1:' || cell_id || ':' || gene_id), 1, 8))::bigint / 4294967296.0::double >= 0.3", "counts"))
def mask_counts(spark, d):
    return M.mask_counts(D.counts(spark, d), 0.3)


# -- Statistics and encodings ------------------------------------------------------------


@query(sql("select gene_id, round(sum(z), 3) as s, round(sum(z * z) / 1e6, 3) as ss from norm group by 1", "counts", norm=NORM))
def gene_moments(spark, d):
    return M.gene_moments(M.row_normalize(D.counts(spark, d))).select("gene_id", F.round("s", 3).alias("s"), F.round(F.col("ss") / 1e6, 3).alias("ss"))


GENE_STATS = f"select gene_id, gene_idx, {R('mu')} as mu, {R('sigma')} as sigma from stats"


@query(sql(GENE_STATS, "counts", "genes", norm=NORM, stats=STATS))
def gene_stats(spark, d):
    return stats(spark, d).select("gene_id", "gene_idx", r6(F.col("mu")).alias("mu"), r6(F.col("sigma")).alias("sigma"))


@query(sql(GENE_STATS, "counts", "genes", norm=NORM_LOG, stats=STATS))
def gene_stats_log(spark, d):
    return stats(spark, d, log=True).select("gene_id", "gene_idx", r6(F.col("mu")).alias("mu"), r6(F.col("sigma")).alias("sigma"))


@query(sql(GENE_STATS, "counts", "genes", norm=NORM, stats=STATS))
def gene_stats_roundtrip(spark, d):
    from tessera.sources import artifacts

    path = artifacts.scratch(spark, "schema")
    artifacts.save_schema(artifacts.Schema(stats(spark, d), D.cells(spark, d).limit(0).selectExpr("'' as feature", "'' as category", "0L as code")), path)
    back = artifacts.load_schema(spark, path)
    return back.stats.select("gene_id", "gene_idx", r6(F.col("mu")).alias("mu"), r6(F.col("sigma")).alias("sigma"))


CODES = "select feature, category, row_number() over (partition by feature order by first, category) - 1 as code from (select '{f}' as feature, {f} as category, min(cell_id) as first from cells group by 2)"


@query(sql(CODES.format(f="tissue_type") + " union all " + CODES.format(f="imputed_labels"), "cells"))
def category_codes(spark, d):
    rows = D.cells(spark, d)
    return M.category_codes(rows, "tissue_type").unionByName(M.category_codes(rows, "imputed_labels"))


@query(sql("select c.cell_id, 'imputed_labels' as feature, k.code, case when c.imputed_labels = k.category then 1 else 0 end as hot from cells c, codes k", "cells", codes=CODES.format(f="imputed_labels")))
def encode_onehot(spark, d):
    rows = D.cells(spark, d)
    return M.one_hot(rows, M.category_codes(rows, "imputed_labels"), "imputed_labels")


@query(sql("select c.cell_id, coalesce(t.code, -1) as tissue_type_code, coalesce(l.code, -1) as imputed_labels_code from cells c left join ct t on c.tissue_type = t.category left join cl l on c.imputed_labels = l.category", "cells", ct=CODES.format(f="tissue_type"), cl=CODES.format(f="imputed_labels")))
def encode_targets(spark, d):
    rows = D.cells(spark, d).select("cell_id", "tissue_type", "imputed_labels")
    for f in ("tissue_type", "imputed_labels"):
        rows = M.encode(rows, M.category_codes(D.cells(spark, d), f), f)
    return rows.select("cell_id", "tissue_type_code", "imputed_labels_code")


MARKED = "select s_suppkey as gene_id from supplier where s_nationkey < 3"
QC = "select c.cell_id, sum(value) as total_counts, count(*) as n_genes, 100 * sum(case when m.gene_id is not null then value else 0 end) / sum(value) as pct_marked from counts c left join marked m on c.gene_id = m.gene_id group by 1"


def qc(spark, d) -> DataFrame:
    marked = D.read(spark, d, "supplier").where("s_nationkey < 3").select(F.col("s_suppkey").alias("gene_id"))
    return M.qc_metrics(D.counts(spark, d), marked)


@query(sql(f"select cell_id, total_counts, n_genes, {R('pct_marked')} as pct_marked from qc", "counts", marked=MARKED, qc=QC))
def qc_metrics(spark, d):
    return qc(spark, d).select("cell_id", "total_counts", "n_genes", r6(F.col("pct_marked")).alias("pct_marked"))


@query(sql("select cell_id from qc where n_genes >= 2 and pct_marked < 10", "counts", marked=MARKED, qc=QC))
def qc_filter_cells(spark, d):
    return M.qc_filter_cells(qc(spark, d), 2, 10.0)


@query(sql("select gene_id, count(*) as n_cells from counts where cell_id in (select cell_id from qc where n_genes >= 2 and pct_marked < 10) group by 1 having count(*) >= 3", "counts", marked=MARKED, qc=QC))
def qc_filter_genes(spark, d):
    return M.qc_filter_genes(D.counts(spark, d), M.qc_filter_cells(qc(spark, d), 2, 10.0), 3)


@query(sql("select count(*) as n_cells, count(distinct study || ':' || patient) as n_patients, count(distinct sample) as n_samples, count(distinct cancer_type) as n_cancer_types from base", "base"))
def dataset_overview(spark, d):
    return P.overview(D.cells(spark, d))


# -- Metrics -----------------------------------------------------------------------------

CONF = "select {k} sum(case when y = 1 and p > 0.5 then 1 else 0 end)::bigint as tp, sum(case when y <> 1 and p > 0.5 then 1 else 0 end)::bigint as fp, sum(case when y <> 1 and p <= 0.5 then 1 else 0 end)::bigint as tn, sum(case when y = 1 and p <= 0.5 then 1 else 0 end)::bigint as fn, count(*) as n, sum(pow(y - p, 2)) as se, sum(y)::bigint as positives from named {g}"
NAMED = "select *, coalesce(imputed_labels, 'nan') || '__' || coalesce(tissue_type, 'nan') as stratum from scored"
AUC = "select {k} sum(pos * (below + neg / 2.0::double)) / nullif(sum(pos) * sum(neg), 0)::double as auroc from (select *, coalesce(sum(neg) over ({p} order by p rows between unbounded preceding and 1 preceding), 0) as below from (select {k} p, sum(case when y = 1 then 1 else 0 end)::double as pos, sum(case when y <> 1 then 1 else 0 end)::double as neg from named group by {k} p)) {g}"
RATES = {
    "accuracy": "(tp + tn) / nullif(n, 0)", "error_rate": "1 - (tp + tn) / nullif(n, 0)", "F1": "2.0::double * tp / nullif(2 * tp + fp + fn, 0)", "precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(tp + fn, 0)",
    "FPR": "fp / nullif(fp + tn, 0)", "FNR": "fn / nullif(fn + tp, 0)", "RMSE": "sqrt(se / nullif(n, 0))", "positives_rate": "positives / nullif(n, 0)",
}
WIDE = "select c.*, a.auroc from conf c join auc a on c.stratum = a.stratum"
WIDE1 = "select c.*, a.auroc from conf c, auc a"
METRIC_COLUMNS = ", ".join([f"{R(v)} as \"{k}\"" for k, v in RATES.items()] + [f"{R('auroc')} as \"AUROC\"", "n"])
BY = {"conf": CONF.format(k="stratum,", g="group by stratum"), "auc": AUC.format(k="stratum,", p="partition by stratum", g="group by stratum")}
ALL = {"conf": CONF.format(k="", g=""), "auc": AUC.format(k="", p="", g="")}
TALL = " union all ".join([f"select stratum, '{k}' as metric, ({v})::double as value from wide" for k, v in RATES.items()] + ["select stratum, 'AUROC', auroc from wide"])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(sql(f"select tp, fp, tn, fn, n, {R('se')} as se, positives from conf", "scored", named=NAMED, conf=ALL["conf"]))
def confusion_matrix(spark, d):
    return rounded(E.confusion(D.scored(spark, d), []))


@query(sql(f"select {METRIC_COLUMNS} from wide", "scored", named=NAMED, **ALL, wide=WIDE1))
def metrics_overall(spark, d):
    return rounded(E.metrics(D.scored(spark, d), []))


@query(sql(f"select {R('auroc')} as \"AUROC\" from auc", "scored", named=NAMED, auc=ALL["auc"]))
def auroc(spark, d):
    return rounded(E.auroc(D.scored(spark, d), []))


@query(sql(f"select p, {R('sum(neg) over w / (select sum(neg) from a)')} as fpr, {R('sum(pos) over w / (select sum(pos) from a)')} as tpr from a window w as (order by p desc rows between unbounded preceding and current row)", "scored", a="select p, sum(case when y = 1 then 1 else 0 end)::double as pos, sum(case when y <> 1 then 1 else 0 end)::double as neg from scored group by 1"))
def roc_points(spark, d):
    return rounded(E.roc_points(D.scored(spark, d)).withColumn("p", F.col("p")))


@query(sql(f"select stratum, {METRIC_COLUMNS} from wide", "scored", named=NAMED, **BY, wide=WIDE))
def metrics_by_stratum(spark, d):
    return rounded(E.by_stratum(D.scored(spark, d)))


@query(sql("select imputed_labels, tissue_type, grouping(imputed_labels)::int as g, count(*) as n, sum(y)::bigint as positives, sum(case when p > 0.5 then 1 else 0 end)::bigint as predicted from scored group by grouping sets ((), (imputed_labels), (imputed_labels, tissue_type))", "scored"))
def metrics_grouping_sets(spark, d):
    rows = D.scored(spark, d)
    out = rows.groupingSets([[], ["imputed_labels"], ["imputed_labels", "tissue_type"]], "imputed_labels", "tissue_type")
    return out.agg(F.grouping("imputed_labels").cast("int").alias("g"), F.count("*").alias("n"), F.sum("y").alias("positives"), F.sum((F.col("p") > 0.5).cast("long")).alias("predicted"))


#: Scores of which some are no number: their strata go as a whole.
PLANTED = "select cell_id, y, case when cell_id % 211 = 3 then 'nan'::double else p end as p, imputed_labels, tissue_type from scored"
FIT_STRATA = "select * from strata where stratum in (select stratum from strata group by 1 having count(distinct y) = 2 and bool_and(not isnan(p)))"


def planted(spark, d) -> DataFrame:
    return D.scored(spark, d).withColumn("p", F.when(F.col("cell_id") % 211 == 3, float("nan")).otherwise(F.col("p")))


@query(sql(f"select stratum, {R('auroc')} as \"AUROC\" from auc", "scored", planted=PLANTED, strata=NAMED.replace("from scored", "from planted"), named=FIT_STRATA, auc=BY["auc"]))
def auroc_per_strata(spark, d):
    return rounded(E.auroc_by_valid_stratum(planted(spark, d)))


def strata_tall(spark, d) -> DataFrame:
    return E.tall(E.by_stratum(D.scored(spark, d)).drop("n"), "stratum", F.col("stratum"))


@query(sql(f"select metric, {R('avg(value)')} as value from tall group by 1", "scored", named=NAMED, **BY, wide=WIDE, tall=TALL))
def metrics_macro_avg(spark, d):
    return rounded(E.macro_average(strata_tall(spark, d)))


@query(sql(f"select metric, {R('case when min(value) = 0 then 0 else count(value) / sum(1 / nullif(value, 0)) end')} as value from tall group by 1", "scored", named=NAMED, **BY, wide=WIDE, tall=TALL))
def metrics_harmonic(spark, d):
    return rounded(E.harmonic_mean(strata_tall(spark, d)))


@query(sql(f"select 'stratum' as scope, stratum || '/' || metric as path, {R('value')} as value from tall", "scored", named=NAMED, **BY, wide=WIDE, tall=TALL))
def metrics_flatten(spark, d):
    return rounded(strata_tall(spark, d).select("scope", F.concat_ws("/", "stratum", "metric").alias("path"), "value"))


@query(sql(f"select stratum, {R('(tp + tn) / nullif(n, 0)')} as accuracy, {R('auroc')} as \"AUROC\" from wide", "scored", named=NAMED, **BY, wide=WIDE))
def metrics_pivot(spark, d):
    return rounded(strata_tall(spark, d).groupBy("stratum").pivot("metric", ["accuracy", "AUROC"]).agg(F.first("value")))


@query(sql(f"select imputed_labels, {R('coalesce(sum(case when y <> 1 and p >= 0.5 then 1 else 0 end) / nullif(sum(case when y <> 1 then 1 else 0 end), 0), 0)')} as fpr, {R('coalesce(sum(case when y = 1 and p < 0.5 then 1 else 0 end) / nullif(sum(case when y = 1 then 1 else 0 end), 0), 0)')} as fnr, {R('avg(case when (y = 1) <> (p >= 0.5) then 1 else 0 end)')} as error_rate from scored group by 1", "scored"))
def batch_rates(spark, d):
    return rounded(E.batch_rates(D.scored(spark, d), ["imputed_labels"]))


@query(sql("select cell_id, y as y_true, p as y_pred_prob, (p > 0.5)::int as y_pred, imputed_labels, tissue_type from scored", "scored"))
def results_table(spark, d):
    from tessera.sources import artifacts

    return artifacts.results_table(D.scored(spark, d), 0.5)


@query(sql("select b.cell_id, b.study, b.tissue_type, round(b.cell_id % 1000 / 1000.0::double, 3) as logistic_prediction from base b", "base"))
def predictions_table(spark, d):
    from tessera.sources import artifacts

    rows = D.cells(spark, d).select("cell_id", "study", "tissue_type")
    p = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.round(F.col("o_orderkey") % 1000 / 1000.0, 3).alias("p"))
    return artifacts.predictions_table(rows, p, "logistic")


@query(sql("select count(*) as n, min(p) as least, max(p) as most, count(*) > 0 and min(p) >= 0 and max(p) <= 1 as valid from scored", "scored"))
def prediction_bounds(spark, d):
    return D.scored(spark, d).agg(F.count("*").alias("n"), F.min("p").alias("least"), F.max("p").alias("most"), ((F.count("*") > 0) & (F.min("p") >= 0) & (F.max("p") <= 1)).alias("valid"))


# -- Splits ------------------------------------------------------------------------------

SPLIT = "select patient_id, cancer_type, case when rn <= case when n >= 2 then greatest(1, floor(n * 0.2::double + 0.5)) else 0 end then 'dev' else 'train' end as split from (select *, row_number() over (partition by cancer_type order by md5(patient_id || ':1'), patient_id) as rn, count(*) over (partition by cancer_type) as n from (select distinct study || ':' || patient as patient_id, cancer_type from base))"
JOINED = "select b.*, s.split, s.patient_id from base b join split s on b.study || ':' || b.patient = s.patient_id"


@query(sql("select distinct study || ':' || patient as patient_id, cancer_type from base", "base"))
def patient_ids(spark, d):
    return P.patients(D.cells(spark, d))


@query(sql("select study || ':' || patient as patient_id, count(distinct cancer_type) as n_types from base group by 1 having count(distinct cancer_type) <> 1", "base"))
def fd_check(spark, d):
    return P.many_cancers(D.cells(spark, d))


@query(sql(SPLIT, "base"))
def split_patients(spark, d):
    return P.split_patients(D.cells(spark, d))


@query(sql("select cell_id, split from joined", "base", split=SPLIT, joined=JOINED))
def split_cells(spark, d):
    rows = D.cells(spark, d)
    return P.split_cells(rows, P.split_patients(rows))


@query(sql("select split, count(distinct patient_id) as n_patients, count(*) as n_cells from joined group by 1", "base", split=SPLIT, joined=JOINED))
def split_summary(spark, d):
    rows = D.cells(spark, d)
    return P.summary(rows, P.split_patients(rows))


@query(sql(
    f"select split, feature, category, {R('100.0::double * n / sum(n) over (partition by split, feature)')} as percent from (select split, 'imputed_labels' as feature, imputed_labels as category, count(*) as n from joined group by 1, 3 union all select split, 'tissue_type', tissue_type, count(*) from joined group by 1, 3 union all select split, 'cancer_type', cancer_type, count(*) from split group by 1, 3)",
    "base", split=SPLIT, joined=JOINED,
))
def split_distribution(spark, d):
    rows = D.cells(spark, d)
    return rounded(P.distribution(rows, P.split_patients(rows)))


# -- Batches -----------------------------------------------------------------------------


@query(sql("select cell_id, (row_number() over (order by cell_id) - 1) // 64 as batch_id from base", "base"))
def eval_batches(spark, d):
    return B.eval_batches(D.read(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id")), 64)


@query(sql("select cell_id, (row_number() over (order by md5('1:0:' || cell_id), cell_id) - 1) // 64 as batch_id from base", "base"))
def random_batches(spark, d):
    return B.random_batches(D.read(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id")), 64)


CYCLED = "select cell_id, {s}, (pl // slots)::bigint as batch_id from (select e.*, e.c * e.size + row_number() over (partition by {s}, c order by md5('1:' || c || ':' || cell_id), cell_id) - 1 as pl from (select r.cell_id, r.{s}, n.slots, n.size, n.slots * n.batches as need, t.c from r join need n on r.{s} = n.{s}, lateral (select unnest(range(0, ceil(n.slots * n.batches / n.size)::bigint)) as c) t) e) where pl < need"


@query(sql(CYCLED.format(s="y"), "cells", r=CELLS_Y, need="select y, count(*) as size, case when y = 1 then 32 else 64 - 32 end as slots, (select ceil(count(*) / 64)::bigint from r) as batches from r group by 1"))
def balanced_labels_batches(spark, d):
    return B.balanced_labels(cells_y(spark, d).select("cell_id", "y"), 64)


STRATA = "select *, name || case when both_ then case when y = 1 then '_pos' else '_neg' end else '' end as stratum from (select *, count(distinct y) over (partition by name) = 2 as both_ from (select *, tissue_type || '_' || imputed_labels as name from y))"
ALLOC = "select stratum, n, n as size, (64 // (count(*) over ()) + case when row_number() over (order by n desc, stratum) <= 64 % (count(*) over ()) then 1 else 0 end)::bigint as slots from (select stratum, count(*) as n from r group by 1)"


@query(sql(CYCLED.format(s="stratum"), "cells", y=CELLS_Y, r=STRATA, need=ALLOC.replace("select stratum, n,", "select stratum, (select ceil(count(*) / 64)::bigint from r) as batches,", 1)))
def balanced_types_batches(spark, d):
    return B.balanced_types(cells_y(spark, d).select("cell_id", "y", "tissue_type", "imputed_labels"), 64)


@query(sql(f"select stratum, n, slots from ({ALLOC})", "cells", y=CELLS_Y, r=STRATA))
def stratum_allocation(spark, d):
    return B.allocation(B.strata(cells_y(spark, d)), 64)


@query(sql(f"select y, n, {R('sum(n) over () / (count(*) over () * n)')} as weight from (select y, count(*) as n from y group by 1)", "cells", y=CELLS_Y))
def class_weights(spark, d):
    return rounded(B.class_weights(cells_y(spark, d)))


@query(sql(f"select c.cell_id, c.y, {R('1 / (1 + exp(-(c.clone_id_size / c.median_clone_size - 1.5)))')} as y_soft, coalesce(x.n_genes, 0) as n_genes, {R('coalesce(x.total, 0)')} as total, b.batch_id from y c left join (select cell_id, count(*) as n_genes, sum(z) as total from norm group by 1) x on c.cell_id = x.cell_id join (select cell_id, (row_number() over (order by md5('1:0:' || cell_id), cell_id) - 1) // 64 as batch_id from y) b on c.cell_id = b.cell_id", "cells", "counts", y=CELLS_Y, norm=NORM_LOG))
def training_frame(spark, d):
    rows = cells_y(spark, d)
    x = M.row_normalize(D.counts(spark, d), log=True).groupBy("cell_id").agg(F.count("*").alias("n_genes"), F.sum("z").alias("total"))
    out = rows.join(x, "cell_id", "left").join(B.random_batches(rows, 64), "cell_id")
    soft = N.soft_label(F.col("clone_id_size"), F.col("median_clone_size"))
    return out.select("cell_id", "y", r6(soft).alias("y_soft"), F.coalesce("n_genes", F.lit(0).cast("long")).alias("n_genes"), r6(F.coalesce("total", F.lit(0.0))).alias("total"), "batch_id")


# -- Scores and losses -------------------------------------------------------------------

SCORE = f"select cell_id, (select sum(w * z0) from model) + coalesce(own, 0) as score from (select b.cell_id, sum(m.w * ({Z.format(x='n.z', mu='m.mu', sd='m.sigma')} - m.z0)) as own from (select o_orderkey as cell_id from orders) b left join norm n on n.cell_id = b.cell_id left join model m on n.gene_id = m.gene_id group by 1)"
MODEL = f"select s.*, w.w, {Z.format(x='0', mu='s.mu', sd='s.sigma')} as z0 from stats s join weights w on s.gene_id = w.gene_id"


def sparse_scores(spark, d) -> DataFrame:
    rows = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"))
    return S.linear_sparse(D.counts(spark, d), rows, stats(spark, d, log=True), weights(spark, d))


@query(sql(f"select cell_id, {R('score')} as score, {R('1 / (1 + exp(-score))')} as p from score", "counts", "genes", norm=NORM_LOG, stats=STATS, weights=WEIGHTS, model=MODEL, score=SCORE))
def linear_score_sparse(spark, d):
    return rounded(sparse_scores(spark, d))


@query(sql(f"select cell_id, {R('sum(w * z)')} as score, {R('1 / (1 + exp(-sum(w * z)))')} as p from (select cell_id, (e.gene_idx % 5 - 2) / 10.0::double as w, {Z.format(x='e.x', mu='s.mu', sd='s.sigma')} as z from entries e join stats s on e.gene_idx = s.gene_idx) group by 1", "entries", stats=DENSE_STATS))
def linear_score_dense(spark, d):
    entries = M.explode_dense(D.dense(spark, d).select("cell_id", "x")).withColumnRenamed("x", "z")
    w = entries.select("gene_idx").distinct().select("gene_idx", ((F.col("gene_idx") % 5 - 2) / 10.0).alias("w"))
    return rounded(S.linear_dense(entries, dense_stats(spark, d), w))


@query(sql(f"select cell_id, gene_idx, {R('exp(x - m) / sum(exp(x - m)) over (partition by cell_id)')} as p from (select *, max(x) over (partition by cell_id) as m from entries)", "entries"))
def softmax_proba(spark, d):
    rows = M.explode_dense(D.dense(spark, d).select("cell_id", "x"))
    return S.softmax(rows, "cell_id", "x").select("cell_id", F.col("gene_idx").cast("long").alias("gene_idx"), r6(F.col("p")).alias("p"))


@query(sql(f"select cell_id, gene_idx, {R('greatest(1e-4::double, least(1000.0::double, greatest(x, 0) + ln(1 + exp(-abs(x)))))')} as theta, {R('1 / (1 + exp(-x))')} as pi from entries", "entries"))
def nb_activations(spark, d):
    rows = M.explode_dense(D.dense(spark, d).select("cell_id", "x"))
    return rows.select("cell_id", F.col("gene_idx").cast("long").alias("gene_idx"), r6(N.theta_activation(F.col("x"))).alias("theta"), r6(N.sigmoid(F.col("x"))).alias("pi"))


@query(sql(f"select imputed_labels, {R('avg(case when not isnan(t) then pow(t - p, 2) end)')} as mse from (select imputed_labels, p, case when cell_id % 7 = 1 then 'nan'::double else y::double end as t from scored) group by 1", "scored"))
def loss_mse(spark, d):
    rows = D.scored(spark, d).withColumn("y", F.when(F.col("cell_id") % 7 == 1, float("nan")).otherwise(F.col("y").cast("double")))
    return rounded(rows.groupBy("imputed_labels").agg(F.avg(N.squared_error(F.col("y"), F.col("p"))).alias("mse")))


@query(sql(f"select imputed_labels, {R('avg(-(3.0::double * y * ln(q) + (1 - y) * ln(1 - q)))')} as bce from (select *, greatest(1e-7::double, least(1 - 1e-7::double, p)) as q from scored) group by 1", "scored"))
def loss_bce(spark, d):
    return rounded(D.scored(spark, d).groupBy("imputed_labels").agg(F.avg(N.bce(F.col("y"), F.col("p"), 3.0)).alias("bce")))


NB = "(2.0::double) * (ln(2.0::double + 1e-8) - ln(2.0::double + mu + 1e-8)) + x * (ln(mu + 1e-8) - ln(2.0::double + mu + 1e-8)) + lgamma(least(x + 2.0::double, 1000)) - lgamma(2.0::double) - lgamma(least(x + 1, 1000.0::double))"
#: The dense grid, cells times genes; the queries themselves go over the non-zeros.
NB_ROWS = f"select b.cell_id, least(coalesce(c.value, 0), 1e6::double) as x, m.mu from (select o_orderkey as cell_id from orders) b cross join (select g.gene_id, coalesce(s, 0) / {N_CELLS} as mu from genes g left join (select gene_id, sum(value) as s from counts group by 1) t on g.gene_id = t.gene_id) m left join counts c on c.cell_id = b.cell_id and c.gene_id = m.gene_id"


def _mean_loss(spark, d, loss: Callable[[Column, Column], Column]) -> DataFrame:
    """(cell_id, nll): the mean of a loss over all genes, zeros included, against each gene's mean.

    mean(c) = (sum over genes of the loss at zero + sum over the cell's non-zeros of (loss at the
    value - loss at zero)) / genes: one pass over the non-zeros."""
    cells = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"))
    counts = D.counts(spark, d)
    n = cells.agg(F.count("*").alias("n"))  # one row
    sums = counts.groupBy("gene_id").agg(F.sum("value").alias("s"))
    means = D.genes(spark, d).select("gene_id").join(sums, "gene_id", "left").crossJoin(F.broadcast(n)).select("gene_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mu"))
    means = means.withColumn("zero", N.finite(loss(F.lit(0.0), F.col("mu"))))
    base = means.agg(F.sum("zero").alias("base"), F.count("*").alias("genes"))  # one row
    own = counts.join(means, "gene_id").groupBy("cell_id").agg(F.sum(N.finite(loss(F.col("value"), F.col("mu"))) - F.col("zero")).alias("own"))
    rows = cells.join(own, "cell_id", "left").crossJoin(F.broadcast(base))
    return rows.select("cell_id", F.round((F.col("base") + F.coalesce("own", F.lit(0.0))) / F.col("genes"), 5).alias("nll"))


@query(sql(f"select cell_id, round(avg(-({NB})), 5) as nll from rows group by 1", "counts", "genes", rows=NB_ROWS))
def loss_nb(spark, d):
    return _mean_loss(spark, d, lambda x, mu: -N.nb_log_likelihood(x, mu, F.lit(2.0)))


@query(sql(f"select cell_id, round(avg(-(case when x < 1e-8 then ln(0.1::double + 0.9 * exp({NB}) + 1e-8) else ln(0.9::double + 1e-8) + {NB} end)), 5) as nll from rows group by 1", "counts", "genes", rows=NB_ROWS))
def loss_zinb(spark, d):
    return _mean_loss(spark, d, lambda x, mu: -N.zinb_log_likelihood(x, mu, F.lit(2.0), F.lit(0.1)))


# -- Training on non-zeros ---------------------------------------------------------------

SGD_STEPS = 3
Y_WEIGHT = "select y.*, w.weight from y join (select y, sum(n) over () / (count(*) over () * n) as weight from (select y, count(*) as n from y group by 1)) w on y.y = w.y"
SGD_GRID = f"select y.cell_id, y.y, y.weight, s.gene_idx, {Z.format(x='coalesce(n.z, 0)', mu='s.mu', sd='s.sigma')} as z, b.batch from yw y cross join stats s join batches b on b.cell_id = y.cell_id left join norm n on n.cell_id = y.cell_id and n.gene_id = s.gene_id"


def _sgd_parts() -> dict[str, str]:
    """The dense way: every cell's z-scores of all genes, one step after another."""
    parts = {"w0": "select gene_idx, 0.0::double as w from genes", "b0": "select 0.0::double as b"}
    for k in range(SGD_STEPS):
        parts[f"r{k}"] = f"select g.cell_id, any_value(g.weight) * (1 / (1 + exp(-((select b from b{k}) + sum(g.z * w.w)))) - any_value(g.y)) as r from grid g join w{k} w on g.gene_idx = w.gene_idx where g.batch = {k} group by 1"
        parts[f"w{k + 1}"] = f"select w.gene_idx, any_value(w.w) * (1 - 0.1 * 0.01)::double - 0.1::double * avg(r.r * g.z) as w from w{k} w join grid g on g.gene_idx = w.gene_idx join r{k} r on r.cell_id = g.cell_id group by 1"
        parts[f"b{k + 1}"] = f"select (select b from b{k}) - 0.1::double * avg(r) as b from r{k}"
    return parts


@query(sql(
    f"select gene_idx::int as gene_idx, {R('w')} as w from w{SGD_STEPS} union all select -1, {R('b')} from b{SGD_STEPS}", "cells", "counts", "genes", y=CELLS_Y, norm=NORM_LOG, stats=STATS, yw=Y_WEIGHT,
    batches=f"select cell_id, (row_number() over (order by md5('1:0:' || cell_id), cell_id) - 1) // (select ceil(count(*) / {SGD_STEPS}.0)::bigint from y) as batch from y", grid=SGD_GRID, **_sgd_parts(),
))
def sgd_linear_steps(spark, d):
    """The weights after an epoch of three batches that hold all cells."""
    from tessera.models import sgd
    from tessera.sources import artifacts

    counts, rows, fitted = D.counts(spark, d), cells_y(spark, d), artifacts.written(stats(spark, d, log=True), "stats")
    rows = artifacts.written(rows.select("cell_id", "y"), "cells")
    size = -(-rows.count() // SGD_STEPS)
    params = sgd.SgdParams(alpha=0.01, learning_rate="constant", eta0=0.1, batch_size=size)
    frame = sgd.training_rows(rows, sgd.sparse_rows(counts, rows, fitted), params).join(B.train_batches("random", rows, size), "cell_id")
    frame, weights = artifacts.written(frame, "frame"), sgd.initial(fitted)
    for step in range(SGD_STEPS):
        weights = artifacts.written(sgd.stepped(frame.where(F.col("batch_id") == step), weights, params, step), "weights")
    return rounded(weights.select("gene_idx", "w"))


SPLIT_BINS = 16
TREE_VALUES = "select n.cell_id, g.gene_idx::int as gene_idx, round(n.z, 9) as x from norm n join genes g on n.gene_id = g.gene_id"
TREE_BINS = f"select gene_idx, x, ((rank() over (partition by gene_idx order by x) - 1) * {SPLIT_BINS - 1} // count(*) over (partition by gene_idx) + 1)::int as bin from x"
TREE_HIST = "select x.gene_idx, b.bin, sum(g.g) as g, sum(g.h) as h, count(*) as n from x join (select distinct gene_idx, x, bin from binned) b on x.gene_idx = b.gene_idx and x.x = b.x join grads g on g.cell_id = x.cell_id group by 1, 2"
TREE_RIGHT = "select gene_idx, bin, sum(g) over w as g, sum(h) over w as h, (sum(n) over w)::bigint as n, (select sum(g) from grads) as ag, (select sum(h) from grads) as ah, (select count(*) from grads) as an from hist window w as (partition by gene_idx order by bin desc rows between unbounded preceding and current row)"


@query(sql(
    f"select gene_idx, bin, {R('pow(ag - g, 2) / (ah - h + 1.0::double + 1e-12) + pow(g, 2) / (h + 1.0::double + 1e-12) - pow(ag, 2) / (ah + 1.0::double + 1e-12)')} as gain, n as right_n from rights where least(n, an - n) >= 20 and least(h, ah - h) >= 1e-3 and pow(ag - g, 2) / (ah - h + 1.0::double + 1e-12) + pow(g, 2) / (h + 1.0::double + 1e-12) - pow(ag, 2) / (ah + 1.0::double + 1e-12) > 1e-9",
    "cells", "counts", "genes", y=CELLS_Y, yw=Y_WEIGHT, norm=NORM_LOG, x=TREE_VALUES, binned=TREE_BINS, grads="select cell_id, weight * (0.5 - y) as g, weight * 0.25 as h from yw", hist=TREE_HIST, rights=TREE_RIGHT,
))
def hist_split_gain(spark, d):
    """Gains of all splits of a first tree's root, from histograms of the non-zeros."""
    from tessera.models import trees as X

    rows, p = cells_y(spark, d), X.LeafwiseParams(max_bin=SPLIT_BINS, reg_lambda=1.0)
    x = X.values(D.counts(spark, d), rows, D.genes(spark, d)).withColumn("x", F.round("x", 9))  # logarithms of two engines differ in the last bit
    own = rows.join(F.broadcast(B.class_weights(rows).select("y", "weight")), "y").select("cell_id", (F.col("weight") * (0.5 - F.col("y"))).alias("g"), (F.col("weight") * 0.25).alias("h"))  # two rows
    hist = X.histogram(own.join(X.binned(x, X.bins(x, SPLIT_BINS), rows), "cell_id").withColumn("node", F.lit(0)))
    totals = own.agg(F.lit(0).alias("node"), F.sum("g").alias("all_g"), F.sum("h").alias("all_h"), F.count("*").alias("all_n"))
    return rounded(X.split_gains(hist, totals, p).select("gene_idx", "bin", "gain", F.col("right_n").cast("long").alias("right_n")))


@query(sql("select cell_id, patient_id, split from joined", "base", split=SPLIT, joined=JOINED))
def split_roundtrip(spark, d):
    """The split of a preparation that was committed, and taken up again from its version."""
    from tessera.plans import prepare
    from tessera.sources import artifacts

    path = artifacts.scratch(spark, "prepared")
    tables = D.counts(spark, d), D.genes(spark, d), artifacts.written(D.cells(spark, d), "cells")
    prepare.prepare(spark, path, *tables)
    again = prepare.prepare(spark, path, *tables)
    if not again.resumed:
        raise RuntimeError("the preparation was not taken up again")
    return again.cells.select("cell_id", P.patient_id().alias("patient_id"), "split")


@query("select p_partkey, format('{:.4f}', p_retailprice) as price, regexp_replace(regexp_replace(format('{:.4e}', floor(p_retailprice) / 1e7), '\\.?0*e', 'e'), 'e([+-])0*([0-9])', 'e\\1\\2') as small, case when p_size = 1 then 'nan' else format('{:.4f}', p_size::double) end as size from part")
def number_format(spark, d):
    from tessera.functions.text import printed

    size = F.when(F.col("p_size") == 1, float("nan")).otherwise(F.col("p_size").cast("double"))
    return D.read(spark, d, "part").select("p_partkey", printed(F.col("p_retailprice")).alias("price"), printed(F.floor("p_retailprice") / 1e7).alias("small"), printed(size).alias("size"))


AUG_U = "('0x' || substr(md5('3:2:{w}:' || {c} || ':' || {g}), {at}, 8))::bigint"
AUG_NOISE = f"0.05::double * sqrt(-2 * ln(({AUG_U.format(w='noise', c='y.cell_id', g='s.gene_idx', at=1)} + 1) / 4294967296.0::double)) * cos(2 * pi() * {AUG_U.format(w='noise', c='y.cell_id', g='s.gene_idx', at=9)} / 4294967296.0::double)"
AUG_LEFT = f"select cell_id, gene_id, value from counts where {AUG_U.format(w='mask', c='cell_id', g='gene_id', at=1)} / 4294967296.0::double >= 0.2"


@query(sql(
    f"select y.cell_id, y.y, {R('sum(x.x)')} as total, {R('sum(x.x * x.x)')} as squares, {R('max(x.x)')} as most, {R('coalesce(max(k.clean), 0)')} as clean, {R('sum(x.x * (x.gene_idx + 1))')} as placed from y join x on x.cell_id = y.cell_id left join (select cell_id, sum(z) as clean from norm group by 1) k on k.cell_id = y.cell_id group by 1, 2",
    "cells", "counts", "genes", y=CELLS_Y, norm=NORM, lognorm=NORM_LOG, stats=STATS.replace("from norm", "from lognorm"), kept=AUG_LEFT,
    masked=NORM_LOG.replace("from counts", "from kept"), x=f"select y.cell_id, s.gene_idx, {Z.format(x='coalesce(m.z, 0)', mu='s.mu', sd='s.sigma')} + {AUG_NOISE} as x from y cross join stats s left join masked m on m.cell_id = y.cell_id and m.gene_id = s.gene_id",
))
def augmented_batch(spark, d):
    """Sums over the genes of a masked and noisy epoch's rows, and over the clean counts beside them."""
    from tessera.operators import augment as A

    from tessera.sources import artifacts

    rows, fitted = cells_y(spark, d).select("cell_id", "y"), artifacts.written(stats(spark, d, log=True), "stats")
    frame = A.rows(D.counts(spark, d), rows, fitted, 0.2, seed=3, epoch=2)
    return rounded(A.sums(frame, fitted, 0.05, seed=3, epoch=2).select("cell_id", "y", "total", "squares", "most", "clean", "placed"))


SAMPLES = ("A", "N", "R")


#: Each sample lacks some genes that the others have.
LACKS = "not (l_returnflag = 'R' and l_linenumber = 1) and not (l_returnflag = 'A' and l_linenumber = 2)"


@query(
    "select l_returnflag || '_' || l_suppkey as cell_id, 'g' || l_linenumber || '_' || round(l_discount * 100)::int as gene_name, sum(l_quantity)::double as value, l_returnflag as sample, any_value(n_name) as nation "
    f"from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where {LACKS} group by 1, 2, 4"
)
def text_samples(spark, d):
    """Three samples written as gene by cell text and read back, with metadata of their cells."""
    from tessera.sources import artifacts, matrices

    gene = F.concat(F.lit("g"), F.col("l_linenumber").cast("string"), F.lit("_"), F.round(F.col("l_discount") * 100).cast("int").cast("string"))
    rows = D.read(spark, d, "lineitem").where(LACKS).groupBy("l_returnflag", F.col("l_suppkey").cast("string").alias("cell_id"), gene.alias("gene_name")).agg(F.sum("l_quantity").cast("double").alias("value"))
    rows = artifacts.written(rows, "samples")
    paths = {}
    for s in SAMPLES:
        paths[s] = artifacts.scratch(spark, f"sample-{s}")
        matrices.write_sample(rows.where(F.col("l_returnflag") == s).drop("l_returnflag"), paths[s])
    nation = D.read(spark, d, "supplier").join(D.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    about = nation.select(F.explode(F.array(*[F.concat(F.lit(f"{s}_"), F.col("s_suppkey").cast("string")) for s in SAMPLES])).alias("cell_id"), F.col("n_name").alias("nation"))
    counts, cells, _ = matrices.read_samples(spark, paths, about)
    return counts.join(cells, "cell_id").select("cell_id", "gene_name", "value", "sample", "nation")


@query("select query, rank, id, round(distance, 6) + 0.0::double as distance from (select *, (row_number() over (partition by query order by distance, id) - 1)::int as rank from (select q.vec_id as query, p.vec_id as id, list_distance(q.embedding::double[], p.embedding::double[]) as distance from embeddings q join embeddings p on q.vec_id <> p.vec_id)) where rank < 5")
def nearest_neighbours(spark, d):
    """The five nearest rows of each row, all shards asked."""
    from tessera.operators import neighbours as K

    rows = D.dense(spark, d).select(F.col("cell_id").alias("id"), F.col("x").alias("vec"))
    return rounded(K.nearest(spark, rows, rows, 5, n_pivots=16, part=1024))


@query(None)
def doublet_scores(spark, d):
    """Scores of all cells; their projections' neighbours are searched in 64 of at most 512 shards each."""
    from tessera.operators import neighbours as K
    from tessera.sources import artifacts

    rows, counts = artifacts.written(cells_y(spark, d).select("cell_id"), "cells"), artifacts.written(D.counts(spark, d), "counts")
    return rounded(K.doublet_scores(spark, counts, rows, artifacts.written(stats(spark, d, log=True), "stats")))


# -- Training control --------------------------------------------------------------------

LOG = "select e.event_type as run, row_number() over (partition by e.event_type order by e.ts_day) - 1 as epoch, round(v, 3) as score from (select event_type, date_trunc('day', ts) as ts_day, avg(value) as v from events group by 1, 2) e"


def epoch_log(spark, d) -> DataFrame:
    """A log of runs from the events: one run a type, one epoch a day."""
    from pyspark.sql import Window

    rows = D.read(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 3).alias("score"))
    return rows.select("run", (F.row_number().over(Window.partitionBy("run").orderBy("day")) - 1).cast("long").alias("epoch"), "score")


@query(sql(
    "select run, epoch, score, best, epoch - hi as wait, epoch - hi >= 5 as stop from (select *, max(case when better then epoch end) over (partition by run order by epoch) as hi from (select *, max(score) over (partition by run order by epoch) as best, coalesce(score > max(score) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), true) as better from log))",
    log=LOG,
))
def early_stopping(spark, d):
    return T.early_stopping(epoch_log(spark, d), 5)


@query(sql("select run, epoch, score from (select *, row_number() over (partition by run order by score desc, epoch) as r from log) where r = 1", log=LOG))
def best_epoch(spark, d):
    return T.best_epoch(epoch_log(spark, d))


TRIALS = "select user_id as trial, row_number() over (partition by user_id order by ts, event_id) - 1 as step, value as score from events"


def trial_log(spark, d) -> DataFrame:
    from pyspark.sql import Window

    step = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return D.read(spark, d, "events").select(F.col("user_id").alias("trial"), step.alias("step"), F.col("value").alias("score"))


@query(sql(
    f"select b.trial, b.step, {R('b.best')} as best, {R('c.cutoff')} as cutoff, b.step >= 5 and b.trial >= 5 and c.reports >= 5 and b.best < c.cutoff as prune from best b join (select step, quantile_cont(best, 0.4) as cutoff, count(*) as reports from best group by 1) c on b.step = c.step",
    log=TRIALS, best="select *, max(score) over (partition by trial order by step) as best from log",
))
def percentile_prune(spark, d):
    return rounded(T.percentile_prune(trial_log(spark, d)))


SCHEDULES = ("constant", "step", "exponential", "cosine", "onecycle")


@query(
    "select kind, e as epoch, round(case kind when 'constant' then 1e-3 when 'step' then 1e-3 * pow(0.1, e // 10) when 'exponential' then 1e-3 * pow(0.95, e) when 'cosine' then 1e-6 + (1e-3 - 1e-6) * (1 + cos(pi() * e / 30)) / 2 else case when e < 9 then 1e-3 * (0.04 + 0.96 * e / 9) else 1e-6 + (1e-3 - 1e-6) * (1 + cos(pi() * (e - 9) / 21)) / 2 end end::double, 9)::double as lr from (values ('constant'), ('step'), ('exponential'), ('cosine'), ('onecycle')) k(kind), range(0, 30) t(e)"
)
def lr_schedule(spark, d):
    rows = [(k, e, round(T.lr_schedule(k, e, 30), 9)) for k in SCHEDULES for e in range(30)]
    return spark.createDataFrame(rows, "kind string, epoch long, lr double")


@query(sql("select state, count(*) as n, arg_max(trial, [score, -trial]) as best_trial, max(score) as best_score from t group by 1", t="select o_orderkey as trial, o_orderstatus as state, o_totalprice as score from orders"))
def trial_summary(spark, d):
    rows = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("score"))
    return T.trial_summary(rows)


@query("select p_partkey, p_type, trim(lower(replace(replace(' \"' || p_type || '\" ', '\"', ''), '''', ''))) as model_type, regexp_replace('12_' || p_name, '^[0-9]+_(.+)$', '\\1') as file_name from part")
def clean_model_type(spark, d):
    from tessera.functions.text import clean_tag, without_number

    rows = D.read(spark, d, "part")
    quoted = F.concat(F.lit(' "'), "p_type", F.lit('" '))
    return rows.select("p_partkey", "p_type", clean_tag(quoted).alias("model_type"), without_number(F.concat(F.lit("12_"), "p_name")).alias("file_name"))


@query("select o_orderkey, case when s // 3600 < 100 then lpad((s // 3600)::varchar, 2, '0') else (s // 3600)::varchar end || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as elapsed from (select o_orderkey, floor(o_totalprice)::bigint as s from orders)")
def elapsed_format(spark, d):
    from tessera.functions.text import elapsed

    return D.read(spark, d, "orders").select("o_orderkey", elapsed(F.floor("o_totalprice")).alias("elapsed"))


# -- Estimators (no SQL: iterative) ------------------------------------------------------


def _labelled(spark, d) -> DataFrame:
    return D.dense(spark, d).select("cell_id", "x", (F.col("label") < 3).cast("int").alias("y"))


def _estimated(spark, d, model_type: str) -> DataFrame:
    from tessera.models import estimators as X

    rows = X.features(X.weighted(_labelled(spark, d)))
    return X.predict(model_type, X.fit(model_type, rows), rows).select("cell_id", "y", F.round("p", 4).alias("p"))


@query(None)
def lr_fit_predict(spark, d):
    return _estimated(spark, d, "logistic")


@query(None)
def svc_fit_predict(spark, d):
    return _estimated(spark, d, "svm")


@query(None)
def gbt_fit_predict(spark, d):
    return _estimated(spark, d, "gbt")


@query(None)
def mlp_forward(spark, d):
    from tessera.models import network

    rows = _labelled(spark, d)
    weights, _ = network.train_mlp(spark, rows, network.MlpParams(layers=(16,), epochs=5))
    return network.predict(spark, rows, weights)


@query(None)
def ae_forward(spark, d):
    from tessera.models import network

    rows = _labelled(spark, d)
    weights, _ = network.train_ae(spark, rows, network.AeParams(hidden=(16,), latent=4, epochs=5))
    return network.ae_predict(spark, rows, weights)


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: sparse linear scores of all cells, evaluated overall and by stratum."""
    scores = sparse_scores(spark, d).select("cell_id", "p")
    rows = cells_y(spark, d).select("cell_id", "y", "imputed_labels", "tissue_type").join(scores, "cell_id")
    return rounded(E.report(rows))
