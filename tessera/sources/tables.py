"""The data model on the star-schema tables: counts, cells, genes, dense rows, scored rows.

A count matrix is three tables: ``counts`` (cell_id, gene_id, value; non-zeros only),
``cells`` (one row a cell, with or without counts) and ``genes`` (gene_id, gene_name,
gene_idx; the order of genes is ``gene_idx`` and nothing else).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero entries; a cell is an order, a gene a supplier, the value a sum of quantities."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_suppkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, gene_name, gene_idx), in order of gene_id."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gene_id"), F.col("s_name").alias("gene_name"))
    return rows.withColumn("gene_idx", (F.row_number().over(Window.orderBy("gene_id")) - 1).cast("long"))


def target_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted gene list (gene_id, gene_idx) that differs from the data's: some of its genes,
    in another order, and genes that the data lack (negative ids)."""
    have = read(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("gene_id"), F.col("s_acctbal").alias("k"))
    lack = read(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("gene_id"), F.lit(-1.0).alias("k"))
    order = Window.orderBy(F.col("k").desc(), "gene_id")
    return have.union(lack).withColumn("gene_idx", (F.row_number().over(order) - 1).cast("long")).drop("k")


def clone_sizes(cells: DataFrame) -> DataFrame:
    """(sample, clone_id, clone_id_size, median_clone_size): cells of each clone of a sample,
    and the exact median of that number over the sample's clones."""
    size = cells.groupBy("sample", "clone_id").agg(F.count("*").alias("clone_id_size"))
    medians = size.groupBy("sample").agg(F.median("clone_id_size").alias("median_clone_size"))
    return size.join(F.broadcast(medians), "sample")  # a row a sample: joined by key, a sample's clones would lie in one task


def cells(spark: SparkSession, sf_dir: str, ratio: float = 1.5) -> DataFrame:
    """One row a cell: study, sample, patient, cancer_type, tissue_type, imputed_labels, clone
    sizes and ``expansion`` (clone larger than ``ratio`` times the sample's median)."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    person = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = read(spark, sf_dir, "orders").join(person, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("cell_id"), F.col("n_name").alias("study"), F.col("n_name").alias("sample"), F.col("c_name").alias("patient"), F.col("c_mktsegment").alias("cancer_type"),
        F.col("o_orderstatus").alias("tissue_type"), F.col("o_orderpriority").alias("imputed_labels"), F.col("o_custkey").alias("clone_id"),
    )
    out = rows.join(clone_sizes(rows), ["sample", "clone_id"])
    return out.withColumn("expansion", F.when(F.col("clone_id_size") > ratio * F.col("median_clone_size"), "expanded").otherwise("not_expanded"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, x array<double>, label) from the embeddings."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, y, p, imputed_labels, tissue_type): labelled documents with a probability of
    three decimals (so that scores tie) from their length."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    p = F.round(1 / (1 + F.exp((F.lit(1500.0) - F.col("n_chars")) / 1500.0)), 3)
    return rows.select(F.col("doc_id").alias("cell_id"), F.col("quality").alias("y"), p.alias("p"), F.col("lang").alias("imputed_labels"), F.col("source").alias("tissue_type"))


#: The same tables in SQL, as common table expressions.
SQL = {
    "counts": "select l_orderkey as cell_id, l_suppkey as gene_id, sum(l_quantity) as value from lineitem group by 1, 2",
    "genes": "select s_suppkey as gene_id, s_name as gene_name, row_number() over (order by s_suppkey) - 1 as gene_idx from supplier",
    "target": "select gene_id, row_number() over (order by k desc, gene_id) - 1 as gene_idx from (select s_suppkey as gene_id, s_acctbal as k from supplier where s_acctbal >= 0 union all select (-n_nationkey - 1)::bigint, -1.0::double from nation)",
    "base": "select o_orderkey as cell_id, n_name as study, n_name as sample, c_name as patient, c_mktsegment as cancer_type, o_orderstatus as tissue_type, o_orderpriority as imputed_labels, o_custkey as clone_id from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "sizes": "select sample, clone_id, count(*) as clone_id_size from base group by 1, 2",
    "clones": "select s.*, m.median_clone_size from sizes s join (select sample, median(clone_id_size) as median_clone_size from sizes group by 1) m on s.sample = m.sample",
    "cells": "select b.*, c.clone_id_size, c.median_clone_size, case when c.clone_id_size > 1.5 * c.median_clone_size then 'expanded' else 'not_expanded' end as expansion from base b join clones c on b.sample = c.sample and b.clone_id = c.clone_id",
    "dense": "select vec_id as cell_id, embedding, label from embeddings",
    "entries": "select cell_id, j - 1 as gene_idx, embedding[j]::double as x from dense, range(1, 65) t(j)",
    "scored": "select d.doc_id as cell_id, l.quality as y, round(1 / (1 + exp((1500.0::double - d.n_chars) / 1500.0::double)), 3) as p, d.lang as imputed_labels, d.source as tissue_type from documents d join labels l on d.doc_id = l.doc_id",
}
NEEDS = {"sizes": ["base"], "clones": ["sizes"], "cells": ["base", "clones"], "entries": ["dense"]}


def sql(body: str, *tables: str, **own: str) -> str:
    """A query over some of the tables above, and further named ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    parts = [f"{t} as ({SQL[t]})" for t in order] + [f"{k} as ({v})" for k, v in own.items()]
    return f"with {', '.join(parts)} {body}" if parts else body
