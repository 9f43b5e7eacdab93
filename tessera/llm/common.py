"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.artifacts import shared_dir

#: Words of the corpus contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folders of the ``passing`` blocks that are open, the innermost last.
_open: ContextVar[tuple[str, ...]] = ContextVar("open", default=())


def new_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A path in the shared folder that no other run uses; inside ``passing`` blocks one that
    goes with the innermost, or (``outlives``) with the one around it."""
    folders = _open.get()[:-1] if outlives else _open.get()
    return f"{folders[-1] if folders else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside the block are deleted at its end, but for those
    that outlive it: nothing else may leave the block but rows of such tables."""
    path, outer = new_path(spark, "passing"), _open.get()
    _open.set((*outer, path))
    try:
        yield
    finally:
        _open.set(outer)
        delete(spark, path)


def written(spark: SparkSession, df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it back,
    so that a lost executor costs a re-read and not a re-run of what came before."""
    path = new_path(spark, name, outlives)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once what is read from them has been written itself."""
    for table in tables:
        delete(spark, table._written_to)


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def boxed(docs: DataFrame, *open_: str) -> DataFrame:
    """``docs`` with its columns in one, ``box``, but for those named: columns that an operator
    adds can't clash with what a table has besides."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in open_]
    return docs.select(F.struct(*rest).alias("box") if rest else F.struct(F.lit(0).alias("_")).alias("box"), *open_)


def unboxed(df: DataFrame, columns: list[str], *open_: str) -> DataFrame:
    """The columns as they were, those named from outside the box."""
    return df.select(*[F.col(c) if c in open_ else F.col("box").getField(c).alias(c) for c in columns])


#: Rows up to which a side is broadcast, after a count of it; beyond, it is shuffled.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows, else as it is.
    The caller passes narrow rows (a few numbers each) that are already written."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(rows: DataFrame, groups: DataFrame, key: str, own: str) -> DataFrame:
    """``rows`` joined with their ``groups`` by ``key``; ``own`` is a group's number of rows.

    A group that holds a thousandth of all these rows or more is broadcast (there are at
    most a thousand of them), so that its rows stay where they are; the others are shuffled."""
    total = groups.agg(F.sum(own)).first()[0] or 0
    large = groups.where(F.col(own) * 1000 >= total)
    if large.isEmpty():
        return rows.join(groups, key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.where(F.col(own) * 1000 < total), key)
    return rows.join(F.broadcast(large), key).unionByName(rest)


def ascii_lower(col):
    """Lower-cases A-Z only, as the contracts ask."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(df: DataFrame, part: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over all rows before, by ``part`` and then ``order``.

    ``part`` numbers slices of the rows, each of a task's size; a window runs inside each,
    and only one total per slice (as many as there were tasks) meets in one place."""
    from pyspark.sql import Window

    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = df.groupBy(part).agg(F.sum(value).alias("_total"))
    base = total.select(part, F.coalesce(F.sum("_total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return inside.join(F.broadcast(base), part).withColumn(out, F.col("_base") + F.col("_inside")).drop("_base", "_inside")
