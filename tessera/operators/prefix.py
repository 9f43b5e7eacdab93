"""Running sums that no single task has to sort.

Rows fall in buckets that follow the order (a prefix of a hash, a range of ids or scores).
A window runs inside each bucket; a second one runs over one total per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of an md5 that make a bucket: 4,096 of them.
DIGITS = 3


def running_sum(rows: DataFrame, keys: list[str], bucket: Column, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys before this one.
    Keys must not be null; buckets must follow ``order``."""
    rows = rows.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*keys).orderBy("_bucket") if keys else Window.orderBy("_bucket")
    base = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(base, [*keys, "_bucket"]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_bucket", "_base", "_inside")


def place(rows: DataFrame, keys: list[str], bucket: Column, order: list, out: str = "place") -> DataFrame:
    """Adds the place (from 0) of each row among those of its keys."""
    counted = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), keys, bucket, order, "_one", out)
    return counted.drop("_one")


def hash_bucket(h: str) -> Column:
    return F.substring(h, 1, DIGITS)
