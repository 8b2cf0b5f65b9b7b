"""Ranks and running sums in two levels: within buckets that follow the order, and over the buckets' totals.

A window without buckets brings a key's rows (or all rows) into one task. With a bucket that never decreases along the order, each task holds one bucket's rows, and only one row a bucket meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(df: DataFrame, keys: list[str], amount: Column, descending: bool) -> DataFrame:
    """The total of ``amount`` in the buckets ahead of each."""
    totals = df.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_total"))
    order = F.desc_nulls_last("_bucket") if descending else F.asc_nulls_last("_bucket")
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(window), F.lit(0))).drop("_total")
    return found.select(*[F.col(k).alias(f"_{i}k") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_ahead")


def _joined(df: DataFrame, keys: list[str], amount: Column, descending: bool) -> DataFrame:
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_{i}k"))
    return df.join(_before(df, keys, amount, descending), same).drop("_b", *[f"_{i}k" for i in range(len(keys))])


def row_number(df: DataFrame, bucket: Column, order: list, out: str = "place", descending: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Row numbers in a total order; ``bucket`` follows it (the other way round if ``descending``), nulls last."""
    keys = keys or []
    rows = df.withColumn("_bucket", bucket)
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return _joined(rows.withColumn("_in", inside), keys, F.lit(1), descending).withColumn(out, (F.col("_ahead") + F.col("_in")).cast("long")).drop("_bucket", "_in", "_ahead")


def running(df: DataFrame, keys: list[str], bucket: Column, order: list, amount: Column, out: str, inclusive: bool = False) -> DataFrame:
    """The sum of ``amount`` over the rows before each (or up to it) in its key's order; ``bucket`` follows the order."""
    rows = df.withColumn("_bucket", bucket).withColumn("_amount", amount)
    window = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inside = F.coalesce(F.sum("_amount").over(window), F.lit(0))
    return _joined(rows.withColumn("_in", inside), keys, F.col("_amount"), False).withColumn(out, F.col("_ahead") + F.col("_in")).drop("_bucket", "_amount", "_in", "_ahead")
