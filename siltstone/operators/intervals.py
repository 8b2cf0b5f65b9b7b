"""Interval arithmetic by key: unions, islands, overlaps, clipped usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_union(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Of each key: ranges, total and union length, repeated ranges (aliases), islands of two or more different ranges (overlap_groups).

    Empty ranges are left out; touching ranges make two islands. Equal ranges are counted first, so a window only orders different ranges of a key.
    """
    each = df.filter(F.col(end) > F.col(start)).groupBy(*keys, start, end).agg(F.count("*").alias("copies"))
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("reach", reach).withColumn("new", (F.col("reach").isNull() | (F.col("reach") <= F.col(start))).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy(*keys, "island").agg((F.max(end) - F.min(start)).alias("covered"), F.count("*").alias("kinds"), F.sum("copies").alias("copies"), F.sum((F.col(end) - F.col(start)) * F.col("copies")).alias("length"))
    return islands.groupBy(*keys).agg(
        F.sum("copies").alias("ranges"), F.sum("length").alias("total_length"), F.sum("covered").alias("union_length"),
        F.sum(F.col("copies") - F.col("kinds")).alias("aliases"), F.count_if(F.col("kinds") > 1).alias("overlap_groups"),
    )


def overlap_flags(df: DataFrame, keys: list[str], start: str, end: str, *tie: str) -> DataFrame:
    """Each non-empty range and whether it begins before the one ahead of it ends."""
    order = Window.partitionBy(*keys).orderBy(start, end, *tie)
    return df.filter(F.col(end) > F.col(start)).withColumn("overlaps", F.coalesce(F.lag(end).over(order) > F.col(start), F.lit(False)))


def distinct_address_sizes(df: DataFrame, keys: list[str], address: str, once: list[str], always: list[str]) -> DataFrame:
    """Sums in which ``once`` counts one time for each address that isn't 0, ``always`` for every row with such an address."""
    real = df.filter(F.col(address) != 0)
    each = real.groupBy(*keys, address).agg(*[F.min(c).alias(c) for c in once], *[F.sum(c).alias(c) for c in always])
    return each.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*once, *always)])


def clipped_usage(df: DataFrame, keys: list[str], length: Column, room: Column, shared: Column) -> DataFrame:
    """Total, exclusive and shared bytes of extents clipped to the room left in their file."""
    size = F.greatest(F.lit(0), F.least(length, room))
    return df.groupBy(*keys).agg(F.sum(size).alias("total"), F.sum(F.when(shared, 0).otherwise(size)).alias("exclusive"), F.sum(F.when(shared, size).otherwise(0)).alias("shared"))
