"""Rows chosen by key: latest views, last writes, first-seen distinct rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key with the greatest ``order`` (last column as tie rule), by one partial aggregation; nulls come first."""
    rest = [c for c in df.columns if c not in keys]
    first = [c for c in order if c in rest]
    packed = F.struct(*first, *[c for c in rest if c not in first])
    best = df.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def last_write_wins(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row written last for each key, whatever its time stamp says."""
    return latest_per_key(df, keys, sequence)


def max_stamp_per_key(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(stamp).alias(stamp))


def ordered_distinct(df: DataFrame, key: str, sequence: str, place: str = "place") -> DataFrame:
    """Each key once, in the order in which it was first seen."""
    first = df.groupBy(key).agg(F.min(sequence).alias("first_seen"))
    return first.withColumn(place, F.row_number().over(Window.orderBy("first_seen", key)))


def uniqueness_violations(df: DataFrame, key) -> DataFrame:
    """Keys (a Column, such as a case-folded name) that occur more than once."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def only_once(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n = 1").select(key), key, "left_semi")
