"""Keyed lookups with precedence rules, upserts and reference resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hint_join(rows: DataFrame, hints: DataFrame, on: list[str], local: str, hint: str, allowed: Column, out: str = "hint") -> DataFrame:
    """``rows`` with the hint of all keys in ``on``, only where there is no local value and ``allowed`` holds; keys must match exactly."""
    found = rows.join(hints.select(*on, F.col(hint).alias("_hint")), on, "left")
    return found.withColumn(out, F.when(F.col(local).isNull() & allowed, F.col("_hint"))).drop("_hint")


def two_level(rows: DataFrame, near: DataFrame, near_key: str, far: DataFrame, far_key: str, value: str, default, out: str) -> DataFrame:
    """The value by the nearer key, else by the farther key, else the default."""
    found = rows.join(near.select(near_key, F.col(value).alias("_near")), near_key, "left").join(far.select(far_key, F.col(value).alias("_far")), far_key, "left")
    return found.withColumn(out, F.coalesce("_near", "_far", F.lit(default))).drop("_near", "_far")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of the same keys replaced and new ones added."""
    return table.join(rows.select(key), key, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def one_hop(names: DataFrame, name: str, references: DataFrame, source: str, target: str) -> DataFrame:
    """The names and what they refer to, one step and no further: what a target refers to in turn is not followed."""
    direct = names.select(F.col(name).alias("path"))
    hops = references.join(names.select(F.col(name).alias(source)), source, "left_semi").select(F.col(target).alias("path"))
    return direct.unionAll(hops).distinct()


def prefix_matches(lines: DataFrame, line: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Pairs where a line starts with ``prefix`` and a slash: an equi-join on every leading part of the line, so no nested loop is planned."""
    parts = F.split(F.col(line), "/")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return lines.withColumn(prefix, F.explode(heads)).join(prefixes.select(prefix).distinct(), prefix, "left_semi")
