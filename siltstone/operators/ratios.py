"""Ratio tables: leaderboards, summaries, exports and weighted merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    """A money column as whole cents, halves up, so that sums don't depend on their order."""
    return F.floor(x * 100 + F.lit(0.5)).cast("long")


def leaderboard(df: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """Sums before and after of each key with a positive sum before, and the share saved; rank it by (saved, name), both descending."""
    sums = df.groupBy(key).agg(F.sum(before).alias("before"), F.sum(after).alias("after")).filter("before > 0")
    return sums.withColumn("saved", F.col("before") - F.col("after")).withColumn("saved_bp", F.expr("(saved * 10000) div before"))


def summary(board: DataFrame, key: str, threshold: int) -> DataFrame:
    """One row: totals, how many reach ``threshold`` basis points, and the best key (the first by name among equals; none unless above 0)."""
    best = F.min(F.when(F.col("saved_bp") > 0, F.struct((-F.col("saved_bp")).alias("n"), F.col(key).alias("k"))))
    return board.agg(F.count("*").alias("n_keys"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum("saved").alias("saved"), F.count_if(F.col("saved_bp") >= threshold).alias("n_over"), best.alias("b")).select("n_keys", "before", "after", "saved", "n_over", F.col("b.k").alias("best_key"), (-F.col("b.n")).alias("best_bp"))


def grouped_stats(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Count, sum, least and greatest of each group; means are sums over counts."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def weighted_merge(target: DataFrame, incoming: DataFrame, keys: list[str], digits: int | None = 1) -> DataFrame:
    """Full outer merge of (keys, pct, samples, min, max): means weighted by samples, samples added, ranges widened.

    Missing or zero samples count as one; a missing range is the mean itself. ``digits`` None leaves the mean unrounded. Rounding makes the merge of several documents depend on their order.
    """
    both = target.alias("t").join(incoming.alias("i"), keys, "full")

    def side(name: str, field: str) -> Column:
        weight = F.when(F.coalesce(F.col(f"{name}.samples"), F.lit(0)) > 0, F.col(f"{name}.samples")).otherwise(1)
        return {"w": weight, "lo": F.coalesce(F.col(f"{name}.min"), F.col(f"{name}.pct")), "hi": F.coalesce(F.col(f"{name}.max"), F.col(f"{name}.pct")), "p": F.col(f"{name}.pct")}[field]

    weight = side("t", "w") + side("i", "w")
    mean = (side("t", "p") * side("t", "w") + side("i", "p") * side("i", "w")) / weight
    shown = mean if digits is None else F.round(mean, digits)
    status = F.when(F.col("t.pct").isNull(), "new").when(F.col("i.pct").isNull(), "kept").otherwise("updated")
    samples = F.when(status == "updated", weight).when(status == "new", side("i", "w")).otherwise(side("t", "w"))
    return both.select(
        *keys,
        F.when(status == "updated", shown).otherwise(F.coalesce("t.pct", "i.pct")).alias("pct"),
        samples.cast("long").alias("samples"),
        F.least(side("t", "lo"), side("i", "lo")).alias("min"),
        F.greatest(side("t", "hi"), side("i", "hi")).alias("max"),
        status.alias("status"),
    )
