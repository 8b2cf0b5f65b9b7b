"""Groups of equal content: block duplicates, exact copies, suites of equal members, reclaimable space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_blocks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Whole blocks of ``size`` characters of a text: (key, block offset, block); a shorter rest is no block."""
    # The text is cut once, in time in proportion to its length, and not carried into each block's row.
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{{size}}}"), F.lit(0))
    return df.select(key, F.posexplode(blocks).alias("block", "content")).select(key, (F.col("block") * size).cast("long").alias("offset"), "content")


def duplicate_candidates(blocks: DataFrame, group: list[str], file: str, offset: str) -> DataFrame:
    """Every block but the first of its group (by file, then offset), with that first one's place.

    The first is found by an aggregation and joined to the rows, so a group of any size can be spread over tasks.
    """
    firsts = blocks.groupBy(*group).agg(F.min(F.struct(F.col(file).alias("f"), F.col(offset).alias("o"))).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    paired = blocks.join(firsts, group).filter(F.struct(F.col(file).alias("f"), F.col(offset).alias("o")) > F.col("_first"))
    return paired.select(*blocks.columns, F.col("_first.f").alias(f"first_{file}"), F.col("_first.o").alias(f"first_{offset}"))


def duplicate_totals(blocks: DataFrame, group: list[str], length: Column) -> DataFrame:
    """One row: groups of two or more, blocks beyond the first of each, and their bytes."""
    sizes = blocks.groupBy(*group).agg(F.count("*").alias("n"), F.max(length).alias("len")).filter("n > 1")
    return sizes.agg(F.count("*").alias("n_groups"), F.sum(F.col("n") - 1).alias("candidates"), F.sum((F.col("n") - 1) * F.col("len")).alias("matched"))


def copies(df: DataFrame, key: str, group: list[Column], names: list[str]) -> DataFrame:
    """Groups of two or more equal rows: the smallest key, and how many there are."""
    return df.groupBy(*[g.alias(n) for g, n in zip(group, names)]).agg(F.min(key).alias("keep_id"), F.count("*").alias("n")).filter("n > 1")


def set_equality(df: DataFrame, parent: str, member: str) -> DataFrame:
    """(members, n, least_parent): sets of members that two or more parents share exactly. A parent's members are one array.

    Parents are first grouped by two hashes of their sorted members and their number; only those of groups of two or more are then told apart by the members themselves.
    """
    sets = df.groupBy(parent).agg(F.array_sort(F.collect_set(member)).alias("members"))
    sets = sets.select(parent, "members", F.xxhash64("members").alias("_h"), F.hash("members").alias("_g"), F.size("members").alias("_n"))
    several = sets.groupBy("_h", "_g", "_n").agg(F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    alike = sets.join(several, ["_h", "_g", "_n"], "left_semi")
    return alike.groupBy("members").agg(F.count("*").alias("n"), F.min(parent).alias("least_parent")).filter("n > 1")


def reclaim(df: DataFrame, group: list[str], size: str) -> DataFrame:
    """What keeping only the largest of a group would free."""
    return df.groupBy(*group).agg(F.sum(size).alias("total"), F.max(size).alias("largest"), F.count("*").alias("n")).withColumn("reclaim", F.col("total") - F.col("largest"))


def distinct_having(df: DataFrame, group: list[str], value: str, least: int) -> DataFrame:
    return df.groupBy(*group).agg(F.count_distinct(value).alias("n_distinct"), F.count("*").alias("n")).filter(F.col("n_distinct") >= least)


def limit_then_filter(df: DataFrame, order: list, n: int, keep: Column) -> DataFrame:
    """The first ``n`` rows in order, and of those the ones that ``keep`` holds for; the filter never moves below the limit."""
    return df.orderBy(*order).limit(n).filter(keep)


def page_of_rows(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A page of rows, counted from 0, in a total order."""
    return df.orderBy(*order).offset(page * size).limit(size)


def even_places(df: DataFrame, keys: list[str], place: str, most: int) -> DataFrame:
    """Of rows numbered from 1 in each key, every ceil(n / most)-th, numbered from 0."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("long").alias("_step"))
    return df.join(sizes, keys).withColumn(place, (F.col(place) - 1).cast("long")).filter(F.col(place) % F.col("_step") == 0).drop("_step")


def cutoff_message(df: DataFrame, keys: list[str], order: list[str], text: str, most: int) -> DataFrame:
    """Texts joined in order; once the text so far has ``most`` characters no more are added, only counted."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.char_length(text) + 2).over(own), F.lit(0)) - F.when(F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1, 2).otherwise(0)
    marked = df.withColumn("_in", before < most)
    return marked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct(*order, text)))), lambda x: x[text]), ", ").alias("message"), F.count_if(~F.col("_in")).alias("more"))
