"""Range and as-of joins as equi-joins, and layouts by prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_blocks(chunks: DataFrame, offset: str, length: str, block: int) -> DataFrame:
    """A row for each block of fixed size that a chunk touches; empty chunks touch none."""
    first = F.floor(F.col(offset) / block)
    last = F.floor((F.col(offset) + F.col(length) - 1) / block)
    return chunks.filter(F.col(length) > 0).withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def range_join(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, bin_size: int) -> DataFrame:
    """Points inside [start, end): both sides are put into bins, joined on the bin and filtered, so no nested loop is planned."""
    own = points.withColumn("_bin", F.floor(F.col(point) / bin_size))
    spread = ranges.filter(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size))))
    return own.join(spread, "_bin").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, value: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it (greatest ``value`` among equals), by one union and window."""
    tagged = right.select(*keys, F.col(right_on).alias("_at"), F.struct(F.col(right_on).alias("_at"), *value).alias("_right"), F.lit(None).cast("string").alias("_left"), F.lit(0).alias("_side"))
    packed = left.select(*keys, F.col(left_on).alias("_at"), F.lit(None).cast(tagged.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"), F.lit(1).alias("_side"))
    both = tagged.withColumn("_left", F.lit(None).cast(packed.schema["_left"].dataType)).unionByName(packed)
    before = Window.partitionBy(*keys).orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(before)).filter("_side = 1")
    return found.select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in value])


def running(df: DataFrame, keys: list[str], order: list[str], amount: Column, out: str, inclusive: bool = False) -> DataFrame:
    """The sum of ``amount`` over the rows before each (or up to it) in its key's order."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(out, F.coalesce(F.sum(amount).over(window), F.lit(0)))


def align_up(x: Column, step: int) -> Column:
    return F.floor((x + (step - 1)) / step).cast("long") * step


def relocate(points: DataFrame, point: str, removed: DataFrame, start: str, length: str, keys: list[str]) -> DataFrame:
    """Offsets after removed extents are taken out: less what was removed before them; inside a removed extent there is none (status INSIDE_REMOVED)."""
    ends = running(removed, keys, [start], F.col(length), "_before")
    found = asof_join(points, ends, keys, point, start, [start, length, "_before"])
    inside = F.col(start).isNotNull() & (F.col(point) < F.col(start) + F.col(length))
    moved = F.col(point) - F.when(F.col(start).isNull(), 0).otherwise(F.col("_before") + F.col(length))
    return found.withColumn("status", F.when(inside, "INSIDE_REMOVED").otherwise("MOVED")).withColumn("new_offset", F.when(~inside, moved)).drop(start, length, "_before")
