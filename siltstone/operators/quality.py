"""Measures of signals and textures, and the arithmetic of mip chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def power_sums(signal: Column, noisy: Column, scale: int = 1_000_000) -> tuple[Column, Column]:
    """Sums of squares of a signal and of its difference from another array, in fixed point so that sums don't depend on order."""
    fix = lambda x: F.floor(x * scale + F.lit(0.5)).cast("long")
    s, t = F.transform(signal, fix), F.transform(noisy, fix)
    total = lambda a: F.aggregate(a, F.lit(0).cast("decimal(38,0)"), lambda x, y: (x + y).cast("decimal(38,0)"))
    square = lambda x: (x * x).cast("decimal(38,0)")
    return total(F.transform(s, square)), total(F.zip_with(s, t, lambda x, y: square(x - y)))


def snr_db(signal: Column, error: Column) -> Column:
    """10 log10(signal / error); infinite without error, null without signal."""
    return F.when(error == 0, F.lit(float("inf"))).when(signal > 0, 10 * F.log10(signal / error))


def psnr_db(error: Column, n: Column, peak: float = 255.0) -> Column:
    return F.when(error == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) * n / error))


def median_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("n"))


def mip_bytes(width: Column, height: Column, block: int, block_bytes: int, levels: Column) -> Column:
    """Bytes of a chain of ``levels`` mips of blocks of block x block."""
    chain = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.when(k < levels, F.floor((F.greatest(F.lit(1), F.floor(width / F.pow(F.lit(2), k))) + (block - 1)) / block) * F.floor((F.greatest(F.lit(1), F.floor(height / F.pow(F.lit(2), k))) + (block - 1)) / block) * block_bytes).otherwise(0).cast("long"))
    return F.aggregate(chain, F.lit(0).cast("long"), lambda a, x: a + x)


def effective_edge(width: Column, height: Column, cap: Column) -> Column:
    """An edge limit that halves a texture at most."""
    return F.greatest(cap, F.ceil(F.greatest(width, height) / 2)).cast("long")


def small_or_thin(width: Column, height: Column) -> Column:
    return (F.greatest(width, height) <= 512) | (F.least(width, height) <= 64)


def mip_count(width: Column, height: Column, before: Column) -> Column:
    """The mips of a new size: none if there were none, else the whole log2 of the longer edge."""
    return F.when(before == 0, 0).otherwise(F.length(F.bin(F.greatest(width, height))) - 1)


def scaled(width: Column, height: Column, edge: Column, rounding: str = "nearest") -> tuple[Column, Column]:
    """Dimensions scaled to an edge limit with their aspect: rounded to the ``nearest``, ``truncated``, or ``half_up`` in whole numbers."""
    longest = F.greatest(width, height)

    def one(n: Column) -> Column:
        if rounding == "half_up":
            new = F.floor((n * edge * 2 + longest) / (longest * 2))
        elif rounding == "truncated":
            new = F.floor(n * edge / longest)
        else:
            new = F.floor(n * edge / longest + 0.5)
        return F.when(longest <= edge, n).otherwise(F.greatest(F.lit(1), new)).cast("long")

    return one(width), one(height)


def stream_gain(new: Column, seek: Column, old: Column, least_pct: Column) -> Column:
    """Whether a stream with its seek table is smaller than the old by more than ``least_pct`` percent."""
    return (new + seek) * 100 < old * (100 - least_pct)
