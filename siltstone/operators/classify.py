"""Rules that give each row one status, and the gates that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING = ("COMPRESSED", "UPDATED", "UNCOMPRESSED")


def status(stamp: Column, newer: Column, dedupe_pending: Column, low_yield: Column, running: Column) -> Column:
    """Never done, changed since, not deduplicated, or complete; a known low yield overrides the first two, running overrides all."""
    base = F.when(stamp.isNull(), "UNCOMPRESSED").when(newer, "UPDATED").when(dedupe_pending, "COMPRESSED").otherwise("COMPACTED")
    low = F.coalesce(low_yield, F.lit(False)) & base.isin("UPDATED", "UNCOMPRESSED")
    return F.when(F.coalesce(running, F.lit(False)), "RUNNING").when(low, "LOW YIELD").otherwise(base)


def expected_gain(status_: Column, size_bytes: Column, ratio: Column) -> Column:
    """Predicted gain in MiB, truncated; null (unknown) unless the ratio was weighed, that is for work not yet done."""
    return F.when(~status_.isin("COMPRESSED", "COMPACTED") & ratio.isNotNull(), (size_bytes * ratio / 1048576).cast("long"))


def low_yield(ratio: Column, min_pct: float) -> Column:
    """A known ratio under the gate; a gate of 0 is off."""
    return ratio.isNotNull() & F.lit(min_pct > 0) & (ratio * 100 < min_pct)


def is_pending(status_: Column, dedupe_pending: Column, gate_off: bool = False) -> Column:
    """What a run would take: unfinished work, and low yields only for dedupe or with the gate off."""
    return status_.isin(*PENDING) | ((status_ == "LOW YIELD") & (dedupe_pending | F.lit(gate_off)))


def changed_since(rows: DataFrame, marks: DataFrame, key: str, stamp: str, mark: str) -> DataFrame:
    """Keys with a stamp after their own mark; a key without mark has everything newer."""
    seen = rows.groupBy(key).agg(F.max(stamp).alias("last_seen"), F.count("*").alias("n_rows"))
    return seen.join(marks.select(key, mark), key, "left").filter(F.col(mark).isNull() | (F.col("last_seen") > F.col(mark)))


def efficiency(before: Column, after: Column, least_pct: int) -> Column:
    """NO_GAIN, LOW_EFFICIENCY or CANDIDATE; saved bytes are weighed against the bytes written, not those read."""
    saved = before - after
    return F.when(saved <= 0, "NO_GAIN").when(saved * 100 < F.greatest(after, F.lit(1)) * least_pct, "LOW_EFFICIENCY").otherwise("CANDIDATE")
