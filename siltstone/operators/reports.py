"""Shapes that reports take: caps with totals, samples of errors, positional comparisons, text tables, deadlines."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(df: DataFrame, order: list, most: int, label: str) -> DataFrame:
    """The first ``most`` rows, each with how many are shown and how many there are."""
    total = df.agg(F.count("*").alias("n")).collect()[0].n
    return df.orderBy(*order).limit(most).withColumn("shown", F.lit(min(most, total)).cast("long")).withColumn("total", F.lit(total).cast("long")).withColumn("label", F.lit(label))


def error_sample(df: DataFrame, keys: list[str], order: str, message: str, most: int = 16) -> DataFrame:
    """The number of errors of each key and the first few messages in order."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct(order, message)))), lambda x: x[message])
    return ranked.groupBy(*keys).agg(F.count("*").alias("errors"), kept.alias("sample"))


def dropped_small(df: DataFrame, name: str, size: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of at least a size, and one row with how many others there are and their names."""
    small = df.filter(F.col(size) < least).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("names"))
    return df.filter(F.col(size) >= least), small


def containing(df: DataFrame, name: str, query: str) -> DataFrame:
    """Rows whose name holds a text, whatever its case."""
    return df.filter(F.lower(name).contains(query.lower()))


def exactly_one(df: DataFrame, name: str, path: str, wanted: str) -> DataFrame:
    """The one row with a path or name; anything else is an error that says how many there are."""
    found = df.filter((F.col(path) == wanted) | (F.col(name) == wanted))
    n = found.count()
    if n != 1:
        raise LookupError(f"{wanted}: {n} matches")
    return found


def differing_positions(old: DataFrame, new: DataFrame, array: str, key: str) -> DataFrame:
    """Positions at which two arrays of a key differ, by position; a missing side is null."""
    a = old.select(key, F.posexplode(array).alias("at", "was"))
    b = new.select(key, F.posexplode(array).alias("at", "now"))
    return a.join(b, [key, "at"], "full").filter(~F.col("was").eqNullSafe(F.col("now")))


def is_prefix(recorded: DataFrame, manifest: DataFrame, order: str, columns: list[str]) -> bool:
    """Whether recorded rows are the manifest's first rows, one by one; only then a report goes on behind them."""
    window = Window.orderBy(order)
    a = recorded.select(F.row_number().over(window).alias("_at"), F.struct(*columns).alias("a"))
    b = manifest.select(F.row_number().over(window).alias("_at"), F.struct(*columns).alias("b"))
    return not a.join(b, "_at", "left").filter(~F.col("a").eqNullSafe(F.col("b"))).take(1)


def footprint(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files, bytes and allocated bytes (blocks of 512)."""
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), (F.sum("blocks") * 512).alias("allocated"))


def ranked_categories(df: DataFrame, label: str, pct: str) -> DataFrame:
    """Categories by measured share, those without a measurement first."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_first(pct), label)))


def bundle_references(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """References of textures (path, own, target, begin, length) within a bundle (path, name, size, kind), with one of six statuses.

    An empty target is inline. ``archive:/OWN/name`` and a plain path name a node of the same bundle, of kind ``resource``, folders and all; another archive's name, and a path that is no safe
    relative one, is unsupported. Bounds are checked, the data is not read.
    """
    from ..functions.text import safe_path

    prefixed = F.startswith(F.col("target"), F.lit("archive:/"))
    own = F.when(prefixed, F.regexp_extract("target", r"^archive:/([^/]*)/", 1)).otherwise(F.col("own"))
    name = F.when(prefixed, F.regexp_extract("target", r"^archive:/[^/]*/(.*)$", 1)).otherwise(F.col("target"))
    joined = references.withColumn("name", name).join(nodes.select("path", "name", "size", "kind"), ["path", "name"], "left")
    status = (
        F.when(F.col("target") == "", "INLINE").when((own != F.col("own")) | ~safe_path(F.col("name")), "UNSUPPORTED_NAMESPACE").when(F.col("size").isNull(), "MISSING").when(F.col("kind") != "resource", "KIND_UNSUPPORTED")
        .when(F.col("begin") + F.col("length") > F.col("size"), "OUT_OF_RANGE").otherwise("BOUNDS_ONLY")
    )
    return joined.withColumn("status", status)


def seek_points(packets: DataFrame, keys: list[str], frame: str, rate: Column) -> DataFrame:
    """Packets that begin a later second than the one ahead of them."""
    second = F.floor(F.col(frame) / rate)
    return packets.withColumn("second", second).withColumn("_was", F.lag("second").over(Window.partitionBy(*keys).orderBy(frame))).filter(F.col("_was").isNull() | (F.col("second") > F.col("_was"))).drop("_was")


def subtree_ends(nodes: DataFrame, keys: list[str], at: str, level: str) -> DataFrame:
    """Of each node of a flattened tree, the place of the next node of its level or above; null at the end. Trees are small (thousands of nodes), so one is one array."""
    rows = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, level))).alias("_all"))
    end = lambda x: F.try_element_at(F.filter("_all", lambda y: (y[at] > x[at]) & (y[level] <= x[level])), F.lit(1))[at]
    spread = rows.select(*keys, F.explode(F.transform("_all", lambda x: F.struct(x[at].alias(at), x[level].alias(level), end(x).alias("end")))).alias("_x"))
    return spread.select(*keys, "_x.*")


def resource_paths(text: Column) -> Column:
    """``res://`` paths in a text, up to quotes and control characters, of 4,096 characters at most."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(res://[^\x00-\x1f\x7f\"']+)"), F.lit(1)), lambda p: F.char_length(p) <= 4096)


def quantise(channel: Column, bits: int) -> Column:
    """A channel of 8 bits with ``bits`` of them (7 at least) kept, scaled back to 0 to 255 in whole numbers."""
    top = (1 << max(bits, 7)) - 1
    return F.floor((F.floor((channel * top + 127) / 255) * 255 + top // 2) / top).cast("int")


def file_blocks(files: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """Whole blocks of binary content with their offset and hash; a shorter rest is no block."""
    whole = F.floor(F.octet_length(content) / size).cast("int")
    cut = files.filter(whole > 0).select(key, content, F.explode(F.sequence(F.lit(0), whole - 1)).alias("block"))
    part = F.substring(F.col(content), F.col("block") * size + 1, F.lit(size))
    return cut.select(key, (F.col("block") * size).cast("long").alias("offset"), F.lit(size).alias("len"), F.sha2(part, 256).alias("hash"))


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Rows as lines of columns of fixed width: numbers to the right, texts to the left."""
    numbers = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("int", "bigint", "double", "float")}
    cells = [(F.lpad if c in numbers else F.rpad)(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items()]
    return df.select(F.rtrim(F.concat_ws("  ", *cells)).alias("line"))


def with_deadline(df: DataFrame, work: Callable[[dict], int], key: str, seconds: float) -> DataFrame:
    """``work`` of each row under a time limit: status ok, error or timeout; a row that runs over is interrupted where it stands (by a timer signal), and one bad row never ends the job."""

    def over(*_) -> None:
        raise TimeoutError

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                was = signal.signal(signal.SIGALRM, over)
                signal.setitimer(signal.ITIMER_REAL, seconds)
                try:
                    value, status, reason = work(row), "ok", None
                except TimeoutError:
                    value, status, reason = None, "timeout", f"took more than {seconds:g} s"
                except Exception as e:
                    value, status, reason = None, "error", str(e).replace("|", "/")
                finally:
                    signal.setitimer(signal.ITIMER_REAL, 0)
                    signal.signal(signal.SIGALRM, was)
                out.append((row[key], status, reason, value))
            made = pd.DataFrame(out, columns=[key, "status", "reason", "value"])
            made["value"] = made["value"].astype("Int64")
            yield made

    return df.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, status string, reason string, value long")
