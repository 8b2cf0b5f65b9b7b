"""Rollups of file inventories and rules over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions of the inventory's families.
RASTER = ("png", "jpg", "jpeg", "tga", "bmp", "dds")
PACKED = ("pck", "pak", "bundle", "bank", "fsb", "xnb", "pkg", "assets")
AUDIO = ("wav", "ogg", "mp3", "flac")
DEBUG_SYMBOLS = ("pdb", "ilk")


def extension(path: Column) -> Column:
    """The lower-case extension behind the last dot of the last part of a path; none without a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1)))


def inventory(files: DataFrame, keys: list[str], path: str = "rel_path", size: str = "size") -> DataFrame:
    """Files and bytes, and of each family: raster files, packed files and bytes, audio files and bytes."""
    ext, n = extension(F.col(path)), F.col(size)
    packed, audio = ext.isin(*PACKED), ext.isin(*AUDIO)
    zero = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return files.groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum(n).alias("bytes"), F.count_if(F.coalesce(ext.isin(*RASTER), F.lit(False))).alias("raster"),
        F.count_if(F.coalesce(packed, F.lit(False))).alias("packed"), zero(packed).alias("packed_bytes"), F.count_if(F.coalesce(audio, F.lit(False))).alias("audio"), zero(audio).alias("audio_bytes"),
    )


def rollup_example(df: DataFrame, keys: list[str], size: Column, example: str) -> DataFrame:
    """Count, bytes and the first example by name of each class."""
    return df.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.min(example).alias("example"))


def once_per_inode(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Files of one device with each hard link once, under its first path."""
    rest = [c for c in files.columns if c not in ("dev", "ino")]
    best = files.groupBy("dev", "ino").agg(F.min(F.struct(path, *[c for c in rest if c != path])).alias("b"))
    return best.select("dev", "ino", *[F.col(f"b.{c}").alias(c) for c in rest])


def scan_summary(files: DataFrame, marks: DataFrame, key: str = "game") -> DataFrame:
    """Of each key with files or directories: bytes and files (files only), and whether anything is newer than its two marks (seconds, nanoseconds).

    Directories count for the marks alone. A key without mark has everything newer.
    """
    is_file = F.col("kind") == "f"
    seen = files.groupBy(key).agg(F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(is_file).alias("files"), F.max("mtime_ns").alias("last_ns"))
    joined = seen.join(marks.select(key, "since_s", "dedupe_since_ns"), key, "left")
    return joined.select(key, "bytes", "files", (F.col("last_ns") > F.coalesce("since_s", F.lit(0)) * 1000000000).alias("newer"), (F.col("last_ns") > F.coalesce("dedupe_since_ns", F.lit(0))).alias("dedupe_pending"))


def engines(files: DataFrame, rules: list[tuple[str, Column]], keys: list[str], path: str = "rel_path") -> DataFrame:
    """(keys, engine, evidence, files): the rules that hold for any file, with the first path that shows it."""
    named = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())
    return files.withColumn("engine", F.explode(named)).groupBy(*keys, "engine").agg(F.min(path).alias("evidence"), F.count("*").alias("files"))


def engine_rules(path: str = "rel_path") -> list[tuple[str, Column]]:
    """Markers of game engines in a path."""
    p, ext = F.lower(F.col(path)), extension(F.col(path))
    return [
        ("Unity", p.rlike(r"(^|/)(unityplayer\.dll|globalgamemanagers|[^/]+_data/)") | ext.isin("assets", "unity3d")),
        ("Unreal", p.rlike(r"(^|/)content/paks/") | ext.isin("utoc", "ucas", "uasset")),
        ("Godot", ext == "pck"),
        ("Wwise", ext.isin("wem", "bnk")),
        ("FMOD", ext.isin("bank", "fsb")),
        ("XNA", ext == "xnb"),
        ("GameMaker", p.rlike(r"(^|/)data\.win$")),
        ("Source", ext.isin("vpk", "vtf")),
    ]


def variant_groups(dirs: DataFrame, parent: str, name: str, members: str, size: str, most: int = 64) -> DataFrame:
    """Sibling directories with equal sorted member names, of two or more; largest reclaim first, ``most`` groups, and of those the ones that have a variant name and unequal sizes.

    The limit comes before the filter. ``members`` is the sorted array of names.
    """
    group = dirs.withColumn("variant", is_variant(F.col(name))).groupBy(parent, members).agg(
        F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("neg"), F.col(name).alias("path"), F.col("variant").alias("variant")))).alias("m"),
        F.count("*").alias("n"), (F.sum(size) - F.max(size)).alias("reclaim"), F.min(size).alias("least"), F.max(size).alias("most"), F.bool_or("variant").alias("any_variant"),
    )
    top = group.filter("n > 1").orderBy(F.desc("reclaim"), parent, members).limit(most)
    kept = top.filter(F.col("any_variant") & (F.col("least") != F.col("most")))
    return kept.select(parent, F.transform("m", lambda x: F.struct((-x.neg).alias("bytes"), x.path.alias("path"), x.variant.alias("variant"))).alias("members"), "reclaim")


# Names, or last words of names, that make a directory a variant: of quality, of language, of platform.
VARIANT_TOKENS = (
    "720p 1080p 1440p 2160p 4k 480p 360p lowres highres low medium high ultra bc1 bc3 bc5 bc7 etc1 etc2 astc dx11 dx12 vulkan opengl x86 x64 "
    "en fr de es it pt ru pl ja ko zh tr nl sv fi da no cs hu el ar he th vi uk id ro bg hr sk "
    "windows win win32 win64 mac macos osx linux linux64 ps4 ps5 playstation xbox xboxone xbsx switch nx android ios mobile pellegrino vita"
).split()


def is_variant(name: Column) -> Column:
    """Whether a directory's name, or what is behind its last dot, dash or underscore, is a variant's."""
    return F.lower(name).isin(*VARIANT_TOKENS) | F.element_at(F.split(F.lower(name), r"[.\-_]"), -1).isin(*VARIANT_TOKENS)


def greedy_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows taken in order while they fit a budget; one that is too large is left out without using it. A key's rows are one group, in time in proportion to them."""
    columns = [*keys, *order, cost]

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        own, used, taken = pdf.sort_values(order, kind="stable"), 0, []
        for size in own[cost].tolist():
            fits = used + size <= budget
            used += size * fits
            taken.append(fits)
        return own.assign(taken=taken)

    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("taken", T.BooleanType())])
    return df.select(*columns).groupBy(*keys).applyInPandas(take, schema)


def prefix_cut(df: DataFrame, keys: list[str], order: list[str], out: str = "place") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
