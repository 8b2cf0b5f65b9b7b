"""Containers as tables: one row for each record of each file; a file that is rejected is a row too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups, intervals, rangejoin
from ..shipping import ship
from .formats import decode
from .reader import Reader

SCHEMA = "path string, format string, status string, reason string, record string, name string, numbers map<string,bigint>, texts map<string,string>"


def _rows(path: str, reader: Reader) -> Iterator[tuple]:
    fmt, records, reason = decode(reader)
    if reason is not None:
        yield path, fmt, "REJECT", reason, None, None, None, None
    for tag, name, numbers, texts in records:
        yield path, fmt, "OK", None, tag, name, numbers, texts


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "format", "status", "reason", "record", "name", "numbers", "texts"])


def decode_content(files: DataFrame) -> DataFrame:
    """Records of files held as (path, content)."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame.path, frame.content):
                yield _frame(list(_rows(path, Reader(content, len(content)))))

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def decode_files(spark: SparkSession, path: str, glob: str = "*", parts: int | None = None) -> DataFrame:
    """Records of the files under a path, read by seeking: only directories and headers are loaded, however large the files are.

    Files are listed without their content and dealt out evenly.
    """
    ship(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")
    dealt = listed.repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for frame in frames:
            for name, length in zip(frame.path, frame.length):
                fs, at = pafs.FileSystem.from_uri(name if "://" in name else name.replace("file:/", "file:///", 1))
                with fs.open_input_file(at) as source:
                    yield _frame(list(_rows(name, Reader(source, int(length)))))

    return dealt.mapInPandas(run, SCHEMA)


def tree_audit(records: DataFrame) -> DataFrame:
    """One row a file: OK or REJECT with its reason, and how many records it gave."""
    return records.groupBy("path", "format", "status").agg(F.first("reason", ignorenulls=True).alias("reason"), F.count("record").alias("records"))


def pack_entries(records: DataFrame) -> DataFrame:
    n, t = F.col("numbers"), F.col("texts")
    return records.filter("record = 'PCK_ENTRY'").select("path", "name", n["offset"].alias("offset"), n["size"].alias("size"), n["flags"].alias("flags"), t["md5"].alias("md5"))


def pack_duplicates(entries: DataFrame) -> DataFrame:
    """Entries that repeat another of the same pack, by declared MD5 and size; removed entries, empty ones and those without a digest are left out. Bytes must be compared before sharing them."""
    held = entries.filter((F.col("flags").bitwiseAND(2) == 0) & (F.col("size") > 0) & (F.col("md5") != "0" * 32))
    return groups.duplicate_candidates(held.select("path", "md5", "size", "name", "offset"), ["path", "md5", "size"], "name", "offset")


def type_rollup(records: DataFrame) -> DataFrame:
    """Entries and bytes of packs by extension."""
    ext = F.when(F.instr("name", ".") > 0, F.lower(F.element_at(F.split("name", r"\."), -1)))
    return pack_entries(records).groupBy("path", ext.alias("ext")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def required_archives(records: DataFrame) -> DataFrame:
    """The bytes each archive of a Valve pack must have."""
    n = F.col("numbers")
    return records.filter("record = 'VPK_ENTRY'").groupBy("path", n["archive"].alias("archive")).agg(F.max(n["offset"] + n["length"]).alias("required"), F.count("*").alias("entries"))


def chunk_blocks(records: DataFrame) -> DataFrame:
    """Each chunk of an I/O store with the blocks it lies in, joined on the block's number, and whether those blocks hold all of it."""
    n = F.col("numbers")
    size = records.filter("record = 'UNREAL_IOSTORE'").select("path", n["block_size"].alias("block_size"))
    chunks = records.filter("record = 'IOSTORE_CHUNK'").select("path", F.col("name").alias("chunk"), n["offset"].alias("offset"), n["length"].alias("length")).join(size, "path")
    blocks = records.filter("record = 'IOSTORE_BLOCK'").select("path", n["at"].alias("block"), F.col("name").alias("method"), n["size"].alias("packed"), n["raw"].alias("raw"))
    first, last = F.floor(F.col("offset") / F.col("block_size")), F.floor((F.col("offset") + F.col("length") - 1) / F.col("block_size"))
    spread = chunks.filter("length > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    need = F.least(F.col("offset") + F.col("length"), (F.col("block") + 1) * F.col("block_size")) - F.col("block") * F.col("block_size")
    found = spread.join(blocks, ["path", "block"], "left")
    return found.groupBy("path", "chunk").agg(F.count("raw").alias("blocks"), F.sum("packed").alias("packed"), F.bool_and(F.coalesce(F.col("raw") >= need, F.lit(False))).alias("complete"))


def class_rollup(records: DataFrame) -> DataFrame:
    """Objects and bytes of each Unity class in a file."""
    n = F.col("numbers")
    return records.filter("record = 'UNITY_OBJECT'").groupBy("path", n["class"].alias("class")).agg(F.count("*").alias("objects"), F.sum(n["size"]).alias("bytes"))


def method_rollup(records: DataFrame) -> DataFrame:
    """Entries, stored and whole bytes of Unreal packs by compression method; deleted entries have none."""
    n, t = F.col("numbers"), F.col("texts")
    own = records.filter("record in ('UNREAL_ENTRY', 'UNREAL_DELETED')").select("path", F.when(F.col("record") == "UNREAL_DELETED", "deleted").when(n["method"] == 0, "none").otherwise(t["method_name"]).alias("method"), n["size"].alias("size"), n["raw"].alias("raw"))
    return own.groupBy("path", "method").agg(F.count("*").alias("entries"), F.sum("size").alias("size"), F.sum("raw").alias("raw"))


def package_rollup(records: DataFrame) -> DataFrame:
    """Of each package its chunks, those that are compressed, and their bytes; only these can be compressed better."""
    n = F.col("numbers")
    packed = F.col("name") == "lz4"
    return records.filter("record = 'PACKAGE_CHUNK'").groupBy("path").agg(F.count("*").alias("chunks"), F.count_if(packed).alias("packed"), F.sum(F.when(packed, n["size"]).otherwise(0)).alias("packed_bytes"))


def samples(records: DataFrame) -> DataFrame:
    """The sound samples of resources: codec, rate, channels, loop, bytes, and frames where the codec has frames of one size."""
    n = F.col("numbers")
    return records.filter("record = 'GODOT_AUDIO_WAV'").select("path", F.col("name").alias("codec"), *[n[c].alias(c) for c in ("rate", "channels", "loop_mode", "loop_begin", "loop_end", "size", "frames")])


def coverage(records: DataFrame, record: str, start: str = "offset", length: str = "size") -> DataFrame:
    """Of each file's extents of one kind: union length, repeats and overlapping islands."""
    n = F.col("numbers")
    own = records.filter(F.col("record") == record).select("path", n[start].alias("a"), (n[start] + n[length]).alias("b"))
    return intervals.interval_union(own, ["path"], "a", "b")


def resolve_streams(references: DataFrame, files: DataFrame) -> DataFrame:
    """References (path, begin, length) against files (path, size): RESOLVED, OUT_OF_RANGE, MISSING, or UNREADABLE where the file is known without a size."""
    known = files.select("path", "size", F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "MISSING").when(F.col("size").isNull(), "UNREADABLE").when(F.col("begin") + F.col("length") > F.col("size"), "OUT_OF_RANGE").otherwise("RESOLVED")
    return references.join(known, "path", "left").withColumn("status", status).drop("_known")


def relocated(points: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return rangejoin.relocate(points, "offset", removed, "begin", "length", keys)
