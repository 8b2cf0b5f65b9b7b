"""Where libraries, running games, ratio files and free space are found, and the options of a job."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import latest, lookup


def libraries(lists: list[DataFrame], mounts: DataFrame) -> DataFrame:
    """(seq, path, level): library paths of all lists (seq, path), each once in the order first seen, of those on btrfs that exist (``mounts``: path, fs_type, level)."""
    both = lists[0].select("seq", "path", F.lit(0).alias("list"))
    for i, more in enumerate(lists[1:], 1):
        both = both.unionByName(more.select("seq", "path", F.lit(i).alias("list")))
    first = latest.ordered_distinct(both.withColumn("at", F.struct("list", "seq")), "path", "at", "seq")
    return first.join(mounts.filter("fs_type = 'btrfs'").select("path", "level"), "path").select("seq", "path", "level")


def running_dirs(maps: DataFrame, working: DataFrame, roots: DataFrame) -> DataFrame:
    """(path): game folders under the roots' ``common`` folder that a mapped file (line) or a working directory lies in."""
    evidence = maps.select(F.regexp_extract("line", r"(/.*)$", 1).alias("line")).unionAll(working.select("line")).filter("line <> ''").distinct()
    inside = lookup.prefix_matches(evidence, "line", roots.select(F.col("path").alias("root")), "root")
    rest = F.expr("substring(line, length(root) + 2)")
    return inside.select(F.concat_ws("/", "root", F.substring_index(rest, "/", 1)).alias("path")).distinct()


FILES = "game string, rel_path string, size long, mtime_ns long, kind string, dev long, ino long, blocks long"


def scan_files(roots: DataFrame, skip: tuple[str, ...] = (), one_device: bool = True) -> DataFrame:
    """The files relation of folders (game, path) that all executors reach: files and directories below each, without links, ``skip`` folders, or (with ``one_device``) what lies on another device.

    A folder is one unit of work; an unreadable one ends the scan with its error.
    """

    def walk(frames):
        for frame in frames:
            for game, top in zip(frame.game, frame.path):
                device, rows, waiting = os.stat(top).st_dev, [], [top]
                while waiting:
                    with os.scandir(waiting.pop()) as found:
                        for entry in sorted(found, key=lambda e: e.name):
                            seen = entry.stat(follow_symlinks=False)
                            is_dir = entry.is_dir(follow_symlinks=False)
                            if not (is_dir or entry.is_file(follow_symlinks=False)) or (is_dir and entry.name in skip) or (one_device and seen.st_dev != device):
                                continue
                            if is_dir:
                                waiting.append(entry.path)
                            rows.append((game, os.path.relpath(entry.path, top), seen.st_size, seen.st_mtime_ns, "d" if is_dir else "f", seen.st_dev, seen.st_ino, seen.st_blocks))
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in FILES.split(", ")])

    n = max(1, int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return roots.select("game", "path").repartition(n, "path").mapInPandas(walk, FILES)


def status_games(document: DataFrame, column: str = "value") -> DataFrame:
    """(name, path, status, bytes, expected_gain) of the games of JSON status documents; what is no such document gives no row."""
    shape = "games array<struct<name: string, path: string, status: string, bytes: long, expected_gain: long>>"
    return document.select(F.explode(F.from_json(column, shape)["games"]).alias("g")).select("g.*").filter("name is not null")


def first_readable(paths: list[str], imported: str | None = None, repository_only: bool = False) -> str | None:
    """The ratio file to read: an imported one first, unless only the repository's count, else the first that is readable."""
    order = ([imported] if imported and not repository_only else []) + paths
    return next((p for p in order if os.access(p, os.R_OK)), None)


def capture_space(spark: SparkSession, root: str, captured_utc: str) -> DataFrame:
    """One snapshot row of a mounted file system; extents are unmeasured, so null."""
    v = os.statvfs(root)
    space = {"available": v.f_bavail * v.f_frsize, "free": v.f_bfree * v.f_frsize, "total": v.f_blocks * v.f_frsize, "fragment": v.f_frsize}
    schema = "root string, device long, captured_utc string, filesystem_space struct<available: long, free: long, total: long, fragment: long>, extent_measurement struct<status: string, reason: string, disk: long, raw: long, referenced: long>, status string"
    row = (root, os.stat(root).st_dev, captured_utc, space, {"status": "unavailable", "reason": "not measured", "disk": None, "raw": None, "referenced": None}, "ok")
    return spark.createDataFrame([row], schema)


@dataclass
class Options:
    """Settings of a job. Invalid values fall back to the defaults, and each leaves a warning."""

    level: int = 3
    min_gain_pct: float = 5.0
    min_size_mib: int = 0
    min_prune_mib: int = 1
    min_efficiency_pct: int = 5
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, text: str) -> Options:
        out = cls()
        limits = {"level": (1, 15), "min_gain_pct": (0, 100), "min_size_mib": (0, 1 << 30), "min_prune_mib": (0, 1 << 30), "min_efficiency_pct": (0, 100)}
        kinds = {f.name: f.type for f in fields(cls)}
        for line in text.splitlines():
            name, eq, value = line.partition("=")
            name, value = name.strip().lower(), value.strip().strip('"')
            if not eq or name.startswith("#"):
                continue
            try:
                number = float(value) if kinds.get(name) == "float" else int(value)
                low, high = limits[name]
                if not low <= number <= high:
                    raise ValueError
                setattr(out, name, number)
            except (KeyError, ValueError):
                out.warnings.append(f"{name}={value}")
        return out
