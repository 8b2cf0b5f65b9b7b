"""Text ledgers and documents as tables: library lists, state, dedupe and ratio files, recorded streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

STATE_HEADER = "# compression state v2"
RATIOS_SCHEMA = "schema int, games map<string, map<string, struct<pct: double, samples: int, min: double, max: double>>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of small text files; numbers follow each file's order."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def libraries(text: DataFrame) -> DataFrame:
    """(seq, path), with ``file`` where the text has one: the token after each key ``path`` in quoted key-value text; keys may stand on an earlier line of the same file."""
    by = [c for c in ("file",) if c in text.columns]
    raw = text.select(*by, "line_no", F.posexplode(F.regexp_extract_all("value", F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))).alias("at", "token"))
    order = Window.partitionBy(*by).orderBy("line_no", "at")
    marked = raw.withColumn("before", F.lag("token").over(order)).withColumn("seq", F.row_number().over(order))
    return marked.filter("before = 'path'").select(*by, "seq", F.regexp_replace("token", r"\\(.)", "$1").alias("path"))


def compression_state(text: DataFrame) -> DataFrame:
    """Rows of the state ledger: nine fields or more are keyed by path, eight or two (legacy) by name; comments and blanks are skipped. The last line of a key counts."""
    own = text.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).withColumn("f", F.split("value", r"\|"))
    n = F.size("f")
    new = n >= 9
    at = lambda i: F.try_element_at("f", F.lit(i))
    field = lambda i: F.when(new, at(i)).otherwise(at(i - 1))
    number = lambda i: field(i).try_cast("long")
    rows = own.select(
        "line_no", F.when(new, T.strip_slash(T.percent_decode(at(1)))).alias("path"), T.percent_decode(field(2)).alias("name"), number(3).alias("ts"),
        field(4).alias("uncomp"), field(5).alias("disk"), field(6).alias("saved"), number(7).alias("saved_mib"), number(8).alias("uncomp_mib"), number(9).alias("disk_mib"),
    )
    key = F.coalesce(F.concat(F.lit("p"), "path"), F.concat(F.lit("n"), "name"))
    last = rows.groupBy(key.alias("k")).agg(F.max_by(F.struct(*rows.columns), "line_no").alias("r"))
    return last.select("r.*")


def upsert_text(text: DataFrame, rows: DataFrame) -> DataFrame:
    """(line_no, value): the state ledger's lines with the lines of new rows' paths replaced; comments and legacy lines stay, the header stands first, once.

    ``rows`` is (path, value), a line each; of repeated paths the greatest line counts. Numbers go on behind the ledger's last.
    """
    fresh = rows.select(T.strip_slash(F.col("path")).alias("path"), "value").groupBy("path").agg(F.max("value").alias("value"))
    f = F.split("value", r"\|")
    path = F.when(~F.startswith("value", F.lit("#")) & (F.size(f) >= 9), T.strip_slash(T.percent_decode(F.get(f, F.lit(0)))))
    kept = text.filter((F.col("value") != STATE_HEADER) & (F.trim("value") != "")).withColumn("path", path).join(fresh.select("path"), "path", "left_anti").select(F.col("line_no").cast("long").alias("line_no"), "value")
    last = text.agg(F.coalesce(F.max("line_no"), F.lit(0)).cast("long").alias("last"))
    added = fresh.crossJoin(F.broadcast(last)).select((F.col("last") + 1 + F.pmod(F.xxhash64("path"), F.lit(1 << 40))).alias("line_no"), "value")
    head = text.sparkSession.createDataFrame([(-1, STATE_HEADER)], "line_no long, value string")
    return head.unionByName(kept).unionByName(added)


def measured(state: DataFrame) -> DataFrame:
    """Rows that hold a measurement: marker rows of zeros are none."""
    return state.filter("path <> '' and uncomp_mib > 0 and disk_mib is not null")


def dedupe_completions(text: DataFrame) -> DataFrame:
    """(path, stamp_ns): the latest stamp of each path; lines with another stamp than a number are skipped."""
    split = text.filter(F.col("value").rlike(r"^[0-9]+\|.")).select(F.substring_index("value", "|", 1).try_cast("long").alias("stamp_ns"), T.percent_decode(F.regexp_replace("value", r"^[0-9]+\|", "")).alias("path"))
    return split.filter("stamp_ns is not null").groupBy("path").agg(F.max("stamp_ns").alias("stamp_ns"))


def dedupe_history(text: DataFrame) -> DataFrame:
    """Measurements around dedupe runs; lines of too few or other fields than numbers are skipped."""
    at = lambda i: F.get(F.split("value", r"\|"), F.lit(i))
    names = ["before_disk", "before_raw", "before_ref", "after_disk", "after_raw", "after_ref"]
    good = text.filter(F.col("value").rlike(r"^[0-9]+\|[^|]+(\|[0-9]+){6}\|-?[0-9]+(\||$)"))
    return good.select("line_no", at(0).try_cast("long").alias("ts"), T.percent_decode(at(1)).alias("path"), *[at(2 + i).try_cast("long").alias(n) for i, n in enumerate(names)], at(8).try_cast("long").alias("saved"))


def ratios(document: DataFrame, column: str = "value") -> DataFrame:
    """(game, level, pct, samples, min, max) of JSON ratio documents; no JSON gives no row, nor does an entry without pct."""
    parsed = document.select(F.from_json(column, RATIOS_SCHEMA).alias("d")).select(F.explode("d.games").alias("game", "levels"))
    return parsed.select("game", F.explode("levels").alias("level", "v")).select("game", "level", "v.*").filter("pct is not null")


def ratios_document(rows: DataFrame) -> DataFrame:
    """One JSON document of (game, level, pct, samples, min, max), games and levels in byte order."""
    entry = F.struct("pct", "samples", "min", "max")
    games = rows.groupBy("game").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", entry)))).alias("levels"))
    pairs = F.array_sort(F.transform(F.collect_list(F.struct("game", "levels")), lambda x: x["game"]))
    levels = F.map_from_entries(F.collect_list(F.struct("game", "levels")))
    held = games.agg(pairs.alias("names"), levels.alias("levels"))
    ordered = F.map_from_entries(F.transform("names", lambda g: F.struct(g, F.element_at("levels", g))))
    return held.select(F.to_json(F.struct(F.lit(1).alias("schema"), ordered.alias("games"))).alias("value"))


def records(text: DataFrame, tag: str, fields: int, key: str = "game", texts: int = 0, before: int | None = None) -> DataFrame:
    """A recorded stream by key: exactly one line of ``tag`` with ``fields`` fields is ``ok`` if all but the ``texts`` first behind the tag are whole decimal numbers; all else is ``error``, and errors stay as rows.

    With ``before`` (the place of the bytes before; a count is ahead of it, the bytes after behind it) totals must agree: nothing grows, and without candidates nothing changes.
    """
    f = F.split("value", r"\|")
    mine = F.when(f[0] == tag, f)
    seen = text.groupBy(key).agg(F.count(mine).alias("n"), F.max(mine).alias("f"))
    good = (F.col("n") == 1) & (F.size("f") == fields) & F.forall(F.slice("f", 2 + texts, fields - 1 - texts), lambda x: x.rlike("^[0-9]+$"))
    if before is not None:
        n, was, now = (F.try_element_at("f", F.lit(before - 1 + i)).try_cast("decimal(38,0)") for i in (0, 1, 2))
        good = F.coalesce(good & (now <= was) & ((n > 0) | (was == now)), F.lit(False))
    return seen.select(key, F.when(good, "ok").otherwise("error").alias("status"), F.when(good, F.col("f")).alias("fields"))


def extent_report(text: DataFrame, key: str = "file") -> DataFrame:
    """Blocks of 4096 bytes in a listing of extents, split into encoded and plain ones."""
    row = F.regexp_extract("value", r"^\s*[0-9]+:\s*[0-9]+\.\.\s*[0-9]+:\s*[0-9]+\.\.\s*[0-9]+:\s*([0-9]+):", 1)
    own = text.withColumn("blocks", row.try_cast("long")).filter("blocks is not null")
    encoded = F.col("value").contains("encoded")
    return own.groupBy(key).agg(F.count("*").alias("extents"), F.sum(F.when(encoded, F.col("blocks") * 4096).otherwise(0)).alias("encoded"), F.sum(F.when(encoded, 0).otherwise(F.col("blocks") * 4096)).alias("plain"))


def space_snapshots(document: DataFrame, column: str = "value") -> DataFrame:
    """Space snapshots with status ``ok`` or ``invalid``: available <= free <= total, and unavailable measurements hold only nulls."""
    schema = "root string, device long, captured_utc string, filesystem_space struct<available: long, free: long, total: long, fragment: long>, extent_measurement struct<status: string, reason: string, disk: long, raw: long, referenced: long>"
    rows = document.select(F.from_json(column, schema).alias("d")).select("d.*")
    s, m = F.col("filesystem_space"), F.col("extent_measurement")
    order = (s["available"] >= 0) & (s["available"] <= s["free"]) & (s["free"] <= s["total"])
    known = F.when(m["status"] == "available", m["disk"].isNotNull() & m["raw"].isNotNull() & m["referenced"].isNotNull()).otherwise(F.coalesce(m["disk"], m["raw"], m["referenced"]).isNull())
    return rows.withColumn("status", F.when(F.coalesce(order & known & F.col("root").isNotNull(), F.lit(False)), "ok").otherwise("invalid"))
