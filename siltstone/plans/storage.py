"""The reports of the storage engine, over its own relations: games, files, state, ratios, ledgers.

Relations: ``games`` (name, path, library, level, running), ``files`` (game, rel_path, size, mtime_ns, kind, dev, ino), ``state`` (``ledgers.compression_state``), ``completions`` (path, stamp_ns), ``ratios`` (game, level, pct, ...).
Nothing here changes a file system: plans say what a run would do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, inventory, latest, lookup, ratios

MIB = 1 << 20


# Beginnings and names of folders that are no games.
TOOL_BEGINNINGS = ("SteamLinuxRuntime", "Proton")
TOOL_NAMES = ("Steamworks Shared", "Steam Controller Configs")


def ignored(name: Column) -> Column:
    """Runtimes and tools that are no games."""
    begins = F.startswith(name, F.lit(TOOL_BEGINNINGS[0])) | F.startswith(name, F.lit(TOOL_BEGINNINGS[1]))
    return begins | name.isin(*TOOL_NAMES)


def game_status(games: DataFrame, files: DataFrame, state: DataFrame, completions: DataFrame, ratio_table: DataFrame, min_gain_pct: float = 5.0, min_size_mib: int = 0) -> DataFrame:
    """Status of each game: bytes, files, last run, ratio, status, expected gain, hint for its library's level, whether dedupe is pending.

    The state is looked up by path, else for names that occur once by name; dedupe completions by game path, else by library, else never. A dedupe older than the last compression is pending.
    """
    by_path = state.filter("path is not null").select("path", F.col("ts").alias("p_ts"), F.col("uncomp_mib").alias("p_u"), F.col("saved_mib").alias("p_s"))
    by_name = state.filter("path is null").select("name", F.col("ts").alias("n_ts"), F.col("uncomp_mib").alias("n_u"), F.col("saved_mib").alias("n_s"))
    once = F.count("*").over(Window.partitionBy("name")) == 1
    own = games.filter(~ignored(F.col("name"))).withColumn("_once", once).join(by_path, "path", "left").join(by_name, "name", "left")
    legacy = F.col("p_ts").isNull() & F.col("_once")
    own = own.withColumn("ts", F.coalesce("p_ts", F.when(legacy, F.col("n_ts"))))
    saved, whole = F.when(legacy, F.col("n_s")).otherwise(F.col("p_s")), F.when(legacy, F.col("n_u")).otherwise(F.col("p_u"))
    own = own.withColumn("ratio", F.try_divide(saved, F.when(whole > 0, whole)))
    near = completions.select(F.col("path"), F.col("stamp_ns"))
    far = completions.select(F.col("path").alias("library"), F.col("stamp_ns"))
    own = lookup.two_level(own, near, "path", far, "library", "stamp_ns", 0, "dedupe_ns")
    marks = own.select(F.col("path").alias("game"), F.col("ts").alias("since_s"), F.greatest("dedupe_ns", F.lit(0)).alias("dedupe_since_ns"))
    scanned = inventory.scan_summary(files, marks).withColumnRenamed("game", "path")
    own = own.join(scanned, "path", "left").na.fill({"bytes": 0, "files": 0, "newer": False, "dedupe_pending": False}).filter(F.col("bytes") >= min_size_mib * MIB)
    pending = F.col("dedupe_pending") | (F.coalesce("ts", F.lit(0)) * 1000000000 > F.col("dedupe_ns"))
    low = classify.low_yield(F.col("ratio"), min_gain_pct)
    own = own.withColumn("dedupe_pending", pending).withColumn("status", classify.status(F.col("ts"), F.col("newer"), F.col("dedupe_pending"), low, F.col("running")))
    done = F.col("ts").isNotNull() & ~F.col("newer")
    own = own.withColumn("expected_gain", F.when(~done & F.col("ratio").isNotNull(), (F.col("bytes") * F.col("ratio") / MIB).cast("long")))
    hints = ratio_table.select(F.col("game").alias("name"), F.col("level").alias("_level"), F.col("pct").alias("_pct"))
    own = own.withColumn("_level", F.concat(F.lit("zstd"), F.col("level").cast("string")))
    own = lookup.hint_join(own, hints, ["name", "_level"], "ratio", "_pct", F.col("status").isin("UNCOMPRESSED", "UPDATED"), "hint_pct")
    return own.select("name", "path", "library", "level", "bytes", "files", "ts", "ratio", "status", "expected_gain", "hint_pct", (F.col("hint_pct") < min_gain_pct).alias("hint_low"), "dedupe_pending")


def _summary() -> list[Column]:
    names = ("UNCOMPRESSED", "UPDATED", "COMPRESSED", "COMPACTED", "LOW YIELD", "RUNNING")
    counts = [F.count_if(F.col("status") == s).alias(s.lower().replace(" ", "_")) for s in names]
    return [F.count("*").alias("games"), F.sum("bytes").alias("bytes"), *counts, F.count_if(classify.is_pending(F.col("status"), F.col("dedupe_pending"))).alias("pending")]


def status_summary(status: DataFrame) -> DataFrame:
    """One row of counts by status, the whole size and what is pending."""
    return status.agg(*_summary())


def status_json(status: DataFrame) -> DataFrame:
    """One JSON document of all games by name and the summary; what is unknown is null, never 0."""
    rows = F.array_sort(F.collect_list(F.struct("name", "path", "status", "bytes", "expected_gain", "dedupe_pending")))
    return status.agg(rows.alias("games"), F.struct(*_summary()).alias("summary")).select(F.to_json(F.struct("games", "summary"), {"ignoreNullFields": "false"}).alias("value"))


def dry_run(status: DataFrame) -> DataFrame:
    """What a run would do with each game."""
    s = F.col("status")
    action = F.when(s == "RUNNING", "skip: running").when(s.isin("UNCOMPRESSED", "UPDATED"), "compress").when(s == "COMPRESSED", "dedupe").when((s == "LOW YIELD") & F.col("dedupe_pending"), "dedupe").when(s == "LOW YIELD", "skip: low yield").otherwise("nothing")
    return status.select("name", "path", "status", action.alias("action"))


def batch_queue(status: DataFrame, gate_off: bool = False) -> DataFrame:
    """Pending games with the passes that each gets."""
    compress = F.col("status").isin("UNCOMPRESSED", "UPDATED") | ((F.col("status") == "LOW YIELD") & F.lit(gate_off))
    return status.filter(classify.is_pending(F.col("status"), F.col("dedupe_pending"), gate_off)).select("name", "path", compress.alias("compress"), F.col("dedupe_pending").alias("dedupe"))


def notify(status: DataFrame, most: int = 180) -> DataFrame:
    """One message of the pending games by name, cut off by length."""
    from ..operators.groups import cutoff_message

    waiting = status.filter(classify.is_pending(F.col("status"), F.col("dedupe_pending"))).select(F.lit(1).alias("k"), F.col("name"), F.col("name").alias("shown"), "path")
    return cutoff_message(waiting, ["k"], ["name", "path"], "shown", most).select("message", "more")


def history(state: DataFrame, offset_s: int = 0) -> DataFrame:
    """Measured runs, newest first."""
    rows = state.filter("uncomp_mib > 0").select("name", "path", "ts", T.minute(F.col("ts"), offset_s).alias("minute"), T.mib_human(F.col("saved_mib")).alias("saved"), T.percent(F.col("saved_mib"), F.col("uncomp_mib")).alias("pct"))
    return rows.orderBy(F.desc("ts"), F.desc("name"), F.desc("path"))


def benchmark(state: DataFrame) -> DataFrame:
    """Measured games, best saving first, equal ones by name descending."""
    rows = state.filter("uncomp_mib > 0").select("name", "path", "uncomp_mib", "disk_mib", "saved_mib", T.percent(F.col("saved_mib"), F.col("uncomp_mib")).alias("pct"))
    return rows.orderBy(F.desc(F.round("pct", 2)), F.desc("name"), F.desc("path"))


def stats(state: DataFrame, dedupe: DataFrame) -> DataFrame:
    """One row: runs measured, MiB before and after, best percentage, those over half, last run, and bytes saved by the last dedupe of each path (null if none was measured)."""
    m = state.filter("uncomp_mib > 0")
    pct = F.col("saved_mib") * 100 / F.col("uncomp_mib")
    one = m.agg(
        F.count("*").alias("rows"), F.sum("uncomp_mib").alias("uncomp_mib"), F.sum("disk_mib").alias("disk_mib"), F.sum(F.col("uncomp_mib") - F.col("disk_mib")).alias("saved_mib"),
        F.max(F.when(pct > 0, pct)).alias("best_pct"), F.count_if(pct >= 50).alias("over_half"), F.max("ts").alias("last_ts"),
    )
    last = latest.latest_per_key(dedupe.select("path", "ts", "line_no", "before_disk", "saved"), ["path"], "ts", "line_no")
    two = last.agg(F.sum("saved").alias("dedupe_saved"), F.max(F.when(F.col("before_disk") > 0, F.col("saved") * 100 / F.col("before_disk"))).alias("dedupe_best_pct"))
    both = one.unionByName(two, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def export_ratios(state: DataFrame, games: DataFrame) -> DataFrame:
    """(game, level, pct, samples, min, max) of the measured games at their library's level, to one decimal."""
    pct = F.round(F.col("saved_mib") * 100 / F.col("uncomp_mib"), 1)
    rows = state.filter("uncomp_mib > 0").join(games.select("path", "level"), "path").select(F.col("name").alias("game"), F.concat(F.lit("zstd"), F.col("level").cast("string")).alias("level"), pct.alias("p"))
    return rows.groupBy("game", "level").agg(F.round(F.avg("p"), 1).alias("pct"), F.count("*").cast("int").alias("samples"), F.min("p").alias("min"), F.max("p").alias("max"))


def merge_ratios(target: DataFrame, incoming: DataFrame) -> DataFrame:
    return ratios.weighted_merge(target, incoming, ["game", "level"])


def recheck(state: DataFrame, measured: DataFrame) -> DataFrame:
    """The state with fresh sizes (path, uncomp_mib, disk_mib) and the old times; what wasn't measured keeps its row."""
    fresh = measured.select("path", F.col("uncomp_mib").alias("_u"), F.col("disk_mib").alias("_d"))
    joined = state.join(fresh, "path", "left")
    new = F.col("_u").isNotNull()
    changed = {"uncomp_mib": F.col("_u"), "disk_mib": F.col("_d"), "saved_mib": F.col("_u") - F.col("_d")}
    return joined.select(*[F.when(new, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in state.columns])


def migrate(state: DataFrame, games: DataFrame) -> DataFrame:
    """The state with legacy rows (by name) moved to the path of the one game with that name, the newest of a path; all others stay."""
    single = latest.only_once(games.select("name", F.col("path").alias("_path")), "name")
    joined = state.join(single, "name", "left")
    taken = state.filter("path is not null").select(F.col("path").alias("_path")).distinct()
    moved = joined.filter("path is null and _path is not null").join(taken, "_path", "left_anti").select(*[F.col("_path").alias("path") if c == "path" else F.col(c) for c in state.columns])
    moved = latest.latest_per_key(moved, ["path"], "ts", "name").select(state.columns)
    stay = joined.filter("path is not null or _path is null").select(state.columns)
    return stay.unionByName(moved)


def dedupe_totals(runs: DataFrame) -> DataFrame:
    """One row over (status, saved): bytes saved where measured, and counts of done, skipped, failed and unmeasured runs; saved is null if none was measured."""
    s = F.col("status")
    return runs.agg(F.sum(F.when(s == "done", F.col("saved"))).alias("saved"), F.count_if((s == "done") & F.col("saved").isNotNull()).alias("done"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "failed").alias("failed"), F.count_if((s == "done") & F.col("saved").isNull()).alias("unknown"))


def balance_plan(games: DataFrame, mounts: DataFrame) -> DataFrame:
    """The distinct mounts of the libraries, in the order in which they are first seen."""
    return latest.ordered_distinct(games.join(mounts, "library"), "mount", "seq")


def prune_plan(files: DataFrame, wanted: list[str], min_mib: int) -> DataFrame:
    """Debug symbols and named files of each game, each path once, where together they reach the floor."""
    path = F.col("rel_path")
    hit = inventory.extension(path).isin(*inventory.DEBUG_SYMBOLS) | path.isin(*wanted)
    chosen = files.filter((F.col("kind") == "f") & hit & T.safe_path(path)).groupBy("game", "rel_path").agg(F.max("size").alias("size"))
    enough = chosen.groupBy("game").agg(F.sum("size").alias("total")).filter(F.col("total") >= min_mib * MIB)
    return chosen.join(enough.select("game"), "game", "left_semi")


def slim_plan(files: DataFrame, keep_language: str | list[str] | None) -> DataFrame:
    """(game, rel_path, rule): folders and files of languages other than ``keep_language`` (one or several) where at least two languages of the same base are present and a kept one is among them.

    Folders and files are judged by their name's language; platform variants are never removed. Without a kept language nothing is.
    """
    keep = [keep_language] if isinstance(keep_language, str) else list(keep_language or [])
    held = F.col("lang").isin(*keep) if keep else F.lit(False)
    parts = F.split("rel_path", "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    by_file = files.filter("kind = 'f'").select("game", F.col("rel_path").alias("target"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("parent"), T.language_in(stem).alias("lang"), F.concat_ws(".", T.language_base(stem), inventory.extension(F.col("rel_path"))).alias("base"), F.lit("file").alias("rule"))
    folders = files.filter("kind = 'f' and rel_path like '%/%'").select("game", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("target")).distinct()
    cut = F.split("target", "/")
    by_folder = folders.select("game", "target", F.array_join(F.slice(cut, 1, F.size(cut) - 1), "/").alias("parent"), T.language_of(F.element_at(cut, -1)).alias("lang"), F.lit("").alias("base"), F.lit("folder").alias("rule"))
    named = by_file.unionByName(by_folder).filter("lang is not null")
    suite = named.groupBy("game", "parent", "base", "rule").agg(F.count_distinct("lang").alias("n"), F.bool_or(held).alias("kept"))
    removable = suite.filter((F.col("n") >= 2) & F.coalesce(F.col("kept"), F.lit(False))).select("game", "parent", "base", "rule")
    return named.filter(~held).join(removable, ["game", "parent", "base", "rule"], "left_semi").select("game", F.col("target").alias("rel_path"), "rule").distinct()


def opportunities(planner: DataFrame, packs: DataFrame) -> DataFrame:
    """Games ranked by what planner and pack audits together would save; errors stay as rows without a saving and come last."""
    extra = packs.groupBy("game").agg(F.sum("saving").alias("pack_saving"))
    rows = planner.join(extra, "game", "left").withColumn("total", F.when(F.col("status") == "ok", F.col("saving") + F.coalesce("pack_saving", F.lit(0))))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("total"), "seq")))
