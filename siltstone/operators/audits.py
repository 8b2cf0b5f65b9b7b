"""Reports over audited assets: candidates and their gates, texture and audio quality, reader names, variant folders, extent sizes, and totals of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import quality

# The reader of textures, the assemblies that may hold it, folders of platforms and of texture formats.
TEXTURE_READER = "Microsoft.Xna.Framework.Content.Texture2DReader"
ASSEMBLIES = ("Microsoft.Xna.Framework", "Microsoft.Xna.Framework.Graphics", "MonoGame.Framework", "FNA")
PLATFORMS = "windows win win32 win64 mac macos osx linux linux64 ps4 ps5 playstation xbox xboxone switch nx android ios mobile vita".split()
TEXTURE_FORMATS = "bc1 bc2 bc3 bc4 bc5 bc6 bc7 etc1 etc2 astc dxt1 dxt5 pvr".split()


def known_texture_reader(name: Column, version: Column) -> Column:
    """Whether an assembly-qualified name is the texture reader's: its exact name, alone or with an assembly of the list, and qualifiers that are known, well formed and each given once."""
    parts = F.transform(F.split(name, ","), lambda p: F.trim(p))
    qualifiers = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    keys = F.transform(qualifiers, lambda q: F.substring_index(q, "=", 1))

    def valid(q: Column) -> Column:
        number = F.transform(F.split(F.substring_index(q, "=", -1), r"\."), lambda v: v.rlike("^[0-9]{1,5}$") & (v.try_cast("int") <= 65535))
        version_ = q.rlike(r"^Version=[^=]*$") & (F.size(number) == 4) & F.forall(number, lambda x: F.coalesce(x, F.lit(False)))
        return version_ | (q == "Culture=neutral") | q.rlike("^PublicKeyToken=(null|[0-9A-Fa-f]{16})$")

    named = F.get(parts, F.lit(0)) == TEXTURE_READER
    alone, assembly = F.size(parts) == 1, F.coalesce(F.get(parts, F.lit(1)).isin(*ASSEMBLIES), F.lit(False))
    return (version == 0) & named & (alone | (assembly & (F.size(F.array_distinct(keys)) == F.size(keys)) & F.forall(qualifiers, valid)))


def candidate_summary(plans: DataFrame) -> DataFrame:
    """One row over (status, count, before, after): games, those with a valid plan, those that a plan would make smaller, errors."""
    ok = F.col("status") == "ok"
    better = F.coalesce(ok & (F.col("count") > 0) & (F.col("before") > F.col("after")), F.lit(False))
    return plans.agg(F.count("*").alias("total"), F.count_if(ok).alias("completed"), F.count_if(better).alias("candidates"), F.count_if(~ok).alias("errors"))


def verified_plans(stream: DataFrame, fields: int, texts: int, before: int, key: str = "game") -> DataFrame:
    """(key, status, count, before, after) of a recorded stream of plans, one row a key; see ``ledgers.records``."""
    from ..sources import ledgers

    rows = ledgers.records(stream, "ASSETS", fields, key, texts, before)
    number = lambda i: F.get("fields", F.lit(i)).try_cast("long")
    return rows.select(key, "status", number(before - 2).alias("count"), number(before - 1).alias("before"), number(before).alias("after"))


def export_report(rows: DataFrame, path: str = "path") -> DataFrame:
    """(path, status) of texture exports (before, after, error): a result is exported only if it is smaller; what can't be read or is there already is skipped, the rest failed."""
    error = F.col("error")
    status = F.when(error == "unsupported", "skipped_unsupported").when(error == "exists", "skipped_existing").when(error.isNotNull(), "failed").when(F.col("after") >= F.col("before"), "skipped_no_gain").otherwise("exported")
    return rows.select(path, status.alias("status"), "before", "after")


def export_totals(report: DataFrame) -> DataFrame:
    """One row: files exported with their bytes before and after, files skipped, files failed."""
    done = F.col("status") == "exported"
    size = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c)
    return report.agg(F.count_if(done).alias("exported"), size("before"), size("after"), F.count_if(F.startswith("status", F.lit("skipped"))).alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"))


def composite_errors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Of each image pair, over pixels (r, g, b, a, and r2, g2, b2, a2): squared errors on a black and on a white background, PSNR of both, and how many alphas differ.

    Colours are taken as 255 times their composite, so sums are of whole numbers and don't depend on order.
    """
    on_black = [(F.col(c).cast("long") * F.col("a"), F.col(f"{c}2").cast("long") * F.col("a2")) for c in "rgb"]
    shift = (F.col("a2") - F.col("a")).cast("long") * 255
    black = sum(((x - y) * (x - y) for x, y in on_black), F.lit(0).cast("long"))
    white = sum(((x - y + shift) * (x - y + shift) for x, y in on_black), F.lit(0).cast("long"))
    sums = pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(black).alias("black"), F.sum(white).alias("white"), F.count_if(F.col("a") != F.col("a2")).alias("alpha_differing"))
    db = lambda c: quality.psnr_db(F.col(c) / 65025.0, F.col("n") * 3)
    return sums.withColumn("black_db", db("black")).withColumn("white_db", db("white"))


def texture_opportunities(textures: DataFrame, keys: list[str], edge: int) -> DataFrame:
    """What smaller textures would save, apart from other totals: of each key files, audited ones, those left out by an atlas name, candidates and bytes; over (path, width, height, payload, error).

    A texture is a candidate if it is over ``edge``; its new payload keeps the bytes a pixel. Errors are counted, not summed.
    """
    named = T.atlas_hint(F.col("path"))
    bad = F.col("error").isNotNull()
    w, h = quality.scaled(F.col("width"), F.col("height"), F.lit(edge))
    smaller = F.floor(F.col("payload") * w * h / (F.col("width") * F.col("height"))).cast("long")
    saved = F.when(~named & ~bad & (F.greatest("width", "height") > edge) & (smaller < F.col("payload")), F.col("payload") - smaller)
    rows = textures.withColumn("_saved", saved)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("files"), F.count_if(~named & ~bad).alias("audited"), F.count_if(named).alias("name_skips"), F.count("_saved").alias("candidates"), F.coalesce(F.sum("_saved"), F.lit(0)).alias("saving"),
        F.count_if(~named & bad).alias("errors"), F.when(F.bool_or(~named & bad), "partial error").otherwise("ok").alias("status"),
    )


def format_rollup(textures: DataFrame) -> DataFrame:
    """Of each texture format its textures, bytes inline and bytes streamed."""
    return textures.groupBy("format").agg(F.count("*").alias("textures"), F.coalesce(F.sum("inline_bytes"), F.lit(0)).alias("inline_bytes"), F.coalesce(F.sum("streamed_bytes"), F.lit(0)).alias("streamed_bytes"))


def audio_verdict(entries: DataFrame, keys: list[str], least_db: float = 20.0) -> DataFrame:
    """Of each bank, over changed entries (entry, same_meta, signal, error): whether all have their metadata and the least ratio is enough, and the worst entry."""
    db = quality.snr_db(F.col("signal"), F.col("error"))
    fit = F.col("same_meta") & F.coalesce(db >= least_db, F.lit(False))
    worst = F.min(F.struct(F.coalesce(db, F.lit(float("-inf"))).alias("db"), "entry"))
    found = entries.groupBy(*keys).agg(F.count("*").alias("changed"), F.count_if(~fit).alias("failed"), worst.alias("w"))
    return found.select(*keys, "changed", "failed", F.col("w.entry").alias("worst_entry"), F.col("w.db").alias("worst_db"), (F.col("failed") == 0).alias("passed"))


def extent_sizes(items: DataFrame, keys: list[str]) -> DataFrame:
    """Disk, raw and referenced bytes, and the disk share in whole percent, over extent items (kind 0 inline, 1 regular, 2 preallocated; raw, disk, physical, referenced).

    Inline items count always; others count their disk and raw bytes once for each physical address, referenced bytes always; physical 0 is a hole and counts nothing.
    """
    inline = items.filter("kind = 0").groupBy(*keys).agg(F.sum("disk").alias("disk"), F.sum("raw").alias("raw"), F.sum("referenced").alias("referenced"))
    each = items.filter("kind <> 0 and physical <> 0").groupBy(*keys, "physical").agg(F.min("disk").alias("disk"), F.min("raw").alias("raw"), F.sum("referenced").alias("referenced"))
    both = inline.unionByName(each.drop("physical")).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("disk", "raw", "referenced")])
    return both.withColumn("pct", F.when(F.col("raw") > 0, F.floor(F.col("disk") * 100 / F.col("raw"))).otherwise(0).cast("long"))


def logical_bytes(files: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of files with each inode once, under the size of its first path."""
    once = files.groupBy(*keys, "dev", "ino").agg(F.min_by("size", "rel_path").alias("size"))
    return once.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def statistics(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statistics screen: measured rows with their truncated percentage, and one row of totals with the whole percentage of the savings as stored."""
    own = state.filter("path is not null and uncomp_mib > 0")
    rows = own.select("name", "path", F.expr("saved_mib * 100 div uncomp_mib").alias("pct"))
    totals = own.agg(F.count("*").alias("rows"), F.sum("uncomp_mib").alias("uncomp_mib"), F.sum("disk_mib").alias("disk_mib"), F.sum("saved_mib").alias("saved_mib"))
    return rows, totals.withColumn("pct", F.expr("saved_mib * 100 div uncomp_mib"))


def job_saving(rows: DataFrame) -> DataFrame:
    """One row: games, those measured before and after, and the sum saved over these; null if none is."""
    known = F.col("before").isNotNull() & F.col("after_assets").isNotNull()
    return rows.agg(F.count("*").alias("games"), F.count_if(known).alias("measured"), F.sum(F.when(known, F.col("before") - F.col("after_assets"))).alias("saved"))


def _kind() -> Column:
    """What kind of fallback a folder's name is: r (resolution), p (platform), t (texture format), l (language); null for any other."""
    name = F.lower("name")
    return F.when(T.resolution_rank(F.col("name")).isNotNull(), "r").when(name.isin(*PLATFORMS), "p").when(name.isin(*TEXTURE_FORMATS), "t").when(T.language_of(F.col("name")).isNotNull(), "l")


def tier_plan(dirs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, bytes): folders that are fallbacks of another with the same members (``dirs``: path, name, members, bytes).

    A folder above all others of its group is the base; then all others go if each is a resolution or texture format. Without a base, and if all are resolutions, those below the highest go.
    Groups with a platform, a language or any other name are left alone.
    """
    held = dirs.withColumn("_kind", _kind()).withColumn("_rank", T.resolution_rank(F.col("name"))).withColumn("_group", F.xxhash64("members"))
    group = [*keys, "_group", "members"]
    # The base can only be the shortest path of its group.
    tops = held.groupBy(*group).agg(F.min_by(F.col("path"), F.struct(F.length("path"), "path")).alias("_top"), F.count("*").alias("_n"), F.count_if(F.col("_kind").isNull()).alias("_other"))
    rows = held.join(tops.filter("_n > 1"), group)
    under = F.startswith(F.col("path"), F.concat("_top", F.lit("/")))
    sums = rows.groupBy(*group).agg((F.count_if(under) == F.max("_n") - 1).alias("_based"), F.max("_rank").alias("_most"))
    rows = rows.join(sums, group).withColumn("_base", F.col("_based") & (F.col("path") == F.col("_top")))
    kinds = rows.groupBy(*group).agg(F.bool_and(F.col("_base") | F.coalesce(F.col("_kind").isin("r", "t"), F.lit(False))).alias("_tiers"), F.bool_and(F.col("_base") | F.coalesce(F.col("_kind") == "r", F.lit(False))).alias("_ranks"))
    rows = rows.join(kinds, group).filter("not _base and _tiers and (_based or (_ranks and _rank < _most))")
    return rows.select(*keys, "path", "bytes")
