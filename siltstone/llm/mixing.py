"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight. A source whose target is k times its size gives k
complete epochs; the rest of the target comes from its documents in the order of their keys, up to where the prefix
sum of their sizes meets the budget, and from one more document of the size nearest to what is still missing.
Prefix sums are made in two levels, within buckets of the keys and over the buckets' totals, so no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The weights of the sources in their order, repeated.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """A quality weight from 0.05 to 1: the share of letters among the characters that are not white space."""
    ink = F.char_length(F.regexp_replace(text, common.SPACE_CLASS, ""))
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters, ink), F.lit(0.0)))


def exponential_key(weight: Column, seed: int, *ids: Column) -> Column:
    """-ln(u) / weight, ``u`` a hash of the ids in (0, 1): the smaller, the sooner."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def source_key(source: Column) -> Column:
    """A source as a key that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def _weights(rows: DataFrame) -> DataFrame:
    """(mix_key, weights): of each source the weights of its rows, to the next quarter of a power of two, with their shares; some dozens of weights at most."""
    step = F.round(F.log2(F.greatest(F.least("weight", F.lit(2.0**40)), F.lit(2.0**-40))) * 4).cast("int")
    counts = rows.groupBy("mix_key", step.alias("step")).agg(F.count("*").alias("n"))
    held = counts.groupBy("mix_key").agg(F.array_sort(F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("step") / 4).alias("w"), F.col("n").cast("double").alias("n")))).alias("w"), F.sum("n").alias("all"))
    return held.select("mix_key", F.transform("w", lambda x: F.struct(x["w"].alias("w"), (x["n"] / F.col("all")).alias("share"))).alias("weights"))


def _share_before(key: Column, weights: Column) -> Column:
    """The expected share of a source's rows with a smaller key: it grows with the key, so buckets by it follow the keys and are about equal whatever the weights."""
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a + x["share"] * (1 - F.exp(-key * x["w"])))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(mix_key, source_size, target) from (mix_key, source_size): weighted shares of the whole, filled up to ``most`` times a size.

    What is above a limit is reshared by weight until none is above. In the order of limit / weight the limited sources come
    first, so the level is where the rest of the whole divided by the rest of the weights falls below the next ratio.
    """
    order = Window.orderBy("mix_key")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    held = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), "mix_key")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    held = held.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.col("level") < F.col("limit") / F.col("weight")
    held = held.withColumn("level", F.min_by(F.col("level"), F.when(fits, F.col("limit") / F.col("weight"))).over(every))
    return held.select("mix_key", "source_size", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies, text_hash; one row a row of ``docs``.

    Sources rank by code point, a null source last as one of its own. A null or empty text has size 0 and is taken with 0 words. Equal keys rank by doc_id, then size; repeated rows are documents of their own. The keys are a hash of seed, doc_id and text, so reruns agree. An empty table gives an empty result; further columns are not read.
    """
    own, text = (docs if quality is None else docs.withColumn("quality weight", quality)), F.col("text")
    rows = common.numbered(own).select(
        common.named(docs, id_col).cast("long").alias("doc_id"),
        source_key(common.named(docs, source_col)).alias("mix_key"),
        common.named(docs, text_col).cast("string").alias("text"),
        (F.lit(None).cast("double") if quality is None else F.col(f"c{len(docs.columns)}")).alias("given"),
    )
    rows = rows.select("doc_id", "mix_key", word_count(text).alias("size"), (letter_share(text) if quality is None else F.col("given")).alias("weight"), F.xxhash64(text).alias("text_hash"))
    rows = common.store(rows.withColumn("key", exponential_key(F.col("weight"), seed, F.col("doc_id"), F.col("text_hash"))), "sizes")
    n = max(256, rows.count() // 200_000)
    rows = common.join_sized(rows, _weights(rows), "mix_key", "inner", 1024).withColumn("part", F.least(F.floor(_share_before(F.col("key"), F.col("weights")) * n), F.lit(n - 1)).cast("int")).drop("weights", "weight")
    source = targets(rows.groupBy("mix_key").agg(F.sum("size").alias("source_size")))
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    source = common.store(source.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")

    inside = Window.partitionBy("mix_key", "part").orderBy("key", "doc_id", "size")
    ranked = rows.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("pos", F.row_number().over(inside))
    parts = rows.groupBy("mix_key", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("mix_key", "part", F.coalesce(F.sum("part_size").over(Window.partitionBy("mix_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = common.join_sized(ranked.join(parts, ["mix_key", "part"]), source, "mix_key", "inner", 128)
    placed = placed.withColumn("picked", (F.col("budget") > 0) & (F.col("before") + F.col("run") <= F.col("budget")))
    placed = common.store(placed.drop("before", "run"), "placed")

    gap = placed.groupBy("mix_key").agg((F.first("budget") - F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0))).alias("gap"))
    open_ = common.join_sized(placed.filter("not picked and size > 0 and budget > 0"), gap, "mix_key", "inner", 128)
    off = F.abs(F.col("size") - F.col("gap"))
    more = open_.filter(off < F.col("gap")).groupBy("mix_key").agg(F.min(F.struct(off.alias("off"), "key", "doc_id", "part", "pos")).alias("x"))
    more = more.select("mix_key", F.col("x.part").alias("part"), F.col("x.pos").alias("pos"), F.lit(True).alias("last"))
    ended = common.join_sized(placed, more, ["mix_key", "part", "pos"], "left", 128)
    copies = F.col("epochs") + F.when(F.col("picked") | F.coalesce("last", F.lit(False)), 1).otherwise(0)
    return ended.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "text_hash", "mix_key")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns, which may have any names; documents without a word (null, empty) go.

    Rows equal in id, text and source are alike to the mix: its copies of them are dealt to them in turn. An empty table gives an empty result.
    """
    found = mix(docs, id_col, text_col, source_col, **options).filter("taken > 0")
    plan = found.groupBy("doc_id", "text_hash", "mix_key").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    plan = common.store(plan.select(F.col("doc_id").alias("plan_id"), F.col("text_hash").alias("plan_hash"), F.col("mix_key").alias("plan_key"), "copies", "rows"), "plan")
    own = common.numbered(docs)
    plain = own.columns
    keyed = own.withColumn("id", common.named(docs, id_col).cast("long")).withColumn("hash", F.xxhash64(common.named(docs, text_col).cast("string"))).withColumn("key", source_key(common.named(docs, source_col)))
    taken = keyed.join(plan, F.col("id").eqNullSafe(F.col("plan_id")) & (F.col("hash") == F.col("plan_hash")) & (F.col("key") == F.col("plan_key")))
    if plan.filter("rows > 1").take(1):
        # A row equal to others gets its share of their copies, whichever it is.
        told = F.xxhash64(*[f"c{i}" for i, f in enumerate(docs.schema.fields) if not f.dataType.simpleString().startswith(("map", "variant"))])
        ranked = taken.filter("rows > 1").withColumn("row", F.row_number().over(Window.partitionBy("id", "hash", "key").orderBy(told)) - 1)
        ranked = ranked.withColumn("copies", (F.floor(F.col("copies") / F.col("rows")) + (F.col("row") < F.col("copies") % F.col("rows")).cast("int")).cast("int"))
        taken = taken.filter("rows = 1").select(*plain, "copies").unionByName(ranked.select(*plain, "copies"))
    return taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*plain).toDF(*docs.columns)
