"""Exact dedup by a log-structured merge index, with DataFrame operations only.

Each input partition is a memtable: it is flushed as one run of (digest, document), sorted by digest, written with a
Parquet Bloom filter and min/max statistics on the digest. Compaction merges the runs and keeps, for each digest, the
smallest identifier in the order of preference. Every hit (a digest of two or more rows) is verified by its bytes; should
two texts share a digest, their rows are keyed by digest and text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_RUN = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000"}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE_CLASS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _compact(runs: DataFrame) -> DataFrame:
    """One row a digest: the row that stays, and how many rows there are."""
    rank = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    best = runs.groupBy("digest").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))
    return best.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """Group equal texts: doc_id, keep_id, group_size, kept, text_sha256, one row a row of ``docs``.

    Texts are equal when identical without ASCII white space. The row with the most code points stays, then the smallest
    doc_id (null last); of rows that agree in both one stays. Null texts count as empty, empty texts equal each other; an
    empty table gives an empty result; further columns are not read. ``digest`` (a function of the normalised text) may be
    any digest, collisions are found by bytes.
    """
    return _grouped(docs, id_col, text_col, digest).drop("node")


def _grouped(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """The rows of ``exact_dedup`` with their ``node`` (see ``common.node``)."""
    rows = common.text_id(docs, id_col, text_col)
    norm = normalised(F.col("text"))
    flushed = rows.select("doc_id", common.node("doc_id", "text").alias("node"), norm.alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_cp"))
    flushed = flushed.select("doc_id", "node", "n_cp", digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("text_sha256"), F.monotonically_increasing_id().alias("row_id"))
    runs = common.store(flushed.sortWithinPartitions("digest"), "runs", **_RUN)
    index = common.store(_compact(runs), "index", **_RUN)
    hits = index.filter("group_size > 1")

    # Only the texts of hits are read again: their rows are found by node, and a node that two digests share only has more texts compared.
    suspects = common.store(common.join_sized(runs.select("node", "digest"), hits.select("digest"), "digest", "left_semi", 100).distinct(), "suspects")
    texts = common.join_sized(rows.withColumn("node", common.node("doc_id", "text")), suspects, "node", "inner", 120)
    same = texts.select("digest", norm.alias("norm"))
    clash = same.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest")
    clash = common.store(clash, "clash")
    if clash.take(1):
        runs, index = _by_bytes(rows, norm, digest, clash)
        hits = index.filter("group_size > 1")

    found = common.join_sized(runs, hits, "digest", "left", 160)
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        "node",
    )


def _by_bytes(rows: DataFrame, norm: Column, digest, clash: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs and their index where texts with a clashing digest are told apart by their bytes."""
    flushed = rows.select("doc_id", common.node("doc_id", "text").alias("node"), norm.alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_cp"))
    flushed = flushed.select("*", digest(F.col("norm")).alias("plain")).join(clash.withColumnRenamed("digest", "plain").withColumn("two", F.lit(True)), "plain", "left")
    key = F.when(F.col("two"), F.concat(F.col("plain").cast("string"), F.lit(":"), F.col("norm"))).otherwise(F.col("plain").cast("string"))
    runs = common.store(flushed.select("doc_id", "node", "n_cp", key.alias("digest"), sha256(F.col("norm")).alias("text_sha256"), F.monotonically_increasing_id().alias("row_id")), "runs")
    return runs, common.store(_compact(runs), "index")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, which may have any names; of rows equal in id and text one stays. Rows that only share an id, or have none, are told apart by their texts.

    Null texts count as empty, and empty texts equal each other; texts of any length are compared whole; an empty table gives an empty result.
    """
    groups = _grouped(docs, id_col, text_col).filter("group_size > 1")
    found = common.store(groups.groupBy("node").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "dropped")
    return drop_rows(docs, id_col, text_col, found.filter("not kept").select("node"), found.filter("kept and n > 1").select("node"))


def drop_rows(docs: DataFrame, id_col: str, text_col: str, drop: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` without the rows whose node (see ``common.node``) is in ``drop``; of the rows with a node in ``again``, one stays. Columns may have any names and come back unchanged; an empty table stays empty."""
    marked = common.numbered(docs).withColumn("node", common.node(common.named(docs, id_col).cast("long"), common.named(docs, text_col).cast("string")))
    kept = common.join_sized(marked, drop, "node", "left_anti", 32)
    if again.take(1):
        once = common.join_sized(kept, again, "node", "left_semi", 32).dropDuplicates(["node"])
        kept = common.join_sized(kept, again, "node", "left_anti", 32).unionByName(once)
    return kept.drop("node").toDF(*docs.columns)
