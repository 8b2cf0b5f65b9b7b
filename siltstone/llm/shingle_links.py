"""Links between texts by the Jaccard similarity of their word shingles: banded min-hashes propose, sketches screen, whole shingle sets decide.

SimHash distances of texts that share four fifths of their five-word shingles are about ten of 64 bits, farther than a covering of anchors can reach; where such texts must be found,
these links go beside those of the fingerprints. In each band's group a text is first proposed with the group's smallest id and with the id before its own. Groups of four or more whose
members are then not all linked are compared as a whole: each is dealt into blocks of a bounded size, every two blocks meet in one unit with the whole shingle sets, and a unit gives a
forest of the similar pairs that join components. So links have the components of all similar pairs that share a band, and grow with the members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Bands and min-hashes in each: of pairs at 0.8 all but one in 2,000 share a band.
BANDS, ROWS = 20, 5
#: How far below the similarity a sketch's estimate may be: seven standard errors at 0.8, so that only the whole sets decide.
SLACK = 0.3
#: Members of a block of a large group, and shingles compared at once.
BLOCK, WIDE = 512, 4096


@cache
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(29)
    return rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles, in lower case (A-Z); a text of fewer words has one shingle, one without words none."""
    if not text or text.isspace():
        return np.zeros(0, dtype=np.uint64)
    words = common.Words([text.lower()])
    n = len(words.hash)
    return np.unique(words.runs(min(width, n))) if n else np.zeros(0, dtype=np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least of each of BANDS x ROWS permuted hashes, as unsigned 32-bit integers."""
    a, b = _seeds()
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            part = shingles[i : i + 4096]
            np.minimum(out, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1), out=out)
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(shared.sum()), WIDE):
        a, b = np.searchsorted(column, [at, at + WIDE])
        held = np.zeros((len(sets), WIDE), dtype=np.float32)
        held[row[a:b], column[a:b] - at] = 1
        out += held @ held.T
    return out


def compare_unit(doc: np.ndarray, part: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Similar pairs (greater doc first) of different components ``part``, as many as it takes to join what all such pairs join."""
    size, shared = np.array([len(s) for s in sets], dtype=np.float32), _overlaps(sets)
    near = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-3
    near &= part[:, None] != part[None, :]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        x, y = find(int(part[i])), find(int(part[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((max(int(doc[i]), int(doc[j])), min(int(doc[i]), int(doc[j]))))
    return out


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): pairs of doc_ids, b below a, whose shingle sets' Jaccard similarity is ``similarity`` or more, with the components of all such pairs that share a band.

    Rows without an id or a word give none; of rows that share an id the least sketch and set stand for all.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.text_id(docs, id_col, text_col).filter("doc_id is not null and text is not null")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made = [sketch(s) if len(s := shingle_set(t, width)) else None for t in common.utf8(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if m is None else m.tobytes() for m in made], pa.binary())], names=["doc_id", "sketch"])

    # One row an id, so that the joins below read written tables on both sides and Spark can split the rows of an id that many links name.
    drawn = rows.mapInArrow(draw, "doc_id long, sketch binary").filter("sketch is not null")
    sketches = common.store(drawn.groupBy("doc_id").agg(F.min("sketch").alias("sketch")), "sketches")
    buckets = common.n_buckets(spark, sketches.count() * BANDS, 200_000)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids = batch.column(0).to_numpy()
            mins = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(len(ids), BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), mins.shape[:2]).copy()
                for j in range(ROWS):
                    key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[:, :, j])
            key = key.ravel()
            yield from common.pack((key % np.uint64(buckets)).astype(np.int64), {"key": key, "doc": np.repeat(ids, BANDS)})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        key, doc = common.unpack(pdf.key, np.uint64), common.unpack(pdf.doc, np.int64)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.r_[True, key[1:] != key[:-1]]
        head = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
        after = np.flatnonzero(~first)
        pairs = np.unique(np.r_[np.c_[doc[after], head[after]], np.c_[doc[after], doc[after - 1]]], axis=0) if len(after) else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        # Groups of two and three are compared in full by these pairs.
        size = np.diff(np.r_[np.flatnonzero(first), len(doc)])
        large = np.repeat(size > 3, size)
        return pd.DataFrame({"a": np.r_[pairs[:, 0], doc[large]], "b": np.r_[pairs[:, 1], key[large].view(np.int64)], "pair": np.r_[np.ones(len(pairs), bool), np.zeros(int(large.sum()), bool)]})

    met = common.store(sketches.mapInArrow(deal, "bucket int, key binary, doc binary").groupBy("bucket").applyInPandas(meet, "a long, b long, pair boolean"), "met")
    proposed = met.filter("pair").select("a", "b").distinct()
    members = met.filter("not pair").select(F.col("a").alias("doc"), F.col("b").alias("key"))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            near = (x == y).mean(axis=1) >= similarity - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in (0, 1)], names=["a", "b"])

    both = proposed.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b")
    likely = common.store(both.select("a", "b", "x", "y").mapInArrow(screen, "a long, b long"), "likely")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = [shingle_set(t, width).astype(np.uint32) for t in common.utf8(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    def shingles_of(wanted: DataFrame, label: str) -> DataFrame:
        found = common.join_sized(rows, wanted, "doc_id", "left_semi", 32).mapInArrow(gather, "doc_id long, shingles binary")
        return common.store(found.groupBy("doc_id").agg(F.min("shingles").alias("shingles")), label)

    needed = common.store(likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct(), "needed")
    sets = shingles_of(needed, "shingles")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                common_ = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(common_ >= similarity * (len(p) + len(q) - common_) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    whole = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    links = common.store(whole.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long"), "similar")
    parts = connected_components(links).select(F.col("node").alias("doc"), "component")
    labelled = common.store(common.join_sized(members, parts, "doc", "left", 32).select("doc", "key", F.coalesce("component", "doc").alias("part")), "members")
    open_ = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    open_ = common.store(open_.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    if not open_.take(1):
        return links
    dealt = common.join_sized(labelled, open_, "key", "inner", 32).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = common.store(dealt.select("doc", "part", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit")), "units")
    more = shingles_of(dealt.select(F.col("doc").alias("doc_id")).distinct(), "more")
    n = common.n_buckets(spark, dealt.count(), 2_000)
    ready = dealt.join(more.withColumnRenamed("doc_id", "doc"), "doc").withColumn("bucket", F.pmod("unit", F.lit(n)).cast("int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in pdf.groupby("unit"):
            out += compare_unit(unit.doc.to_numpy(), unit.part.to_numpy(), [np.frombuffer(x, np.uint32) for x in unit.shingles], similarity)
        return pd.DataFrame({"a": [x for x, _ in out], "b": [y for _, y in out]}, dtype=np.int64)

    return links.unionAll(common.store(ready.groupBy("bucket").applyInPandas(compare, "a long, b long"), "met-whole")).distinct()
