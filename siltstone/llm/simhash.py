"""SimHash near-dedup by anchor-point covering.

A fingerprint's anchors are the words of a covering code: the direct product of two binary Golay codes over 46 of the 64
bits, of covering radius 3 in each half. Every fingerprint has one home, the anchor nearest to it, and visits each anchor
that a fingerprint within the threshold could have as its home: those within covering radius plus threshold, where the
threshold is shared between the halves. So two fingerprints within the threshold always meet at an anchor, and
comparing homes with visitors at each anchor finds every link. A pair needs both halves of its anchor in
common, which leaves one of 2^24 anchors about n / 2^24 homes: up to some ten million different fingerprints the work
grows with n alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .exact_dedup import drop_rows
from .shingle_links import similar_links

#: The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code, its length and covering radius.
GOLAY_POLYNOMIAL = 0b101011100011
GOLAY_LENGTH = 23
GOLAY_RADIUS = 3

_BLOCK = (1 << GOLAY_LENGTH) - 1
#: Homes compared with visitors at once, and the visitors from which a home's neighbours are looked up instead.
_CHUNK, _MANY = 1 << 19, 4096


def fingerprint(text: bytes | None, width: int) -> int:
    """The 64-bit SimHash, unsigned, of the ``width``-word shingles of a text in lower case (A-Z only)."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): a signed long for each row; a null or empty text has 0."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = common.utf8(batch.column(1)).to_pylist()
            fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return common.text_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


@cache
def _columns() -> np.ndarray:
    """The syndrome of each single bit."""
    out = []
    for i in range(GOLAY_LENGTH):
        v = 1 << i
        while v.bit_length() >= 12:
            v ^= GOLAY_POLYNOMIAL << (v.bit_length() - 12)
        out.append(v)
    return np.array(out, dtype=np.int64)


def _syndrome(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for i, c in enumerate(_columns()):
        out ^= np.where((x >> i) & 1, c, 0)
    return out


@cache
def _patterns(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All error patterns of weight up to ``reach``, by syndrome and then weight; their weights; where each syndrome begins."""
    vectors = [sum(1 << i for i in bits) for w in range(reach + 1) for bits in combinations(range(GOLAY_LENGTH), w)]
    weights = [w for w in range(reach + 1) for _ in combinations(range(GOLAY_LENGTH), w)]
    v, w = np.array(vectors, dtype=np.int64), np.array(weights, dtype=np.int64)
    s = _syndrome(v)
    order = np.lexsort((w, s))
    return v[order], w[order], np.searchsorted(s[order], np.arange((1 << 11) + 1))


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in fps, anchor, is home) of every anchor of each fingerprint."""
    x = fps.view(np.uint64)
    left, right = (x & np.uint64(_BLOCK)).astype(np.int64), ((x >> np.uint64(GOLAY_LENGTH)) & np.uint64(_BLOCK)).astype(np.int64)
    s, t = _syndrome(left), _syndrome(right)
    vectors, weights, begins = _patterns(GOLAY_RADIUS + threshold)
    at, out, home = [], [], []
    for i, (a, b, p, q) in enumerate(zip(left.tolist(), right.tolist(), s.tolist(), t.tolist())):
        e, f = slice(begins[p], begins[p + 1]), slice(begins[q], begins[q + 1])
        over_left, over_right = np.maximum(weights[e] - GOLAY_RADIUS, 0), np.maximum(weights[f] - GOLAY_RADIUS, 0)
        near = over_left[:, None] + over_right[None, :] <= threshold
        both = ((a ^ vectors[e]) << GOLAY_LENGTH)[:, None] | (b ^ vectors[f])[None, :]
        is_home = (weights[e] <= GOLAY_RADIUS)[:, None] & (weights[f] <= GOLAY_RADIUS)[None, :]
        picked = both[near]
        out.append(picked)
        home.append(is_home[near])
        at.append(np.full(len(picked), i))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=bool),)
    return np.concatenate(at), np.concatenate(out), np.concatenate(home)


@cache
def _flips(threshold: int) -> np.ndarray:
    return np.array([sum(1 << i for i in bits) for w in range(1, threshold + 1) for bits in combinations(range(64), w)], dtype=np.uint64)


def _spanning(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the pairs, a link from each node to the smallest of its component."""
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints that meet at the anchors of one bucket, as a forest."""
    fp = fp.view(np.uint64)  # the lookup below needs them in unsigned order
    order = np.lexsort((fp, anchor))
    anchor, fp, home = anchor[order], fp[order], home[order]
    at = np.flatnonzero(home)
    low, high = np.searchsorted(anchor, anchor[at], "left"), np.searchsorted(anchor, anchor[at], "right")
    size = high - low
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        links.append((a, b))
        if sum(len(x) for x, _ in links) > _CHUNK:
            links[:] = [_spanning(links)]

    few = np.flatnonzero((size > 1) & (size <= _MANY))
    for part in np.array_split(few, max(1, int(size[few].sum() // _CHUNK) + 1)) if len(few) else []:
        if not len(part):
            continue
        n = size[part]
        mine = np.repeat(at[part], n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)
        near = np.bitwise_count(fp[mine] ^ fp[other]) <= threshold
        near &= fp[mine] != fp[other]
        keep(fp[mine[near]], fp[other[near]])
    flips = _flips(threshold)
    for i in np.flatnonzero(size > _MANY):
        around = fp[at[i]] ^ flips
        rows = fp[low[i] : high[i]]
        where = np.searchsorted(rows, around)
        hit = rows[np.minimum(where, len(rows) - 1)] == around
        keep(np.full(hit.sum(), fp[at[i]]), around[hit])
    links = [x for x in links if len(x[0])]
    return _spanning(links) if links else (np.zeros(0, np.uint64),) * 2


def link_fingerprints(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): links whose components are those of all pairs of different fingerprints (column ``fp``) within ``threshold`` bits."""
    spark = fps.sparkSession
    common.ship(spark)
    buckets = common.n_buckets(spark, fps.count() * 64, 100_000)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 4_000):
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(values), 4_000):
                part = values[i : i + 4_000]
                at, anchor, home = anchors(part, threshold)
                bucket = (common.mix(anchor.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield from common.pack(bucket, {"anchor": anchor, "fp": part[at], "home": home.astype(np.uint8)})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _compare(common.unpack(pdf.anchor, np.int64), common.unpack(pdf.fp, np.int64), common.unpack(pdf.home, np.uint8) > 0, threshold)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "bucket int, anchor binary, fp binary, home binary")
    return dealt.groupBy("bucket").applyInPandas(meet, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links), one row a row of ``docs``.

    Texts are lower-cased (A-Z) and split at ASCII white space; fewer than ``width`` words make one shingle; a text without words (null, empty) has fingerprint
    zero and is linked like any other. Equal fingerprints are linked. Repeated rows stay; a null doc_id never names a component
    unless all its members' ids are null. An empty table gives an empty result; further columns are not read.
    """
    own = common.store(fingerprints(docs, id_col, text_col, width), "fingerprints")
    fps = common.store(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    links = common.store(link_fingerprints(fps, threshold), "links")
    parts = connected_components(links)
    named = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = common.store(named.join(names, "component").select("fp", "component_id"), "components")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _near(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int, similarity: float) -> DataFrame:
    """node (see ``common.node``), doc_id, component_id, keep (the node that stays), one row a row of ``docs``."""
    rows = common.text_id(docs, id_col, text_col).select("doc_id", common.node("doc_id", "text").alias("node"), "text")
    own = common.store(simhash_components(rows, "node", "text", width, threshold).select(F.col("doc_id").alias("node"), "component_id"), "near")
    close = own.filter("node <> component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b"))
    links = close.unionAll(similar_links(rows, "node", "text", width, similarity)).distinct()
    parts = connected_components(links).select("node", "component")
    named = common.join_sized(rows.select("node", "doc_id"), parts, "node", "left", 32).select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    named = common.store(named, "named")
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("least"), F.count("*").alias("n"))
    least = common.store(least.filter("n > 1").select("component", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("keep")), "least")
    found = common.join_sized(named, least, "component", "left", 48)
    alone = F.col("keep").isNull()
    return found.select("node", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("keep", "node").alias("keep"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 3, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id by links of either kind: fingerprints within ``threshold`` bits, or shingle sets of Jaccard ``similarity`` or more.

    Repeated rows stay; a null doc_id names a component only if all its members' ids are null. Texts without a word (null, empty) are one component, texts of any length are read whole, an
    empty table gives an empty result, and further columns are not read.
    """
    return _near(docs, id_col, text_col, width, threshold, similarity).select("doc_id", "component_id")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 3, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component (see ``near_components``), with all their columns; of rows equal in id and text one stays.

    Rows that only share an id, or have none, are told apart by their texts: of a component they stay for one text. Columns may have any names; texts without a word (null, empty) are one
    component; an empty table gives an empty result.
    """
    found = common.store(_near(docs, id_col, text_col, width, threshold, similarity).groupBy("node", "keep").count(), "components")
    return drop_rows(docs, id_col, text_col, found.filter("node <> keep").select("node"), found.filter("node = keep and count > 1").select("node"))
