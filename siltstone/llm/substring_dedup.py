"""Substring dedup by suffix automata of reference shards.

A window (13 words) of a document goes if its words also start in a document with a smaller id. Equal windows hold the same anchor, the least hash among their six-word shingles.
First the anchors of all documents are dealt out by hash, and those of two or more documents go into a bit filter of a fixed size, which is broadcast. Anchors of very many documents go into a second
filter, and windows that have one take the least of their other shingles instead; so what surrounds a common line doesn't meet in one shard. Then each maximal run of windows
with a filtered anchor is dealt out, as text, to the shard of its anchor: so each shard holds every reference passage that its documents can match. A shard takes documents in the
order of their ids, streams their passages through the suffix automaton of the passages of all smaller ids for matching statistics, marks what lies in matches of a window's length or more,
and then adds to the automaton what was new. Copies of a passage go as a whole but in the least document that has it, and only that one is streamed. The filter only leaves passages out that cannot match; should it fill up, more passages are dealt out, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window and of an anchor; bits of each filter, fixed for any input; the documents from which an anchor is common.
WINDOW, ANCHOR, FILTER_BITS, COMMON = 13, 6, 1 << 27, 4096
_TOP = np.uint64(1 << 63)
_NO_ID = (1 << 63) - 1


class SuffixAutomaton:
    """A suffix automaton of several sequences of whole numbers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest match of ``p`` followed by ``c``, cut off from a longer one if need be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new

    def holds(self, sequence: list[int]) -> bool:
        """Whether ``sequence`` lies as a whole in one of the sequences."""
        state = 0
        for c in sequence:
            if c not in self.next[state]:
                return False
            state = self.next[state][c]
        return True

    def spans(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """The maximal spans of ``sequence`` that matches of ``least`` or more elements cover."""
        out: list[tuple[int, int]] = []
        state, length, following, link, longest = 0, 0, self.next, self.link, self.length
        for i, c in enumerate(sequence):
            while state and c not in following[state]:
                state = link[state]
                length = longest[state]
            if c in following[state]:
                state = following[state][c]
                length += 1
            if length >= least:
                if out and out[-1][1] >= i + 1 - length:
                    out[-1] = (min(out[-1][0], i + 1 - length), i + 1)
                else:
                    out.append((i + 1 - length, i + 1))
        return out


def _windows(words: common.Words, window: int, width: int, filters: Filters | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window by its first word, and whether it lies in one text: the least hash of its shingles, of those that are not common if there are any."""
    shingle = words.runs(width) & ~_TOP
    if filters is not None and filters.common is not None:
        shingle = shingle | np.where(filters.has(filters.common, shingle), _TOP, np.uint64(0))
    span = window - width + 1
    n = max(0, len(words.hash) - window + 1)
    low, done = shingle, 1
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        done += step
    return low[:n] & ~_TOP, words.doc[:n] == words.doc[window - 1 : window - 1 + n]


def _canonical(texts: list[bytes | None]) -> list[bytes]:
    return [b" ".join(t.split()) if t else b"" for t in texts]


@dataclass
class Filters:
    """Bit filters of anchors, of one size for any input: those of two or more documents, and those that are common. Buckets beyond the rows of a filter share them."""

    buckets: int
    slots: int
    repeated: np.ndarray
    common: np.ndarray | None

    def place(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (anchor % np.uint64(self.buckets)).astype(np.int64), ((anchor // np.uint64(self.buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def has(self, bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        bucket, rest = self.place(anchor)
        slot = (rest % np.uint32(self.slots)).astype(np.int64)
        return (bits[bucket % len(bits), slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _filters(rows: DataFrame, buckets: int, window: int, width: int) -> Filters:
    """The filters of all documents. Where anchors are common, the windows that have one are counted again by their other shingles."""
    lines = min(buckets, FILTER_BITS // 64)
    slots = max(64, FILTER_BITS // lines // 8 * 8)
    out = Filters(buckets, slots, np.zeros((lines, slots // 8), dtype=np.uint8), None)
    seen = np.zeros_like(out.repeated)
    _count(rows, out, None, window, width, out.repeated, seen)
    if seen.any():
        shared = rows.sparkSession.sparkContext.broadcast(Filters(buckets, slots, out.repeated[:0], seen))
        _count(rows, out, shared, window, width, out.repeated, None)
        out.common = seen
    return out


def _count(rows: DataFrame, shape: Filters, shared, window: int, width: int, repeated: np.ndarray, seen: np.ndarray | None) -> None:
    """Set the bits of the anchors that two or more documents hold, and of those that ``COMMON`` hold; with ``shared`` filters, of the windows alone whose anchor these change."""
    buckets, slots, most = shape.buckets, shape.slots, COMMON
    place = Filters(buckets, slots, repeated[:0], None).place

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in common.slices(batches):
            ids, texts = batch.column(0).to_numpy(), _canonical(common.utf8(batch.column(2)).to_pylist())
            for a, b in common.text_blocks(texts):
                words = common.Words(texts[a:b])
                anchor, valid = _windows(words, window, width)
                if shared is not None:
                    valid &= shared.value.has(shared.value.common, anchor)
                    if not valid.any():
                        continue
                    anchor, _ = _windows(words, window, width, shared.value)
                new = valid.copy()
                new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (words.doc[1 : len(anchor)] != words.doc[: len(anchor) - 1])
                held.append((anchor[new], ids[a:b][words.doc[: len(anchor)][new]]))
                size += int(new.sum())
                if size > 2_000_000:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Of each anchor the least and the greatest document, so that one of many documents is a row or two a flush."""
        if not held:
            return
        anchor, doc = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(anchor)] - 1 if len(anchor) else first
        count = np.minimum(last - first, 0xFFFF)
        two = doc[first] != doc[last]
        bucket, rest = place(np.r_[anchor[first], anchor[last[two]]])
        yield from common.pack(bucket, {"anchor": rest, "doc": np.r_[doc[first], doc[last[two]]], "more": np.r_[np.where(two, count - 1, 0), np.zeros(int(two.sum()))].astype(np.uint16)})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor, doc, more = common.unpack(pdf.anchor, np.uint32), common.unpack(pdf.doc, np.int64), common.unpack(pdf.more, np.uint16)
        order = np.argsort(anchor, kind="stable")
        anchor, doc, more = anchor[order], doc[order], more[order].astype(np.int64) + 1
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        # Documents without an id hold no smaller id than others, but their passages can match.
        twice, many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), np.add.reduceat(more, first) >= most
        out = {"bucket": [int(pdf.bucket.iloc[0])]}
        for name, chosen in (("bits", twice), ("many", twice & many)):
            bits = np.zeros(slots, dtype=bool)
            bits[anchor[first[chosen]] % np.uint32(slots)] = True
            out[name] = [np.packbits(bits, bitorder="little").tobytes() if chosen.any() else None]
        return pd.DataFrame(out)

    dealt = rows.mapInArrow(deal, "bucket int, anchor binary, doc binary, more binary")
    for r in dealt.groupBy("bucket").applyInPandas(meet, "bucket int, bits binary, many binary").toLocalIterator():
        for bits, found in ((repeated, r.bits), (seen, r.many)):
            if bits is not None and found is not None:
                bits[r.bucket % len(bits)] |= np.frombuffer(found, dtype=np.uint8)


def _match(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """The spans that go, of all passages of a shard."""
    number: dict[bytes, int] = {}
    passage, doc, text, start = [], [], [], []
    sure = [np.frombuffer(x, _SPAN) for x in pdf.sure if x is not None]
    for r in pdf[pdf.passages.notna()].itertuples():
        own = np.array([number.setdefault(p, len(number)) for p in r.passages.split(b"\n")], dtype=np.int64)
        passage.append(own[np.frombuffer(r.at, np.uint32)])
        doc.append(np.frombuffer(r.doc, np.int64))
        text.append(np.frombuffer(r.text, np.int64))
        start.append(np.frombuffer(r.start, np.int32))
    sure = np.concatenate([*sure, np.zeros(0, _SPAN)])
    if not passage:
        return pd.DataFrame({"doc": sure["doc"], "text_hash": sure["text"], "begin": sure["begin"], "end": sure["end"]})
    passage, doc, text, start = map(np.concatenate, (passage, doc, text, start))
    contents = list(number)
    order = np.lexsort((passage, doc))
    passage, doc, text, start = passage[order], doc[order], text[order], start[order]
    # Of the same passage in the same document only the first is streamed.
    alone = np.flatnonzero(np.r_[True, (passage[1:] != passage[:-1]) | (doc[1:] != doc[:-1])])
    ends = np.r_[alone[1:], len(doc)]
    known: dict[bytes, int] = {}
    automaton, whole = SuffixAutomaton(), bytearray(len(contents))
    size = [p.count(b" ") + 1 for p in contents]
    at, begin, end = [], [], []
    waiting: list[tuple[int, list[int]]] = []
    now = None
    for row, stop, p, d in zip(alone.tolist(), ends.tolist(), passage[alone].tolist(), doc[alone].tolist()):
        if d != now:
            for q, sequence in waiting:
                automaton.add(sequence)
                whole[q] = 1
            waiting, now = [], d
        if whole[p]:
            spans = [(0, size[p])]
        else:
            sequence = [known.setdefault(w, len(known)) for w in contents[p].split(b" ")]
            spans = automaton.spans(sequence, window)
            # Where several matches cover a passage, the windows across their seams are new.
            if spans == [(0, size[p])] and automaton.holds(sequence):
                whole[p] = 1
            else:
                waiting.append((p, sequence))
        for a, b in spans:
            at.extend(range(row, stop))
            begin.extend([a] * (stop - row))
            end.extend([b] * (stop - row))
    at = np.array(at, dtype=np.int64)
    first = start[at].astype(np.int64)
    begin, end = (first + np.array(begin, dtype=np.int64)).astype(np.int32), (first + np.array(end, dtype=np.int64)).astype(np.int32)
    return pd.DataFrame({"doc": np.r_[doc[at], sure["doc"]], "text_hash": np.r_[text[at], sure["text"]], "begin": np.r_[begin, sure["begin"]], "end": np.r_[end, sure["end"]]})


#: A span that goes for sure.
_SPAN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("begin", "<i4"), ("end", "<i4")])


_DEALT = ["bucket", "passages", "at", "doc", "text", "start", "sure"]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc, text_hash, begin, end: spans of words (end excluded), which may overlap, that a window covers whose words also start in a smaller document.

    A null id counts as the greatest (``doc`` is then 2^63 - 1).
    """
    spark = docs.sparkSession
    common.ship(spark)
    width = min(ANCHOR, window)
    rows = common.text_id(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    buckets = common.n_buckets(spark, rows.count(), 500, 1024)
    shared = spark.sparkContext.broadcast(_filters(rows, buckets, window, width))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int]] = {}
        found: list[tuple] = []
        size = 0
        for batch in common.slices(batches):
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = _canonical(common.utf8(batch.column(2)).to_pylist())
            for a, b in common.text_blocks(texts):
                words = common.Words(texts[a:b])
                anchor, valid = _windows(words, window, width, shared.value)
                hit = valid & shared.value.has(shared.value.repeated, anchor)
                if not hit.any():
                    continue
                bucket, _ = shared.value.place(anchor)
                doc = words.doc[: len(anchor)]
                joined = hit[1:] & hit[:-1] & (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1])
                first = np.flatnonzero(hit & np.r_[True, ~joined])
                last = np.flatnonzero(hit & np.r_[~joined, True])
                own = doc[first]
                pieces = [words.data[x:y] for x, y in zip(words.start[first].tolist(), words.end[last + window - 1].tolist())]
                number = [held.setdefault(p, len(held)) for p in pieces]
                found.append((bucket[first], np.array(number, dtype=np.int64), ids[a:b][own], hashes[a:b][own], (first - words.first[own]).astype(np.int32), last - first + window))
                size += len(pieces)
                if size > 400_000:
                    yield from flush(held, found)
                    held, found, size = {}, [], 0
        yield from flush(held, found)

    def flush(held: dict, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        bucket, number, ids, hashes, start, size = (np.concatenate(x) for x in zip(*found))
        pieces = list(held)
        # A passage goes as a whole wherever it isn't in the least document that has it: only those of the least one here are matched, so a common passage is a row or two a flush.
        least = np.full(len(pieces), _NO_ID, dtype=np.int64)
        np.minimum.at(least, number, ids)
        later = ids > least[number]
        sure = np.zeros(int(later.sum()), dtype=_SPAN)
        sure["doc"], sure["text"], sure["begin"], sure["end"] = ids[later], hashes[later], start[later], start[later] + size[later]
        bucket, number, ids, hashes, start = bucket[~later], number[~later], ids[~later], hashes[~later], start[~later]
        parts = np.array_split(sure, -(-len(sure) // 20_000)) if len(sure) else []
        for k, part in enumerate(parts):
            yield pa.RecordBatch.from_arrays([pa.array([int(part["doc"][0] * 31 + k) % buckets], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(5)), pa.array([part.tobytes()], pa.binary())], names=_DEALT)
        order = np.lexsort((number, bucket))
        bucket, number, ids, hashes, start = bucket[order], number[order], ids[order], hashes[order], start[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
            own, at = np.unique(number[a:b], return_inverse=True)
            rows.append((int(bucket[a]), b"\n".join([pieces[i] for i in own.tolist()]), at.astype(np.uint32).tobytes(), ids[a:b].tobytes(), hashes[a:b].tobytes(), start[a:b].tobytes()))
        for i in range(0, len(rows), 256):
            part = list(zip(*rows[i : i + 256]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *(pa.array(c, pa.binary()) for c in part[1:]), pa.nulls(len(part[0]), pa.binary())], names=_DEALT)

    dealt = rows.mapInArrow(deal, "bucket int, passages binary, at binary, doc binary, text binary, start binary, sure binary")
    return dealt.groupBy("bucket").applyInPandas(lambda pdf: _match(pdf, window), "doc long, text_hash long, begin int, end int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of begin, end), text (the kept words joined by a space): one row a row of ``docs``.

    Words are split at ASCII white space; null and empty texts have none. Windows are judged on the input. Rows that share a doc_id are one document, in which repeats stay. A null
    doc_id counts as the greatest. An empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    spans = common.store(repeated_spans(docs, id_col, text_col, window), "spans")
    spans = spans.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    rows = common.text_id(docs, id_col, text_col).select("doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"))
    joined = rows.join(spans, ["doc", "text_hash"], "left").select("doc_id", "text", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"))
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            counts, removed, out, kept = [], [], [], []
            for text, begins, ends in zip(common.utf8(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split() if text else []
                merged: list[list[int]] = []
                for a, b in zip(begins or (), ends or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                counts.append(len(words))
                removed.append(sum(b - a for a, b in merged))
                out.append([{"begin": a, "end": b} for a, b in merged])
                for a, b in reversed(merged):
                    del words[a:b]
                kept.append(b" ".join(words).decode())
            spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, spans_type), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "text"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, text string")
