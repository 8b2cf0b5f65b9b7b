"""Token ids in binary files of directly addressable codes.

A file holds documents in ascending doc_id order. Ids are cut into 8-bit chunks: level 0 has the lowest chunk of every id,
each further level the next chunk of those ids that have one. A bitmap beside each level marks the ids that go on, and a rank
directory (the marks before every 512th bit) gives an id's place on the next level, so any id is read from a few bytes.

Layout, little-endian: magic, then eight-byte integers: documents, ids, levels; doc_ids (int64), a byte each for null doc_ids, ends (uint64, the ids up to each document's end);
for each level its length (uint64), its chunks (bytes), its bitmap and its directory (uint64).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, units

MAGIC = b"SILTDAC1"
RANK_BITS = 512
#: Ids in a file at most, but for the last document's, and characters encoded at once.
FILE_IDS, BLOCK = 2 << 20, 4 << 20


# --- encoding ----------------------------------------------------------------------------------------------------

# Classes of bytes. Letters are those of ASCII and the bytes of U+00C0 to U+027F; other leading bytes are odd.
_SPACE, _LETTER, _DIGIT, _SIGN, _BLANK, _ODD, _EDGE = range(7)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_CLASS[48:58], _CLASS[9:14], _CLASS[32], _CLASS[units.EDGE] = _DIGIT, _BLANK, _SPACE, _EDGE
_CLASS[[*range(0xC0, 0xC3), *range(0xCA, 0xFF)]] = _ODD
# White space beyond ASCII; a text that has any is encoded whole.
_WIDE_BLANKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_level_starts(data: bytes) -> np.ndarray:
    """Where the words of the byte-level pattern begin, in texts that ``units.joined`` made.

    The pattern: an apostrophe with s, t, m, d, re, ve or ll; letters, digits or signs, each with a space ahead of them; white space but for its last character; white space. What stands between two
    spaces and has an odd character is left in one, for the library to cut.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = _CLASS[raw]
    n = len(raw)
    after = np.append(raw[1:], units.EDGE)
    kind[(raw == 0xC3) & ((after == 0x97) | (after == 0xB7))] = _ODD  # the signs for times and divided by
    before, follows = np.append(_EDGE, kind[:-1]).astype(np.uint8), np.append(kind[1:], _EDGE).astype(np.uint8)
    white = (kind == _SPACE) | (kind == _BLANK)
    white_before, white_after = (before == _SPACE) | (before == _BLANK), (follows == _SPACE) | (follows == _BLANK)
    start = kind != before
    # Of white space its first and its last character begin a word, the last one not at a text's end; a last space goes with what follows.
    start[white] = ~white_before[white] | (~white_after & (follows != _EDGE))[white]
    start &= white | (before != _SPACE)
    start |= kind == _EDGE
    # Contractions: an apostrophe alone between what is no space and a letter.
    for at in np.flatnonzero((raw == 39) & (before != _SIGN) & (before != _SPACE) & (follows == _LETTER)).tolist():
        size = 2 if data[at + 1 : at + 2] in (b"s", b"t", b"m", b"d") else 3 if data[at + 1 : at + 3] in (b"re", b"ve", b"ll") else 0
        if size:
            start[at + 1] = False
            if kind[at + size] == _LETTER:
                start[at + size] = True
    odd = np.cumsum(kind == _ODD)
    if odd[-1]:
        cut = np.flatnonzero(((kind == _SPACE) & ~white_before & ~white_after & (before != _EDGE) & (follows != _EDGE)) | (before == _EDGE) | (kind == _EDGE))
        held = np.diff(np.append(np.append(0, odd)[cut], odd[-1])) > 0
        inside = np.repeat(held, np.diff(np.append(cut, n)))
        start[inside] = False
        start[cut] = True
    return np.flatnonzero(start)


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level BPE writes for each byte: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Encoder:
    """A tokenizer; for one of the byte-level kind with the pool of the words that it has seen."""

    def __init__(self, spec: str, end_id: int | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.made, self.end = Tokenizer.from_str(spec), [] if end_id is None else [end_id]
        self.added = [t.content for t in self.made.get_added_tokens_decoder().values()]
        shape = self.made.pre_tokenizer
        self.plain = isinstance(shape, pre_tokenizers.ByteLevel) and self.made.normalizer is None and not shape.add_prefix_space and shape.use_regex
        if self.plain:
            self.bare = Tokenizer(self.made.model)
            self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            # 0xFE is no byte of UTF-8: it parts the words of a line.
            self.signs = _byte_signs() | {0xFE: " "}
            self.length = np.zeros(self.made.get_vocab_size(), dtype=np.int64)
            for token, i in self.made.get_vocab().items():
                self.length[i] = len(token)
            self.pool = units.UnitPool(self._words, self.end)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.made.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of the pattern, a thousand at once, and of stretches with odd characters, as the library cuts them."""
        rare = [bool(_CLASS[list(w)].max() == _ODD or b"\xc3\x97" in w or b"\xc3\xb7" in w) if max(w) > 127 else False for w in words]
        others = iter(self.whole([w.decode() for w, odd in zip(words, rare) if odd]))
        common_ = [w for w, odd in zip(words, rare) if not odd]
        found, sizes = [], np.zeros(len(words), dtype=np.int64)
        for i in range(0, len(common_), 1000):
            part = common_[i : i + 1000]
            line = b"\xfe".join(part).decode("latin-1").translate(self.signs)
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))) + 1
            found.append((ids, np.diff(ends, prepend=0)))
        if not any(rare):
            return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])
        plain = iter([y for ids, n in found for y in np.split(ids, np.cumsum(n)[:-1])])
        each = [next(others) if odd else next(plain) for odd in rare]
        sizes[:] = [len(x) for x in each]
        return np.concatenate(each), sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        whole = [bool(t) and (not self.plain or any(a in t for a in self.added) or (not t.isascii() and _WIDE_BLANKS.search(t) is not None)) for t in texts]
        others = iter(self.whole([t for t, w in zip(texts, whole) if w]))
        cut = [t.encode() if t else b"" for t, w in zip(texts, whole) if not w]
        ours = iter(())
        if cut:
            if not self.plain:
                ours = iter([np.array(self.end, dtype=np.uint32)] * len(cut))
            else:
                data = units.joined(cut)
                starts = byte_level_starts(data)
                ids, sizes = self.pool.ids(data, starts)
                at = units.by_text(data, starts, sizes).tolist()
                ours = (ids[a:b] for a, b in zip(at, at[1:]))
        return [np.append(next(others), self.end).astype(np.uint32) if w else next(ours) for w in whole]


_encoders: dict[tuple[str, int | None], _Encoder] = {}


def encode_texts(texts: list[str | None], spec: str, end_id: int | None = 0) -> list[np.ndarray]:
    """The ids of each text, as the tokenizer of the JSON text ``spec`` gives them without special tokens of its own (a text's own ``added tokens`` have their ids), with ``end_id`` behind them; null is empty.

    Byte-level BPE never merges across the words of its pattern, so each different word is encoded once. Texts with an added token or white space beyond ASCII, and all texts of other
    tokenizers, are encoded whole.
    """
    coder = _encoders.get((spec, end_id)) or _encoders.setdefault((spec, end_id), _Encoder(spec, end_id))
    return coder.encode(texts)


# --- the file format ---------------------------------------------------------------------------------------------


def pack_ids(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file's bytes."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64) if ids else np.zeros(0, np.uint64)
    rest = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    levels = []
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        rest = rest[more] >> 8
        if not len(rest):
            break
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    out = [MAGIC, np.array([len(doc_ids), int(ends[-1]) if len(ends) else 0, len(levels)], dtype="<u8").tobytes()]
    out += [np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), null.tobytes(), ends.astype("<u8").tobytes()]
    for chunks, more in levels:
        marks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        out += [np.uint64(len(chunks)).astype("<u8").tobytes(), chunks.tobytes(), np.packbits(more, bitorder="little").tobytes()]
        out.append((np.cumsum(marks) - marks).astype("<u8").tobytes())
    return b"".join(out)


class IdFile:
    """A file of ids read in place: ``source`` is a random-access file (``read_at(size, offset)``)."""

    def __init__(self, source):
        self.source, at = source, len(MAGIC)
        if source.read_at(at, 0) != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_docs, self.n_ids, levels = (int(x) for x in np.frombuffer(source.read_at(24, at), "<u8"))
        at += 24
        self.doc_ids = np.frombuffer(source.read_at(8 * self.n_docs, at), "<i8")
        self.null = np.frombuffer(source.read_at(self.n_docs, at + 8 * self.n_docs), np.uint8) > 0
        self.ends = np.frombuffer(source.read_at(8 * self.n_docs, at + 9 * self.n_docs), "<u8").astype(np.int64)
        at += 17 * self.n_docs
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(source.read_at(8, at), "<u8")[0])
            bits = at + 8 + n
            ranks = bits + -(-n // 8)
            self.levels.append((n, at + 8, bits, ranks))
            at = ranks + 8 * -(-n // RANK_BITS)

    def _rank(self, level: int, i: int) -> int:
        """The marks before bit ``i``."""
        n, _, bits, ranks = self.levels[level]
        block = min(i, max(n - 1, 0)) // RANK_BITS
        before = int(np.frombuffer(self.source.read_at(8, ranks + 8 * block), "<u8")[0]) if n else 0
        first = block * RANK_BITS
        marks = np.frombuffer(self.source.read_at(-(-(i - first) // 8), bits + first // 8), np.uint8)
        return before + int(np.unpackbits(marks, bitorder="little")[: i - first].sum())

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to before ``end``; only the bytes that hold them are read."""
        out = np.zeros(max(0, end - begin), dtype=np.uint32)
        where = np.arange(len(out))
        for k, (n, chunks, bits, _) in enumerate(self.levels):
            if begin >= end:
                break
            out[where] |= np.frombuffer(self.source.read_at(end - begin, chunks + begin), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            low = begin // 8
            marks = np.unpackbits(np.frombuffer(self.source.read_at(-(-end // 8) - low, bits + low), np.uint8), bitorder="little")
            where = where[marks[begin - 8 * low : end - 8 * low] > 0]
            begin = self._rank(k, begin)
            end = begin + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class _Bytes:
    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, size: int, offset: int) -> bytes:
        return self.data[offset : offset + size]


def open_ids(data: bytes) -> IdFile:
    return IdFile(_Bytes(data))


# --- tables ------------------------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """Write every text's ids under ``path`` (a URI that all executors reach) and return the manifest: part, seq, path, n_docs, n_ids.

    Parts follow ascending doc_id (null first), with ties by the text's hash. A task that runs again replaces its own files. Null and empty texts
    have only the end id; an empty table writes no file; further columns are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    rows = common.text_id(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 20_000)
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        fs.create_dir(base, recursive=True)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        done: list[tuple] = []

        def flush() -> None:
            final = f"{base}/part-{part:06d}-{len(done):05d}.dac"
            with fs.open_output_stream(temp := f"{base}/.{part}-{len(done)}-{attempt}.tmp") as out:
                out.write(pack_ids(doc_ids, ids))
            fs.move(temp, final)
            done.append((part, len(done), final, len(doc_ids), sum(map(len, ids))))
            doc_ids.clear()
            ids.clear()

        held = 0
        for batch in common.slices(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in common.text_blocks([t or "" for t in texts], BLOCK):
                for key, found in zip(keys[a:b], encode_texts(texts[a:b], spec.value, end_id)):
                    doc_ids.append(key)
                    ids.append(found)
                    held += len(found)
                    if held >= FILE_IDS:
                        flush()
                        held = 0
        if doc_ids:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), _TYPES)] if done else [pa.array([], t) for t in _TYPES], names=_NAMES)

    return common.store(ordered.mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long"), "manifest")


_NAMES = ["part", "seq", "path", "n_docs", "n_ids"]
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]


def read_ids(manifest: DataFrame, path: str, values: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with ``values`` the ids, from the files of a manifest.

    One row a row written, null ids and repeated rows included; a manifest without files gives an empty result.
    """
    common.ship(manifest.sparkSession)
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("begin", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long"))
    files = placed.select("path", "begin").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for frame in frames:
            for name, begin in zip(frame.path, frame.begin):
                with fs.open_input_file(name) as source:
                    file = IdFile(source)
                    ids = file.ids(0, file.n_ids).astype("<u4")
                ends = file.ends
                starts = np.r_[0, ends[:-1]].astype(np.int64)
                out = pd.DataFrame({"doc_id": pd.array(file.doc_ids, dtype="Int64"), "start": starts + begin, "n_tokens": ends - starts})
                out.loc[file.null, "doc_id"] = pd.NA
                out["ids_crc32"] = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                if values:
                    out["ids"] = [ids[a:b].astype(np.int64) for a, b in zip(starts.tolist(), ends.tolist())]
                yield out

    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if values else ""))


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the ids of ``docs`` and read them back; see ``write_ids`` and ``read_ids``."""
    import uuid

    path = common.as_uri(path or f"{common.shared_dir(docs.sparkSession)}/siltstone/ids-{uuid.uuid4().hex}")
    return read_ids(write_ids(docs, path, tokenizer, **options), path)
