"""Helpers shared by the training-text operators: shared scratch tables, sized joins, packed rows."""

from __future__ import annotations

import atexit
import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import as_uri, shared_dir, ship

__all__ = ["as_uri", "shared_dir", "ship"]

#: The contract's white space: space and the ASCII controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Largest side, in estimated bytes, that ``join_sized`` broadcasts.
BROADCAST_BYTES = 48 << 20

#: The C library, where it can give memory back.
_libc = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None


#: Scratch tables of this process, which go when it ends.
_scratch: dict[str, None] = {}


def store(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; this cuts the lineage. The table goes when the driver ends."""
    return store_at(df, label, **options)[0]


def store_at(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """As ``store``, with the table's place, for ``remove``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_remove_all)
    _scratch[path] = None
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    _scratch.pop(path, None)
    fs, place = pafs.FileSystem.from_uri(as_uri(path))
    if fs.get_file_info(place).type != pafs.FileType.NotFound:
        fs.delete_dir(place)


def _remove_all() -> None:
    for path in list(_scratch):
        remove(path)


def join_sized(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int = 64) -> DataFrame:
    """Join, broadcasting ``small`` only if its counted rows at ``row_bytes`` each fit the bound; else Spark shuffles both."""
    if small.count() * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def n_buckets(spark: SparkSession, rows: int, per_bucket: int, least: int = 256) -> int:
    """Buckets for a packed exchange, in proportion to the rows so that each stays within a task's memory."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(max(least, 2 * width, -(-rows // per_bucket)))


def utf8(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as bytes, without a copy; nulls stay."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.binary()) if pa.types.is_string(array.type) else array.cast(pa.large_binary())


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut into few rows, so that little of them is held as Python objects at once; at the end freed memory goes back to the system."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        if _libc is not None:
            _libc.malloc_trim(0)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ..., so that none can clash with an operator's own, whatever it is called."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def named(docs: DataFrame, name: str) -> Column:
    """The column of ``numbered(docs)`` that ``docs`` calls ``name``."""
    return F.col(f"c{docs.columns.index(name)}")


def text_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names that no other column can clash with."""
    return numbered(docs).select(named(docs, id_col).cast("long").alias("doc_id"), named(docs, text_col).cast("string").alias("text"))


def node(doc_id: Column | str, text: Column | str) -> Column:
    """A 64-bit hash of a row's id and text: equal for equal rows, and never null."""
    return F.xxhash64(doc_id, text)


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows dealt to buckets, as one row a bucket whose columns hold the bytes of its values."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    ends = np.r_[starts[1:], len(sorted_)]
    moved = {k: v[order] for k, v in columns.items()}
    yield pa.RecordBatch.from_arrays(
        [pa.array(sorted_[starts].astype(np.int32))] + [pa.array([v[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for v in moved.values()],
        names=["bucket", *moved],
    )


def unpack(column, dtype) -> np.ndarray:
    """All values of a packed column of one group."""
    return np.frombuffer(b"".join(column), dtype=dtype)


def salt(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


# --- words in a buffer -------------------------------------------------------------------------------------------

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MULT = 0x9E3779B97F4A7C15


_known: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    if len(_known.get(base, ())) >= n:
        return _known[base][:n]
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
    if n <= 4 << 20:
        _known[base] = out
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiplicative hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


class Words:
    """The words of several texts: start and end in one buffer, the text each belongs to, and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, dtype=np.uint8)
        space = _IS_SPACE[raw]
        edge = np.diff(np.r_[True, space].astype(np.int8))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        ends_at = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        self.doc = np.searchsorted(ends_at, self.start, side="right")
        self.first = np.searchsorted(self.start, np.r_[0, ends_at[:-1]] if len(ends_at) else [])
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), _BASE), out=total[1:])
            inverse = _powers(len(raw) + 1, _INVERSE)
            self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64) * np.uint64(_MULT))

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)[:n]

    def runs(self, k: int) -> np.ndarray:
        """A hash of the k words that begin at each word; those near the end of the buffer are left out."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * np.uint64(_MULT) + self.hash[j : j + n]
        return mix(out)


def text_blocks(values: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of texts of about ``most`` bytes each; one longer text stands alone."""
    begin, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > most:
            yield begin, i
            begin, size = i, 0
        size += len(v)
    if begin < len(values):
        yield begin, len(values)
