"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each codebook, found by beam search; codebooks start from k-means of residuals and are then fitted to the beam's codes by least squares, one after another. The
norm of each code's sum is stored beside it, so the squared distance to a query is |q|^2 - 2 (sum of the query's inner products with the codewords, from a lookup table) + norm. Every vector is coded, and scored
against every query in blocks. A query's best of each block by that score are ranked again by exact distance where the block is, and only the ``k`` nearest of them leave it. So candidates grow with the
table and recall doesn't fall as it grows; with blocks ranked whole (``rerank``) the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Codebooks, codewords in each, beam width, vectors that a fit reads, and candidates in each block of codes that are ranked exactly for each query.
BOOKS, WORDS, BEAM, SAMPLE, RERANK = 16, 256, 8, 20_000, 500
#: Vectors of a block, queries of a group, and queries whose lookup tables are held at once.
CODE_BLOCK, QUERY_BLOCK, TABLES = 8192, 2048, 128


def _sums(x: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the number of the rows of each word."""
    order = np.argsort(word, kind="stable")
    counts = np.bincount(word, minlength=words)
    held = np.flatnonzero(counts)
    total = np.zeros((words, x.shape[1]))
    total[held] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[held])
    return total, counts


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        total, counts = _sums(x, near, k)
        centres[counts > 0] = total[counts > 0] / counts[counts > 0, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The codes of vectors by beam search: after each codebook the ``beam`` sums nearest to the vector go on."""
    out = np.zeros((len(x), len(books)), dtype=np.uint8)
    norms = (books**2).sum(2)
    for a in range(0, len(x), 512):
        part = x[a : a + 512]
        n = len(part)
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        rest = part[:, None, :]
        error = np.zeros((n, 1))
        for m, book in enumerate(books):
            grown = error[:, :, None] + norms[m] - 2 * rest @ book.T
            flat = grown.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            error = np.take_along_axis(flat, best, 1)
            parent, word = best // len(book), best % len(book)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], axis=2)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
        out[a : a + 512] = codes[np.arange(n), np.argmin(error, axis=1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, dimensions) for the vectors of a sample."""
    rng = np.random.default_rng(seed)
    rest, made = x.copy(), []
    for _ in range(books):
        book = _kmeans(rest, words, rng)
        made.append(book)
        rest = rest - book[np.argmin((book**2).sum(1) - 2 * rest @ book.T, axis=1)]
    out = np.array(made)
    for _ in range(rounds):
        codes = encode(x, out)
        rest = x - decode(codes, out)
        for _ in range(3):
            for m in range(books):
                word = codes[:, m]
                rest += out[m][word]
                total, counts = _sums(rest, word, words)
                out[m][counts > 0] = total[counts > 0] / counts[counts > 0, None]
                rest -= out[m][word]
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part: vectors that are not null, empty or zero, of finite components."""
    v = common.named(vectors, vector_col).cast("array<double>")
    rows = common.numbered(vectors).select(common.named(vectors, id_col).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and vector is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("vector", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, every: int = 100, k: int = 10, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``, by Euclidean distance, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, and only vectors of a query's own length are near it. Of rows with the same id
    each is a candidate; all rows with the query's id are its own, and one of them (the least vector) asks. With fewer candidates than ``k`` all are returned; an empty table gives an
    empty result; further columns are not read. Codebooks are fitted on a sample of up to ``SAMPLE`` vectors; all vectors are coded. ``rerank`` is a number of candidates in each block.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = common.store(usable(vectors, id_col, vector_col), "vectors")
    found = None
    for (size,) in sorted(rows.select(F.size("vector")).distinct().collect()):
        part = _search(rows.filter(F.size("vector") == size), every, k, rerank)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _search(rows: DataFrame, every: int, k: int, rerank: int) -> DataFrame:
    spark, schema = rows.sparkSession, "query_id long, vec_id long, score double"
    n = rows.count()
    share = min(1.0, SAMPLE / n)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("vec_id", "vector").limit(2 * SAMPLE).select("vector").toPandas()
    if not len(sample):
        sample = rows.limit(WORDS).select("vector").toPandas()
    books = train(_matrix(sample.vector))
    shared = spark.sparkContext.broadcast(books)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = common.store(queries, "queries")

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), CODE_BLOCK):
                part = frame.iloc[a : a + CODE_BLOCK].sort_values("vec_id", kind="stable")
                x = _matrix(part.vector)
                codes = encode(x, shared.value)
                norms = (decode(codes, shared.value) ** 2).sum(1)
                yield pd.DataFrame({"ids": [part.vec_id.to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "norms": [norms.tobytes()], "vectors": [_packed(x)]})

    coded = common.store(rows.mapInPandas(code, "ids binary, codes binary, norms binary, vectors binary"), "codes")
    # The stated queries meet all vectors in blocks: each block of codes goes with every group of queries.
    groups = max(1, -(-queries.count() // QUERY_BLOCK))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("vec_id")
        return pd.DataFrame({"group": [int(own.group.iloc[0])], "names": [own.vec_id.to_numpy(np.int64).tobytes()], "asked": [_matrix(own.vector).tobytes()]})

    dealt = queries.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    asked = common.store(dealt.groupBy("group").applyInPandas(gather, "group int, names binary, asked binary"), "asked")
    near = _met(coded, asked, groups, 2 * QUERY_BLOCK * (books.shape[2] + 1) * 8).mapInArrow(_scorer(shared, k, rerank), schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _packed(x: np.ndarray) -> bytes:
    """A matrix as bytes, in single precision where that holds its values exactly."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return (single if np.array_equal(single, x) else x).tobytes()


def _met(coded: DataFrame, asked: DataFrame, groups: int, group_bytes: int) -> DataFrame:
    """Each block of codes beside each group of queries. Groups of a counted size are broadcast; more of them are sent to parts of the blocks, so that a block is shuffled only once."""
    if groups * group_bytes <= common.BROADCAST_BYTES:
        met = coded.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(F.broadcast(asked), "group")
    else:
        parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = coded.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
        met = dealt.join(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "part")
    return met.select("ids", "codes", "norms", "vectors", "names", "asked")


def _scorer(books, k: int, rerank: int):
    """For each block of codes and group of queries, the ``k`` nearest to each query, by exact distance, of the block's ``rerank`` candidates of the best table score."""

    def nearest(q: np.ndarray, name: int, table: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        approx = norms.copy()
        for book, products in enumerate(table):
            approx -= 2 * products[codes[book]]
        approx[(ids == name) | np.isnan(approx)] = np.inf
        best = np.arange(len(approx))
        if len(approx) > rerank:
            bound = np.partition(approx, rerank - 1)[rerank - 1]
            under, ties = np.flatnonzero(approx < bound), np.flatnonzero(approx == bound)
            best = np.r_[under, ties[: rerank - len(under)]]
        best = best[ids[best] != name]
        # One component after another, as a sum in order gives it.
        score = np.sqrt(np.add.accumulate((x[best].astype(np.float64) - q) ** 2, axis=1)[:, -1])
        first = np.lexsort((ids[best], score))[:k]
        return ids[best][first], score[first]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = books.value
        for batch in common.slices(batches, 1):
            ids, codes, norms, vectors, names, asked = (batch.column(i)[0].as_py() for i in range(6))
            i, m, names = np.frombuffer(ids, np.int64), np.frombuffer(norms, np.float64), np.frombuffer(names, np.int64)
            c = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(len(i), -1).T)
            asked = np.frombuffer(asked, np.float64).reshape(len(names), -1)
            x = np.frombuffer(vectors, np.float64 if len(vectors) == 8 * len(i) * asked.shape[1] else np.float32).reshape(len(i), -1)
            for a in range(0, len(names), TABLES):
                part = asked[a : a + TABLES]
                lookup = np.einsum("qd,mwd->qmw", part, tables, optimize=True)
                found = [nearest(q, name, table, i, c, m, x) for q, name, table in zip(part, names[a : a + TABLES].tolist(), lookup)]
                columns = np.repeat(names[a : a + TABLES], [len(v) for v, _ in found]), np.concatenate([v for v, _ in found]), np.concatenate([s for _, s in found])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["query_id", "vec_id", "score"])

    return score
