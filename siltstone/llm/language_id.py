"""Language identification by hyperdimensional profiles.

Letters (and the gap between words) have random vectors of +1 and -1. A trigram's vector binds them by multiplication after permuting by place, a text bundles
the vectors of its trigrams by addition, a language's prototype bundles the unit vectors of its texts. A text gets the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS, SYMBOLS, SEED = 512, 64, 11
#: Texts that a fit reads, and those of each language that it reads where there are so many, as expected over the hash of their ids.
SAMPLE, LEAST = 20_000, 1_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray


@cache
def _symbols() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter, 1 to 26 for a to z, the rest by code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = 27 + c % (SYMBOLS - 27)
    for c in range(26):
        out[97 + c] = out[65 + c] = 1 + c
    return out


@cache
def _vectors() -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all pairs of symbols in the first two places, and of symbols in the third."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.float32), (SYMBOLS, DIMENSIONS))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (first[:, None, :] * second[None, :, :]).reshape(-1, DIMENSIONS), letters


def bundle(text: str | None) -> np.ndarray | None:
    """A text's vector, or None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = _symbols()[points]
    if not s.any():
        return None
    s = np.r_[np.uint8(0), s, np.uint8(0)]
    s = s[np.r_[True, (s[1:] > 0) | (s[:-1] > 0)]].astype(np.int64)
    grams, n = np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)
    pairs, letters = _vectors()
    out = np.zeros(DIMENSIONS, dtype=np.float64)
    for i in range(0, len(grams), 4096):
        part = grams[i : i + 4096]
        out += n[i : i + 4096].astype(np.float32) @ (pairs[part // SYMBOLS] * letters[part % SYMBOLS])
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Profiles:
    """Prototypes from about ``sample`` rows with text and language at most, and about ``LEAST`` of each language if that is more; prototypes are sums of whole numbers, so they don't depend on the order of rows.

    Rows with a null language are not read, texts that are null or have no letter tell nothing, repeated rows are in the sample together; without rows no language is learned. Further columns are not read.
    """
    common.ship(docs.sparkSession)
    rows = common.numbered(docs).select(common.named(docs, id_col).alias("doc_id"), common.named(docs, lang_col).cast("string").alias("lang"), common.named(docs, text_col).cast("string").alias("text")).filter("lang is not null")
    # The share of each language's rows: so that the sample is of the size given, but of rare languages more.
    total = max(1, rows.select("lang").count())
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.greatest(F.lit(sample / total), F.lit(float(LEAST)) / F.count("*"))).alias("share"))
    picked = common.join_sized(rows, shares, "lang", "inner")
    rows = picked.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < (F.col("share") * (1 << 20)).cast("long")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = bundle(text)
                if v is not None and (size := np.linalg.norm(v)) > 0:
                    sums.setdefault(lang, np.zeros(DIMENSIONS, dtype=np.int64))
                    sums[lang] += np.rint(v * (1 << 20) / size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "total"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in pdf.total)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "total": [total.tobytes()]})

    found = rows.mapInArrow(run, "lang string, total binary").groupBy("lang").applyInPandas(add, "lang string, total binary").orderBy("lang").collect()
    vectors = np.array([np.frombuffer(r.total, dtype=np.int64) for r in found], dtype=np.float64).reshape(-1, DIMENSIONS)
    return Profiles([r.lang for r in found], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12))


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 if negative): one row a row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned. Ties go to the language first in order. Repeated rows stay; an
    empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in common.slices(batches):
            names, scores = [], []
            for text in batch.column(1).to_pylist():
                v = bundle(text) if known.languages else None
                if v is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                near = known.prototypes @ (v / max(np.linalg.norm(v), 1e-12))
                best = int(np.argmax(near))
                names.append(known.languages[best])
                scores.append(float(min(1.0, max(0.0, near[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return common.text_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
