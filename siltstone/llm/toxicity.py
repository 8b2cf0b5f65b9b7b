"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - t_k): one weight for each feature over all thresholds t_0 < t_1 < ... Severity is the expected grade, the sum of these probabilities.
Features are sparse: a word that a text holds (1), and the beginnings of words, by their share of the text's words (1 from ``FULL_RATE`` on), which tell where insults are inflected or compounded.
Fitting reads a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a fit reads (as expected over the hash of their ids), features it keeps at most, and how sure a feature must be (in standard errors).
SAMPLE, FEATURES, SURE = 20_000, 512, 5.0
#: The share of toxic rows that must hold a feature.
LEAST_SHARE = 0.02
#: Lengths of the beginnings of words, the share of words at which one counts in full, and from which a fit counts it.
BEGINNINGS, FULL_RATE, LEAST_RATE = (4, 5, 6, 7), 0.01, 0.005


@dataclass(frozen=True)
class Ordinal:
    """Weights of words ("=word") and beginnings ("begin-"), and the thresholds."""

    weights: dict[str, float]
    thresholds: list[float]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, l1: float = 5e-5, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative logit with an L1 penalty, by accelerated proximal gradient steps.

    The thresholds are t_0 and t_0 plus positive steps (exponentials), so they stay in order.
    """
    # Equal rows are one row with their share as its weight.
    rows, counts = np.unique(np.c_[x, grade], axis=0, return_counts=True)
    x, grade, share = np.ascontiguousarray(rows[:, :-1]), rows[:, -1].astype(np.int64), counts / max(1, counts.sum())
    n, d = x.shape
    w, s = np.zeros(d), np.r_[1.0, np.zeros(grades - 2)]

    def thresholds(s: np.ndarray) -> np.ndarray:
        return s[0] + np.r_[0.0, np.cumsum(np.exp(s[1:]))]

    def gradient(w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = thresholds(s)
        z = x @ w
        above = np.c_[np.ones(n), _sigmoid(z[:, None] - t), np.zeros(n)]
        slope = above * (1 - above)
        p = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-12)
        low, high = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        dz = -(low - high) * share
        dt = np.array([((np.where(grade == k + 1, low, 0) - np.where(grade == k, high, 0)) * share).sum() for k in range(grades - 1)])
        ds = np.r_[dt.sum(), [np.exp(s[j]) * dt[j:].sum() for j in range(1, grades - 1)]]
        return x.T @ dz, ds

    step = 4.0 / max(1.0, np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2) if n and d else 1.0
    v, u, a = w.copy(), s.copy(), 1.0
    for _ in range(rounds):
        gw, gs = gradient(v, u)
        new = v - step * gw
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_s = u - min(step, 1.0) * gs
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        v, u, w, s, a = new + (a - 1) / b * (new - w), new_s + (a - 1) / b * (new_s - s), new, new_s, b
    return w, thresholds(s)


_WORD = re.compile(r"[^\W_]+")


def features(text: str | None, only: dict[str, float] | None = None) -> dict[str, float]:
    """A text's features and their values; with ``only``, those that it names."""
    words = _WORD.findall(text.lower()) if text else []
    counts = Counter(words)
    out = {f"={w}": 1.0 for w in counts if only is None or f"={w}" in only}
    lengths = [k for k in BEGINNINGS if only is None or any(len(f) == k + 1 and f[-1] == "-" for f in only)]
    hits: Counter[str] = Counter()
    for word, n in counts.items():
        for k in lengths:
            if len(word) >= k and (only is None or f"{word[:k]}-" in only):
                hits[f"{word[:k]}-"] += n
    out.update({f: min(1.0, n / len(words) / FULL_RATE) for f, n in hits.items()})
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    """Fit grades 0 (not toxic), 1 and 2 (toxic, telling more than the median of toxic rows) on about ``sample`` labelled rows at most.

    Features are kept that toxic rows hold more often than others by ``SURE`` standard errors. Rows with a null label, id or text are not read. Without labelled
    rows of both kinds every severity is about 0.
    """
    common.ship(docs.sparkSession)
    marked = common.numbered(labels).select(common.named(labels, id_col).cast("long").alias("doc_id"), common.named(labels, label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    share = min(1.0, sample / max(1, marked.count()))
    picked = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = common.join_sized(common.text_id(docs, id_col, text_col).filter("text is not null"), picked, "doc_id", "inner", 32)
    rows = common.store(rows.select("doc_id", (F.col("label") > 0).alias("toxic"), "text"), "labelled")
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(True, 0), total.get(False, 0)
    none = Ordinal({}, [40.0, 41.0])
    if not bad or not good:
        return none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2500):
            seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(f for f, x in features(text).items() if x * FULL_RATE >= LEAST_RATE)
            names = list(seen[True] | seen[False])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[t][f] for f in names], pa.int64()) for t in (True, False))], names=["feature", "a", "b"])

    counts = rows.select("toxic", "text").mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p, q = (F.col("a") + 0.5) / (bad + 1), (F.col("b") + 0.5) / (good + 1)
    pool = (F.col("a") + F.col("b") + 1) / (bad + good + 2)
    z = (p - q) / F.sqrt(pool * (1 - pool) * (1 / bad + 1 / good))
    top = counts.filter(F.col("a") >= max(4, LEAST_SHARE * bad)).select("feature", z.alias("z")).filter(F.col("z") > SURE).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    if not top:
        return none
    names = [r.feature for r in top]
    place, wanted = {f: i for i, f in enumerate(names)}, dict.fromkeys(names, 0.0)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            held = [features(t, wanted) for t in batch.column(2).to_pylist()]
            values = [pa.array([[place[f] for f in h] for h in held], pa.list_(pa.int32())), pa.array([list(h.values()) for h in held], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], names=["doc_id", "toxic", "at", "value"])

    seen = rows.mapInArrow(hold, "doc_id long, toxic boolean, at array<int>, value array<double>").collect()
    seen.sort(key=lambda r: (r.doc_id, r.toxic, r.at))
    x = np.zeros((len(seen), len(names)))
    for i, r in enumerate(seen):
        x[i, r.at] = r.value
    toxic = np.array([r.toxic for r in seen])
    telling = x @ np.array([r.z for r in top])
    held = telling[toxic & (telling > 0)]
    grade = np.where(toxic, 1 + (telling > (np.median(held) if len(held) else 0)), 0)
    weights, thresholds = fit_ordinal(x, grade, 3)
    return Ordinal({names[i]: float(weights[i]) for i in np.flatnonzero(weights)}, thresholds.tolist())


def severity(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """``docs`` with severity (0 to the highest grade), grade (the thresholds passed with probability over a half) and toxic (grade above 0), in place of columns of these names.

    A null or empty text has no feature and gets the severity of the thresholds alone.
    """
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("severity", "grade", "toxic")]
    at = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for batch in common.slices(batches):
            scores = np.array([sum(weights[f] * x for f, x in features(t, weights).items()) for t in batch.column(at).to_pylist()], dtype=np.float64)
            over = scores[:, None] - np.array(shared.value.thresholds)
            found = [pa.array(_sigmoid(over).sum(axis=1)), pa.array((over > 0).sum(axis=1), pa.int32()), pa.array(over[:, 0] > 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*(f.name for f in kept), "severity", "grade", "toxic"])

    from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

    schema = StructType([*kept, StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("toxic", BooleanType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, severity, grade, toxic: one row a row of ``docs``; repeated rows stay, an empty table gives an empty result, further columns are not read."""
    model = fit(docs, labels, id_col, text_col, **options)
    return severity(common.text_id(docs, id_col, text_col), model).select("doc_id", "severity", "grade", "toxic")


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns, which may have any names.

    Null and empty texts are not toxic; texts of any length are read whole; repeated rows stay or go together; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, **options)
    own = common.numbered(docs)
    plain = own.columns
    return severity(own.withColumn("text", common.named(docs, text_col).cast("string")), model).filter("not toxic").select(*plain).toDF(*docs.columns)
