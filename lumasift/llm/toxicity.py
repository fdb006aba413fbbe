"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed 3- to 5-grams (of UTF-8 bytes) that a text has at all,
after lower-casing and with each run of non-letters as one blank.  Counts by
class give each its log-count ratio r; the ``FEATURES`` grams that tell most
are kept, and a logistic regression is fitted on features of value r.  Rows are
weighted so that the sample stands for all labelled rows.

Learning takes at most ``SAMPLE`` labelled rows a class, the first by a hash of
the id: a stated bound.  Scoring is one narrow pass over all whole texts.

Defined results: null and empty texts have no features and score as the bias
says; a null id is never learned from and counts as not held out; without
labels of both classes the score is the smoothed share of label 1, never above
0.5 for no rows; rows that repeat are scored each; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumasift.llm.common import flat, fold_of, gram_hashes, held_out, letters_only, saved, table, windows

GRAMS, BITS = (3, 4, 5), 18
SAMPLE, FEATURES, MIN_DOCS, ALPHA = 4000, 3000, 4, 1.0
THRESHOLD = 0.7
_SAMPLE_PARTS = 16
_AT_ONCE = 256
_ROUNDS, _RIDGE = 150, 1.0


@dataclass
class Model:
    """``place``: of each hashed gram its feature's number, or -1; ``weights`` include r."""

    place: np.ndarray
    weights: np.ndarray
    bias: float


def present(column: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) pairs, each once."""
    data, starts = flat(letters_only(column), max(GRAMS) - 1)
    found = []
    n_features = int(place.max()) + 1 if len(place) else 0
    if n_features == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, j, lo, hi in windows(starts, 4096, 1 << 20):
        docs = None
        for n in GRAMS:
            feature = place[gram_hashes(data, lo, hi, n, BITS)]
            at = np.flatnonzero(feature >= 0)
            docs = np.searchsorted(starts[i : j + 1], at + lo, side="right") - 1 + i
            found.append(np.unique(docs * n_features + feature[at]))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // n_features, keys % n_features


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Scores of texts, ``_AT_ONCE`` at a time: what is made of them is several times as large."""
    z = np.full(len(column), model.bias)
    for lo in range(0, len(column), _AT_ONCE):
        part = column.slice(lo, _AT_ONCE)
        docs, features = present(part, model.place)
        z[lo : lo + len(part)] += np.bincount(docs, model.weights[features], minlength=len(part))
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_weights(docs: np.ndarray, features: np.ndarray, y: np.ndarray, row_weight: np.ndarray, r: np.ndarray, rounds: int = _ROUNDS, ridge: float = _RIDGE) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam steps on sparse rows whose values are r."""
    w = np.ones(len(r)) / max(1.0, len(features) / max(1, len(y)))
    b = 0.0
    m = np.zeros(len(r) + 1)
    v = np.zeros(len(r) + 1)
    total = row_weight.sum()
    for t in range(1, rounds + 1):
        z = b + np.bincount(docs, (w * r)[features], minlength=len(y))
        slope = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * row_weight / total
        g = np.append(np.bincount(features, slope[docs], minlength=len(r)) * r + ridge * w / total, slope.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = (0.05 if t <= rounds * 2 // 3 else 0.01) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w * r, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> Model:
    """Learn from rows of ``labels`` (doc_id, toxic) whose fold isn't 1."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & (fold_of(F.col("doc_id")) != 1))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("y") == y).orderBy(*order).limit(sample) for y in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])
    # at most 2 x ``sample`` pairs of an id and a label
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # of rows that repeat an id one is learned
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = saved(rows.select("y", "text").repartition(_SAMPLE_PARTS), "toxic-sample")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    everything = np.arange(1 << BITS, dtype=np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, 1 << BITS), np.uint32)
        n = np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(y), _AT_ONCE):
                d, f = present(batch.column(1).slice(lo, _AT_ONCE), everything)
                for cls in (0, 1):
                    df[cls] += np.bincount(f[y[lo : lo + _AT_ONCE][d] == cls], minlength=1 << BITS).astype(np.uint32)
            n += np.bincount(y, minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n, pa.int64()), pa.array([c.tobytes() for c in df], pa.binary())], names=["y", "n", "df"])

    # one pair of rows a part of the sample: 32 MB in all
    df, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in rows.mapInArrow(count, "y int, n long, df binary").collect():
        df[r["y"]] += np.frombuffer(r["df"], np.uint32)
        n[r["y"]] += r["n"]
    if n.min() == 0:
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), float(np.log(share / (1 - share))))

    p, q = ALPHA + df[1], ALPHA + df[0]
    r = np.log((p / p.sum()) / (q / q.sum()))
    expected = (df[0] + df[1]) * (n[1] / n.sum())
    tells = np.where(df.sum(0) >= MIN_DOCS, (df[1] - expected) ** 2 / np.maximum(expected, 1e-9), 0)
    best = np.sort(np.argsort(-tells, kind="stable")[:n_features])
    best = best[tells[best] > 0]
    place = np.full(1 << BITS, -1, np.int32)
    place[best] = np.arange(len(best), dtype=np.int32)
    r = r[best]

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, f = present(batch.column(1), place)
            cuts = np.searchsorted(d, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["y", "f"])

    found = [(row["y"], row["f"]) for row in rows.mapInArrow(sparse, "y int, f binary").collect()]
    found.sort()  # sums in one order give one model
    y = np.array([v for v, _ in found], np.float64)
    at = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) // 2 for _, f in found])
    grams = np.frombuffer(b"".join(f for _, f in found), np.uint16)
    del found
    stands_for = np.where(y == 1, totals.get(1, 1) / max(1.0, n[1]), totals.get(0, 1) / max(1.0, n[0]))
    weights, bias = fit_weights(at, grams, y, stands_for, r)
    return Model(place, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_texts(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(score_texts(batch.column(at), shared.value) < threshold)
            for lo in range(0, batch.num_rows, 1024):  # no second copy of the whole batch
                yield batch.slice(lo, 1024).filter(keep.slice(lo, 1024))

    return docs.mapInArrow(apply, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
