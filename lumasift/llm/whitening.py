"""Embedding whitening: a randomised range finder over all rows, Rayleigh-Ritz for the components.

Vectors become whole numbers, x = floor(scale * c).  The fit list holds each
distinct x once; n is its length and S its sums by dimension, both exact.  The
covariance V = sum (x - S/n)(x - S/n)' / n is never formed at first: a pass over
the fit list multiplies it by a narrow basis Q, each task adding its own rows up
before anything is shuffled.  Q starts as random directions, more than wanted
(oversampling); every pass gives W = V Q, whose Rayleigh-Ritz vectors are tried:
if ``|V u - e u|`` is within ``TOLERANCE`` of the largest eigenvalue for all that
are wanted, they are the components, else Q becomes an orthonormal basis of W
(power pass).  If the residuals fail after ``PASSES`` passes, Q is expanded to
full dimension, in column blocks of at most ``BLOCK`` numbers, a pass each: V's
eigenvectors are then exact but for rounding.

The driver holds Q and W: vectors' dimension squared at most, whatever the
number of rows.  Passes over written tables depend on nothing that an executor
keeps.

Defined results: rows whose vector is null, or holds a null or a value that is
not finite, are dropped, and so are empty vectors and those of another length
than the commonest (of equally common the longest); ids play no part, rows that
repeat are rows of their own, but one in the fit list; there are as many
components as dimensions if these are fewer than wanted; a component without
variance (eigenvalue below 1e-12 of the largest, or none at all) explains what
it does and has null as whitened value; entries beyond the range of long count as its
end; a deviation beyond the range of decimal(38) is null, and in the query beyond
that of long; columns besides id and vector play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumasift.llm.common import saved, table

#: Whole numbers a unit, components wanted, random directions beyond them, passes before the expansion.
SCALE, COMPONENTS, OVERSAMPLE, PASSES = 256, 4, 8, 6
#: Residual over the largest eigenvalue up to which a component is taken.
TOLERANCE = 1e-13
#: Numbers of a basis that one pass takes to the tasks.
BLOCK = 1 << 19
_SEED = 20240917
_LONG = 1 << 63


def quantised(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, x) of the rows that take part."""
    entries = F.col(vector).cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(entries) > 0)
    # floor() of a double beyond the range of long ends at the range
    found = rows.select(F.col(key).alias("key"), F.when(sound, F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))).alias("x"))
    return found.filter(F.col("x").isNotNull())


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact(x: np.ndarray) -> np.ndarray:
    return np.array(x.tolist(), dtype=object).reshape(x.shape)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """n, S and the largest absolute entry, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, [0] * d, 0
        for batch in batches:
            x = _matrix(batch, d)
            if len(x):
                own = max(abs(int(x.max())), abs(int(x.min())))
                part = x.sum(axis=0) if own * len(x) < _LONG else _exact(x).sum(axis=0)
                n, total, most = n + len(x), [a + int(b) for a, b in zip(total, part)], max(most, own)
        if n:
            # digits, as totals may need more than 64 bits
            yield pa.RecordBatch.from_pydict({"i": list(range(d)), "n": [n] * d, "s": [str(t) for t in total], "most": [str(most)] * d})

    parts = fit.select("x").mapInArrow(add, "i long, n long, s string, most string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max(F.col("most").cast("decimal(38,0)")).alias("most")).collect()
    if not rows:
        return 0, [0] * d, 0
    return rows[0]["n"], [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])], int(max(r["most"] for r in rows))


def _summed(fit: DataFrame, d: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of(x)`` (rows of ``width`` numbers) over all batches: each task's own first, then by row in Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": list(range(len(total))), "w": pa.array(list(total), pa.list_(pa.float64()))})

    parts = fit.select("x").mapInArrow(add, "i long, w array<double>")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("w")[j]).alias(f"w{j}") for j in range(width)]).collect()
    return np.array([list(r)[1:] for r in sorted(rows, key=lambda r: r["i"])], dtype=np.float64).reshape(-1, width)


def _covered(fit: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """V q: one pass over the fit list for every block of columns."""
    d, wide = q.shape[0], max(1, BLOCK // q.shape[0])
    blocks = []
    for at in range(0, q.shape[1], wide):
        part = np.ascontiguousarray(q[:, at : at + wide])

        def of(x: np.ndarray, part=part) -> np.ndarray:
            centred = x.astype(np.float64) - mean
            return centred.T @ (centred @ part)

        blocks.append(_summed(fit, d, part.shape[1], of))
    return np.hstack(blocks) / n


def _ritz(q: np.ndarray, w: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, vectors (columns) and residuals of the ``wanted`` largest in the span of q, with w = V q."""
    inner = q.T @ w
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    turn = turn[:, ::-1][:, :wanted]
    values = values[::-1][:wanted]
    vectors = q @ turn
    return values, vectors, np.linalg.norm(w @ turn - vectors * values, axis=0)


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    #: Largest absolute entry of the fit list.
    most: int
    #: Components as columns, with their eigenvalues, largest first.
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    #: Whether the basis was expanded to full dimension.
    expanded: bool
    identity_error: float | None

    @property
    def dimension(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """Root of each eigenvalue; nan without variance."""
        sound = self.eigenvalues > max(0.0, 1e-12 * max(self.eigenvalues, default=0.0))
        return np.sqrt(np.where(sound, self.eigenvalues, np.nan))


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """Distinct x of the commonest length, and that length (0 without rows)."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows"))
    d = lengths.orderBy(F.desc("rows"), F.desc("d")).first()
    d = d["d"] if d else 0
    return saved(rows.filter(F.size("x") == d).select("x").distinct(), "whiten-fit"), d


def learn(rows: DataFrame, wanted: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = _SEED) -> Whitening | None:
    """The whitening of ``rows`` (x); None without rows."""
    fit, d = fit_list(rows)
    if not d:
        return None
    n, sums, most = _sums(fit, d)
    mean, wanted = np.array([s / n for s in sums]), min(wanted, d)
    trace = float(_summed(fit, d, 1, lambda x: np.square(x.astype(np.float64) - mean).sum(keepdims=True).reshape(1, 1))[0, 0]) / n
    rng = np.random.default_rng(seed)
    width = min(d, wanted + oversample)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    done = 0
    while True:
        w = _covered(fit, mean, n, q)
        done += 1
        values, vectors, residuals = _ritz(q, w, wanted)
        if width == d or (residuals <= tolerance * max(values[0], 0.0)).all():
            break
        if done <= passes:
            q = np.linalg.qr(w)[0]
        else:
            # the found directions lead a basis of the whole space
            width = d
            q = np.linalg.qr(np.hstack([vectors, rng.standard_normal((d, d - wanted))]))[0]
    values = np.maximum(values, 0.0)
    found = Whitening(n, sums, most, vectors, values, trace, done, width == d, None)
    scales, own = found.scales, ~np.isnan(found.scales)
    error = None
    if own.any():
        turned = vectors[:, own] / scales[own]

        def square(x: np.ndarray) -> np.ndarray:
            z = (x.astype(np.float64) - mean) @ turned
            return np.vstack([z.T @ z, z.sum(axis=0)])

        total = _summed(fit, d, int(own.sum()), square) / n
        covariance = total[:-1] - np.outer(total[-1], total[-1])
        error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return Whitening(n, sums, most, vectors, values, trace, done, width == d, error)


def apply(rows: DataFrame, found: Whitening) -> DataFrame:
    """key, deviation (decimal) and whitened (array) of ``rows`` (key, x) of the whitening's dimension."""
    n, d, mean = found.n, found.dimension, found.mean
    sums = np.array(found.sums, dtype=object)
    turned = found.components / found.scales
    # |n x - S| is at most twice n times the largest entry, and rows need not be in the fit list's range if others are given
    kind = rows.schema["key"].dataType

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            if not len(x):
                continue
            widest = 2 * n * max(abs(int(x.max())), abs(int(x.min())), found.most)
            if widest * widest * d < _LONG:
                off = x * np.int64(n) - sums.astype(np.int64)
                deviation = np.einsum("ij,ij->i", off, off).tolist()
            else:
                deviation = [sum(v * v for v in row) for row in _exact(x) * n - sums]
            z = (x.astype(np.float64) - mean) @ turned
            key = batch.column(batch.schema.get_field_index("key"))
            z = pa.array([[None if np.isnan(v) else v for v in row] for row in z.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([key, pa.array([str(v) for v in deviation]), z], names=["key", "deviation", "whitened"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.filter(F.size("x") == d).mapInArrow(turn, schema).withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", **options) -> tuple[DataFrame, Whitening | None]:
    """(key, deviation, whitened) of all rows that take part, and what was learned from them."""
    rows = saved(quantised(embeddings, key, vector), "whiten-rows")
    found = learn(rows, **options)
    if found is None:
        return rows.select(F.col("key").alias(key), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    return apply(rows, found).withColumnRenamed("key", key), found


def query(spark, sf_dir: str) -> DataFrame:
    rows, found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    trace = found.trace if found else 0.0
    explained = F.array(*[F.lit(float(e / trace) if trace > 0 else 0.0) for e in (found.eigenvalues if found else ())]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(found.n if found else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(found.identity_error if found else None).cast("double").alias("identity_error"),
    )
