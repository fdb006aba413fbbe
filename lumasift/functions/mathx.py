"""Numeric functions: calibration lines, significant digits, matrices, tails of distributions."""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Anchors of the piecewise-linear calibration.
ANCHORS = ((0.0, 0.02), (0.3, 0.35), (0.5, 0.55), (0.7, 0.78), (0.85, 0.90), (0.95, 0.97), (1.0, 0.99))


def calibrated(raw: Column, anchors: Sequence[tuple[float, float]] = ANCHORS) -> Column:
    """Linear between anchors; clipped to 0..1, not-a-number as 0."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(raw), 0.0).otherwise(raw)))
    made = None
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]):
        line = F.lit(y0) + (x - F.lit(x0)) * F.lit(y1 - y0) / F.lit(x1 - x0)
        made = F.when(x <= x1, line) if made is None else made.when(x <= x1, line)
    return made


def significant(x: Column, digits: int = 12) -> Column:
    return F.format_string(f"%.{digits}g", x).cast("double")


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of two matrices in (i, j, v): an equi-join on the inner index and a sum."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("jj"), F.col("v").alias("w"))
    return a.join(right, a["j"] == F.col("k")).groupBy("i", F.col("jj").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def exact_lower(k: Column, n: Column, delta: float) -> Column:
    """Clopper-Pearson lower bound, per distinct (k, n) of a batch."""

    @F.pandas_udf("double")
    def bound(ks: pd.Series, ns: pd.Series) -> pd.Series:
        known: dict = {}
        for pair in zip(ks, ns):
            if pair not in known:
                known[pair] = 0.0 if pair[0] == 0 else beta_quantile(delta, pair[0], pair[1] - pair[0] + 1)
        return pd.Series([known[p] for p in zip(ks, ns)])

    return bound(k, n)


def norm_ppf(p: float) -> float:
    """Quantile of the standard normal distribution."""
    return statistics.NormalDist().inv_cdf(p)


def exact_upper(k: Column, n: Column, delta: float) -> Column:
    """Clopper-Pearson upper bound, as exact_lower has the lower one."""
    return 1 - exact_lower(n - k, n, delta)


def bootstrap_mean(df: DataFrame, key: str, value: str, rounds: int = 2000, seed: int = 11, level: float = 0.95) -> DataFrame:
    """Per key the mean with a percentile interval of resampled means.

    Values are counted first, and a resample draws counts from a multinomial, so
    the work goes with a key's distinct values, not its rows.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("c"))
    kind = df.schema[key].dataType.simpleString()

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        rng = np.random.default_rng([seed, *str(pdf[key].iloc[0]).encode()])
        values, weights = pdf[value].to_numpy(float), pdf["c"].to_numpy()
        n = int(weights.sum())
        means = np.concatenate([rng.multinomial(n, weights / n, min(200, rounds - at)) @ values for at in range(0, rounds, 200)]) / n
        lo, hi = np.percentile(means, (50 * (1 - level), 50 * (1 + level)), method="inverted_cdf")
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [float(values @ weights) / n], "lo": [lo], "hi": [hi]})

    return counts.groupBy(key).applyInPandas(apply, f"{key} {kind}, mean double, lo double, hi double")


def sign_flip_test(df: DataFrame, key: str, value: str, rounds: int = 2000, seed: int = 13) -> DataFrame:
    """key, n, mean, p: how often random signs give a mean as far from 0 (the given signs count as one round).

    Values are counted by size, and flipped signs are drawn as binomial counts.
    """
    counts = df.groupBy(key, F.abs(F.col(value)).alias("size")).agg(F.count("*").alias("c"), F.sum(value).alias("total"))
    kind = df.schema[key].dataType.simpleString()

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        rng = np.random.default_rng([seed, *str(pdf[key].iloc[0]).encode()])
        size, c = pdf["size"].to_numpy(float), pdf["c"].to_numpy()
        seen = float(pdf["total"].sum())
        sums = (2 * rng.binomial(c, 0.5, (rounds, len(c))) - c) @ size
        extreme = int((np.abs(sums) >= abs(seen) - 1e-9).sum())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [int(c.sum())], "mean": [seen / c.sum()], "p": [(extreme + 1) / (rounds + 1)]})

    return counts.groupBy(key).applyInPandas(apply, f"{key} {kind}, n long, mean double, p double")
