"""Exact sums of doubles: the nearest double of the true sum, in any order and any number of partial sums.

A double is a whole number of at most 56 bits times a power of two.  It is cut
in two halves, each a whole number in a limb of 32 bits' weight.  Limbs add up
as decimals without rounding, before and after the shuffle, so the result
depends neither on the order of rows nor on where they are; only the sum of a
group's limbs (some 70 at most) is rounded, once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a limb, of a half, of a scaled number at most; the weight of limb 0 is 2^-ORIGIN.
LIMB, HALF, ORIGIN = 32, 28, 1152


def _two_to(k: Column) -> Column:
    return F.pow(F.lit(2.0), k)


def limbs(x: Column) -> Column:
    """Array of (limb, v) with x = sum of v * 2^(32 limb - ORIGIN); empty for null, zero and what isn't finite."""
    # the estimate may be off by one, which leaves 54 to 56 bits before the point and none behind it
    e = F.floor(F.log2(F.abs(x))).cast("int")

    def scaled(place: Column) -> Column:
        up = F.lit(54) - place
        # by two steps, as one power could overflow
        first = F.floor(up / 2).cast("int")
        whole = (x * _two_to(first) * _two_to(up - first)).cast("long")
        at = place - 54 + ORIGIN
        low = F.abs(whole).bitwiseAND(F.lit((1 << HALF) - 1).cast("long"))
        high = F.shiftright(F.abs(whole), HALF)

        def part(v: Column, spot: Column) -> Column:
            moved = F.call_function("shiftleft", v, F.pmod(spot, F.lit(LIMB)).cast("int"))
            return F.struct(F.floor(spot / LIMB).cast("int").alias("limb"), (moved * F.signum(x).cast("long")).alias("v"))

        return F.array(part(low, at), part(high, at + HALF))

    sound = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != 0)
    return F.when(sound, F.transform(F.array(e), scaled)[0]).otherwise(F.array().cast("array<struct<limb:int,v:bigint>>"))


@F.pandas_udf(T.DoubleType())
def _rounded(parts: pd.Series) -> pd.Series:
    """Texts of ``limb:total`` pairs as the nearest double; beyond the range an infinity."""

    def one(text: str) -> float:
        total = sum(int(v) << (LIMB * int(limb)) for limb, v in (p.split(":") for p in text.split(",") if p))
        try:
            return total / (1 << ORIGIN)
        except OverflowError:
            return math.inf if total > 0 else -math.inf

    return parts.map(one)


def exact_sums(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """``keys`` and the exact sum of each value by group, rounded once.

    Nulls don't count, and a group of nulls alone sums to null; with a nan, or
    infinities of both signs, the sum is nan, with one of a sign it is that.
    """
    names = list(values)
    every = F.array(*[F.struct(F.lit(k).alias("of"), c.cast("double").alias("x")) for k, c in enumerate(values.values())])
    rows = df.select(*keys, F.inline(every))
    x = F.col("x")
    # -1 stands for nan, -2 and -3 for infinities: they are counted beside the limbs
    odd = F.when(F.isnan(x), -1).when(x == float("inf"), -2).when(x == float("-inf"), -3).when(x == 0, -4)
    cut = F.when(x.isNull(), F.array().cast("array<struct<limb:int,v:bigint>>")).when(odd.isNotNull(), F.array(F.struct(odd.alias("limb"), F.lit(1).cast("long").alias("v")))).otherwise(limbs(x))
    sums = rows.select(*keys, "of", F.inline(cut)).groupBy(*keys, "of", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    held = lambda k: F.max(F.when(F.col("limb") == k, 1).otherwise(0)) == 1
    text = F.array_join(F.collect_list(F.when(F.col("limb") >= 0, F.concat_ws(":", F.col("limb").cast("string"), F.col("v").cast("string")))), ",")
    found = sums.groupBy(*keys, "of").agg(text.alias("text"), held(-1).alias("nan"), held(-2).alias("up"), held(-3).alias("down"))
    total = F.when(F.col("nan") | (F.col("up") & F.col("down")), float("nan")).when(F.col("up"), float("inf")).when(F.col("down"), float("-inf")).otherwise(F.col("plain"))
    each = found.withColumn("plain", _rounded("text")).withColumn("total", total)
    wide = each.groupBy(*keys).agg(*[F.max(F.when(F.col("of") == k, F.col("total"))).alias(n) for k, n in enumerate(names)])
    if not keys:
        return wide
    # groups of nulls alone have no limbs
    return df.select(*keys).distinct().join(wide.select(*[F.col(k).alias(f"__{k}") for k in keys], *names), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").select(*keys, *names)


def exact_ensemble(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """site, path, prob, members: weighted means of each model's last score, of exact sums.

    ``scores``: site, path, model, prob, seq; ``weights``: model, weight (absent:
    1).  Without any weight above 0 it is the plain mean.
    """
    last = scores.groupBy("site", "path", "model").agg(F.max_by("prob", "seq").alias("prob"))
    last = last.join(weights.select("model", "weight"), "model", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    sums = exact_sums(last, ["site", "path"], {"weighed": F.col("weight") * F.col("prob"), "total": F.col("weight"), "plain": F.col("prob"), "members": F.lit(1.0)})
    mean = F.when(F.col("total") > 0, F.col("weighed") / F.col("total")).otherwise(F.col("plain") / F.col("members"))
    return sums.select("site", "path", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("prob"), F.col("members").cast("long").alias("members"))
