import math
import random

import pytest
from pyspark.sql import functions as F

from lumasift.operators import exact as E


def groups(rng):
    """Sums that lose their low bits, cancel, end between two doubles, or reach the ends of the range."""
    yield [1e16, 1.0, -1e16] * 50 + [1e-16] * 30
    yield [0.1] * 1000
    yield [5e-324] * 7 + [2.2250738585072014e-308, -2.2250738585072014e-308]
    yield [1.7976931348623157e308, -1.7976931348623157e308, 1e-300]
    yield [2.0**53, 1.0, 2.0**-60] + [-0.0, 0.0]
    yield [2.0**53, 1.0, -(2.0**-60)]
    yield [math.ldexp(rng.random() - 0.5, rng.randrange(-1073, 1000)) for _ in range(500)]
    yield [math.ldexp(rng.random() - 0.5, rng.randrange(-30, 30)) for _ in range(2000)]
    yield [float(2**k) for k in range(-1074, 1000, 7)] + [-float(2**k) for k in range(-1074, 990, 7)]
    yield [-0.0, 0.0]


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_fsum(spark, parts):
    own = list(groups(random.Random(1)))
    rows = [(g, x) for g, values in enumerate(own) for x in values]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "g long, x double").repartition(parts)
    got = {r["g"]: r["s"] for r in E.exact_sums(df, ["g"], {"s": F.col("x")}).collect()}
    assert got == {g: math.fsum(v) for g, v in enumerate(own)}


def test_odd_values_and_no_keys(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, nan), (1, 2.0), (2, inf), (2, 1.0), (3, inf), (3, -inf), (4, None), (None, 1.5), (None, 2.5), (5, 1.7e308), (5, 1.7e308), (6, -inf), (6, None)]
    df = spark.createDataFrame(rows, "g long, x double")
    got = {r["g"]: r["s"] for r in E.exact_sums(df, ["g"], {"s": F.col("x")}).collect()}
    assert math.isnan(got[1]) and math.isnan(got[3]) and (got[2], got[4], got[None], got[5], got[6]) == (inf, None, 4.0, inf, -inf)
    both = E.exact_sums(df.filter("g IS NULL OR g = 4"), [], {"a": F.col("x"), "b": F.col("x") * 2}).first()
    assert tuple(both) == (4.0, 8.0)


def test_ensemble_is_the_rounded_mean(spark):
    rng = random.Random(3)
    rows = [(s, f"p{p}", m, rng.random(), k) for s in range(3) for p in range(4) for m in "abc" for k in range(rng.randrange(1, 4))]
    weights = {"a": 0.1, "b": 0.7}
    got = E.exact_ensemble(spark.createDataFrame(rows, "site long, path string, model string, prob double, seq long"), spark.createDataFrame(list(weights.items()), "model string, weight double")).collect()
    last = {(r[0], r[1], r[2]): r[3] for r in sorted(rows, key=lambda r: r[4])}
    for r in got:
        own = {m: x for (s, p, m), x in last.items() if (s, p) == (r["site"], r["path"])}
        w = {m: weights.get(m, 1.0) for m in own}
        assert r["prob"] == math.fsum(w[m] * x for m, x in own.items()) / math.fsum(w.values()) and r["members"] == 3
