"""Self checks: kernels run on given tables, their work measured, each figure held against a baseline.

Work is counted while it is done (``DataFrame.observe``), not derived from sizes;
compared pairs, which grow with the square of the prints, from the index's keys.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumasift.functions import mathx as M
from lumasift.operators import records as R
from lumasift.operators import sequential as S
from lumasift.operators.components import connected_components
from lumasift.operators.print_index import PrintIndex


class Check(NamedTuple):
    kernel: str
    metric: str
    baseline: float
    #: Whether more is better; None: the baseline has to be met exactly.
    more: bool | None
    measure: Callable[[], float]


def measured(df: DataFrame, count: str = "n") -> float:
    """Rows that a plan makes at this place, counted as it runs."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias(count)).write.format("noop").mode("overwrite").save()
    return float(seen.get[count])


def lsh_compares(index: PrintIndex, prints: DataFrame) -> float:
    """Pairs that a search for every print would compare, as a share of all pairs: counted from the keys, none is made."""
    n = prints.count()
    return index.met(queries=prints) / max(1, n * n)


def sprt_used(images: DataFrame) -> float:
    """Most images that the test takes of each key's (key, nth), all of them strongly clean."""
    return float(S.sprt(images, "key", "nth", F.lit(0.02)).agg(F.max("used")).first()[0])


def good_weight(outcomes: DataFrame) -> float:
    """Weight of the provider who is always right beside one who is right half of the time (t, right)."""
    good = outcomes.select(F.lit("good").alias("provider"), F.lit(True).alias("correct"), "t")
    even = outcomes.select(F.lit("even").alias("provider"), (F.pmod(F.floor("t"), F.lit(2)) == 0).alias("correct"), "t")
    both = good.unionByName(even)
    weights = S.bayes_weights(both, F.lit(both.agg(F.max("t")).first()[0]), 1e12)
    return float(weights.filter("provider = 'good'").first()["weight"])


def multiply_adds(a: DataFrame) -> float:
    """Products that a matrix (i, j, v) times its transpose takes."""
    b = a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    right = b.select(F.col("i").alias("k"), F.col("j").alias("jj"), F.col("v").alias("w"))
    joined = measured(a.join(right, a["j"] == F.col("k")))
    M.matmul(a, b).write.format("noop").mode("overwrite").save()
    return joined


def hype_left(texts: DataFrame) -> float:
    """Words of hyperbole in polished texts (text)."""
    held = R.polished(F.col("text"))
    hits = sum((F.when(held.contains(w), 1).otherwise(0) for w in R.HYPERBOLE), F.lit(0))
    return float(texts.agg(F.sum(hits)).first()[0] or 0)


def edges_within(edges: DataFrame) -> float:
    """Share of edges (a, b) whose ends are in one component."""
    of = connected_components(edges)
    met = edges.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    return float(met.agg(F.avg((F.col("ca") == F.col("cb")).cast("double"))).first()[0])


def picked(items: DataFrame, budget: float) -> float:
    """Items of unit cost that a budget takes (key, id, value, cost): the fewest of a key."""
    return float(S.select_round(items, "key", "value", "cost", budget).groupBy("key").count().agg(F.min("count")).first()[0])


def run(spark: SparkSession, checks: list[Check]) -> DataFrame:
    """kernel, metric, value, baseline, status (pass, fail); a kernel that raises fails and has no value."""
    rows = []
    for c in checks:
        try:
            value: float | None = float(c.measure())
        except Exception as error:  # a broken kernel is a finding, not the end of the report
            rows.append((c.kernel, c.metric, None, c.baseline, "fail", type(error).__name__))
            continue
        sound = value == c.baseline if c.more is None else value >= c.baseline if c.more else value <= c.baseline
        rows.append((c.kernel, c.metric, value, c.baseline, "pass" if sound else "fail", None))
    return spark.createDataFrame(rows, "kernel string, metric string, value double, baseline double, status string, error string")
