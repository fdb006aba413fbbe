"""Places of rows in order, by group, without a task that sorts a group.

Rows are range-partitioned by group and order, a task numbers its own, and
counts of (group, partition) shift them: a group with a third of all rows is as
many tasks as its share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumasift.scratch import saved


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], label: str = "ranks") -> DataFrame:
    """``df`` with i (from 0, in order) and n (rows) of its group; nulls are a group, ties are in any fixed order."""
    fixed = saved(df, f"{label}-rows")
    by = [*[F.col(g).asc_nulls_first() for g in group], *order, F.col("__nth").asc()]
    ranged = fixed.withColumn("__nth", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = saved(ranged.drop("__nth").withColumn("__place", F.monotonically_increasing_id()), f"{label}-ranged")
    part = F.shiftrightunsigned("__place", 33)
    keys = [F.col(g).alias(f"__g{k}") for k, g in enumerate(group)]
    runs = ranged.groupBy(*keys, part.alias("__part")).agg(F.count("*").alias("__rows"), F.min("__place").alias("__first"))
    whole = Window.partitionBy(*[f"__g{k}" for k in range(len(group))]) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[f"__g{k}" for k in range(len(group))], "__part", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n"))
    same = part == F.col("__part")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    met = ranged.join(runs, same).withColumn("i", F.col("__place") + F.col("__shift"))
    return met.select(*df.columns, "i", "n")


def tile(i: Column, n: Column, k: int) -> Column:
    """The tile, from 1, of place i among n: k tiles of alike size, the first ones a row larger."""
    small, more = F.floor(n / k), n % k
    early = i < more * (small + 1)
    return (F.when(early, F.floor(i / (small + 1))).otherwise(more + F.floor((i - more * (small + 1)) / F.greatest(small, F.lit(1)))) + 1).cast("int")


def discrete_percentile(df: DataFrame, group: Sequence[str], value: str, p: float, label: str = "percentile") -> DataFrame:
    """``group`` and the smallest value that a share ``p`` of the group's values doesn't exceed."""
    placed = numbered(df.select(*group, value).filter(F.col(value).isNotNull()), group, [F.col(value).asc()], label)
    return placed.filter(F.col("i") == F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))) - 1).select(*group, value)
