"""Case groups, sessions, queue reports and cost reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumasift.operators.decision import rank_of


def counts_with_zeros(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """n for every value of a fixed domain, 0 where absent."""
    known = df.sparkSession.createDataFrame([(x,) for x in domain], f"{column} string")
    return known.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").na.fill(0, ["n"])


def pivot_counts(df: DataFrame, key: str, column: str, domain: Sequence[str]) -> DataFrame:
    """One column of counts per value of the domain."""
    return df.groupBy(key).agg(*[F.count(F.when(F.col(column) == x, 1)).alias(x) for x in domain])


def worst(verdict: str = "verdict") -> Column:
    return F.max_by(verdict, rank_of(F.col(verdict)))


def case_groups(entries: DataFrame) -> DataFrame:
    """Entries (id, key, raw, host, verdict, agg4) by key, or by raw url without one."""
    group = F.when(F.coalesce(F.col("key"), F.lit("")) != "", F.col("key")).otherwise(F.concat(F.lit("raw::"), F.col("raw")))
    grouped = entries.withColumn("group", group).groupBy("group").agg(
        F.count("*").alias("size"),
        F.count_distinct("raw").alias("urls"),
        F.count_distinct(F.when(F.col("host") != "", F.col("host"))).alias("hosts"),
        F.max("agg4").alias("agg4"),
        worst().alias("verdict"),
        F.min("id").alias("first_id"),
    )
    return grouped


def sessions(events: DataFrame) -> DataFrame:
    """Running groups (name, verdict, agg4, count, seq, ts) as they stand after all events."""
    return events.groupBy("name").agg(
        F.count("*").alias("scans"),
        worst().alias("verdict"),
        F.max_by("verdict", "seq").alias("last_verdict"),
        F.max("agg4").alias("agg_max"),
        F.max_by("agg4", "seq").alias("last_agg"),
        F.sum("hits").alias("hits"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def cost_report(rows: DataFrame, by: str, missing: str) -> DataFrame:
    """Calls, images, cents and unpriced calls by ``by``, with a row of totals.

    Grouping sets aggregate both at once.  Missing keys show as ``missing``, the
    totals' key is null.
    """
    keyed = rows.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit(missing)))
    return keyed.rollup(by).agg(
        F.count("*").alias("calls"),
        F.sum("images").alias("images"),
        F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("cost_cents"),
        F.count(F.when(F.col("cost_cents").isNull(), 1)).alias("unpriced"),
    )


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first row of each value: an aggregation, not a sort."""
    rest = [c for c in df.columns if c != value]
    return df.groupBy(value).agg(F.min_by(F.struct(*rest), order).alias("__first")).select(value, *[F.col(f"__first.{c}").alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= k)
