"""Logical tables of the screening domain, derived from the test tables.

Each function has a twin of the same name in ``lumasift.plans.sql_views``.
Derived probabilities are whole ten-thousandths, so sums of them are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, path, model, p4 (probability x 10000), width, height, seq, ts."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    f = F.pmod(F.floor(F.col("value") * 100 + 0.5) * 31, F.lit(100)) / F.lit(100.0)
    p = F.least(F.lit(1.0), f * (1 + F.pmod("user_id", F.lit(5))) / F.lit(3.0))
    return events.select(
        F.col("user_id").alias("site"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor(k / 4).cast("string")).alias("path"),
        F.col("event_type").alias("model"),
        F.floor(p * 10000 + 0.5).cast("long").alias("p4"),
        F.pmod(F.col("event_id") * 37, F.lit(400)).alias("width"),
        F.pmod(F.col("event_id") * 53, F.lit(400)).alias("height"),
        F.col("event_id").alias("seq"),
        "ts",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review queue: id, site, status, verdict, agg4, created_at, note."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "approved").when(F.pmod("o_orderkey", F.lit(2)) == 0, "submitted").otherwise("rejected")
    verdict = F.when(F.col("o_totalprice") >= 330000, "nsfw").when(F.col("o_totalprice") >= 170000, "suspect").otherwise("clean")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("site"),
        status.alias("status"),
        verdict.alias("verdict"),
        F.floor(F.col("o_totalprice") / 50).cast("long").alias("agg4"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.pmod("o_orderkey", F.lit(11)) == 0, F.concat(F.lit("[组:g"), F.pmod("o_orderkey", F.lit(7)).cast("string"), F.lit("]"))).alias("note"),
    )


def cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost ledger: run_id, provider, model, images, cost_cents (null: unpriced), day."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.when(F.pmod("l_orderkey", F.lit(53)) != 0, F.concat(F.lit("run-"), F.pmod("l_orderkey", F.lit(50)).cast("string"))).alias("run_id"),
        F.col("l_returnflag").alias("provider"),
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        F.col("l_quantity").cast("long").alias("images"),
        F.when(F.col("l_linenumber") != 7, F.floor(F.col("l_extendedprice") / 10).cast("long")).alias("cost_cents"),
        F.to_date("l_shipdate").alias("day"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite site-media rows, distinct: an event's value in hundredths stands for an image."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("site"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("media")).distinct()


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, site, h (signed 64 bits), family: sign bits of embeddings, and two altered copies of each.

    The first copy has the last ``family`` (0 to 11) bits flipped, the second
    one the first four bits as well.
    """
    return prints_of(table(spark, sf_dir, "embeddings"))


def prints_of(embeddings: DataFrame) -> DataFrame:
    """As fingerprints(), of a table or stream of embeddings."""
    emb = embeddings.select("vec_id", "label", "embedding")
    family = F.pmod("vec_id", F.lit(12)).cast("int")
    copies = emb.select("vec_id", "label", "embedding", family.alias("family"), F.explode(F.array(*map(F.lit, range(3)))).alias("copy"))
    flip = lambda i: ((F.col("copy") >= 1) & (i >= F.size("embedding") - F.col("family"))) != ((F.col("copy") == 2) & (i < 4))
    bits = F.transform("embedding", lambda x, i: F.when((x > 0) != flip(i), F.expr("1L")).otherwise(F.expr("0L")))
    h = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    return copies.select((F.col("vec_id") * 3 + F.col("copy")).alias("sha"), (F.col("label") + F.col("copy")).alias("site"), h.alias("h"), "family")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only events: seq, entry_id, event_type, turn, role, note."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kind = F.element_at(F.array(*map(F.lit, ("added", "approved", "annotated", "rejected"))), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    return conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.col("conv_id").alias("entry_id"),
        kind.alias("event_type"),
        "turn",
        F.col("role").alias("actor"),
        F.col("text").alias("note"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with scores: doc_id, label (0/1), p4, source_kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        F.col("toxic").cast("long").alias("label"),
        (F.pmod(F.col("n_chars") * 7919, F.lit(1000)) * 10).cast("long").alias("p4"),
        F.when(F.col("quality") == 1, "human").otherwise("other").alias("source_kind"),
    )
