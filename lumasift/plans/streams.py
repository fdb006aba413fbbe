"""Stream queries run over a table's files until all is read, then shown as a table."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumasift.operators import sequential as Q
from lumasift.plans.decision import q6, sql6
from lumasift.plans.sql_views import with_views
from lumasift.plans.stats import _GATE
from lumasift.scratch import fresh_path
from lumasift.sources import sinks
from lumasift.sources import views as V
from lumasift.streaming import processors as S


def _stream(spark, sf, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    # a pattern of this name alone, since the stream source takes no single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def _settings(spark, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drain(df: DataFrame, label: str) -> DataFrame:
    """All rows that an append stream gives."""
    spark = df.sparkSession
    out, marks = fresh_path(spark, label), fresh_path(spark, f"{label}-marks")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _drain_latest(df: DataFrame, label: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key that an update stream gives."""
    spark = df.sparkSession
    out, marks = fresh_path(spark, label), fresh_path(spark, f"{label}-marks")
    df.writeStream.foreachBatch(sinks.upsert(spark, out, keys, order)).option("checkpointLocation", marks).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return sinks.read_upserted(spark, out, keys, order)


def _scores(spark, sf) -> DataFrame:
    e = _stream(spark, sf, "events")
    return e.select(F.col("user_id").alias("site"), F.col("event_id").alias("seq"), F.pmod(F.floor(F.col("value") * 100 + 0.5).cast("long") * 31, F.lit(100)).alias("f"), "ts", "event_type")


def stream_sprt(spark, sf):
    """Settled tests; events of the newest moment are not behind the watermark and don't count."""
    scores = _scores(spark, sf).select("site", "seq", (F.col("f") * 100).alias("p4"), F.col("ts").cast("timestamp").alias("ts"))
    with _settings(spark, ROCKSDB):
        return _drain(S.sprt(scores), "stream-sprt")


def stream_sessions(spark, sf):
    e = _scores(spark, sf).select(F.col("site").alias("name"), (F.col("f") * 100).alias("agg4"), F.pmod("seq", F.lit(5)).alias("hits"), "seq")
    return _drain_latest(S.sessions(e), "stream-sessions", ["name"], "scans")


def stream_ledger(spark, sf):
    c = _stream(spark, sf, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ("added", "approved", "annotated", "rejected"))), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    events = c.select(F.col("conv_id").alias("entry_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), kind.alias("event_type"))
    return _drain_latest(S.ledger_fold(events), "stream-ledger", ["entry_id"], "events")


def stream_gate(spark, sf):
    """Decisions of the send gate by site; each fingerprint comes once more as a copy.  The newest row is not behind the watermark."""
    prints = V.prints_of(_stream(spark, sf, "embeddings"))
    size = lambda k: F.pmod(F.col("sha") * k, F.lit(400))
    images = prints.select("site", F.explode(F.array(F.col("sha") * 2, F.col("sha") * 2 + 1)).alias("pos"), F.col("sha").cast("string").alias("sha"), "h", size(37).alias("width"), size(53).alias("height"))
    with _settings(spark, ROCKSDB):
        done = _drain(S.send_gate(images.withColumn("ts", F.timestamp_seconds(F.col("pos") + 86400)), near_bits=6), "stream-gate")
    return done.groupBy("site", "decision").agg(F.count("*").alias("n"))


def stream_reliability(spark, sf):
    """Weights from sums that a stream of outcomes keeps, as of a hundred steps after the last."""
    rows = _scores(spark, sf).select(F.col("event_type").alias("provider"), ((F.col("f") >= 50) == (F.pmod("seq", F.lit(3)) == 0)).alias("correct"), F.col("seq").cast("double").alias("t"))
    with _settings(spark, ROCKSDB):
        sums = _drain_latest(S.reliability(rows, 2000.0), "stream-reliability", ["provider"], "n")
    w = Q.checkpoint_weights(sums, F.lit(sums.agg(F.max("anchor")).first()[0] + 100), 2000.0)
    return w.select("provider", q6(F.col("mean")).alias("mean"), q6(F.col("weight")).alias("weight"))


def stream_windows(spark, sf):
    """Counts of final windows by event type, summed (open windows at the end aren't final)."""
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = _drain(S.window_counts(e, "ts", "event_type", "1 day", "1 hour"), "stream-windows")
    return done.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("events"))


def stream_first(spark, sf):
    """The first event of each user and type, as a stream without repeats finds it."""
    e = _stream(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _drain(S.first_of_each(e, "ts", ["user_id", "event_type"], "60 days"), "stream-first").select("user_id", "event_type")


def stream_quiet(spark, sf):
    """Final sessions of users, counted."""
    e = _stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    done = _drain(S.quiet_sessions(e, "ts", "user_id", "30 minutes", "0 seconds"), "stream-quiet")
    return done.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


_QUIET = """
WITH q AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
x AS (SELECT user_id, g, max(ts) AS last, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM q) GROUP BY ALL)
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM x WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) GROUP BY user_id
"""
_FINAL = """
WITH w AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY event_type
"""

_SCORES = "SELECT user_id AS site, event_id AS seq, ((CAST(floor(value * 100 + 0.5) AS BIGINT) * 31) % 100) * 100 AS p4, ts FROM events"

_GATED = _GATE.replace("UNION ALL SELECT site, 'copy' FROM small)", "UNION ALL SELECT site, 'copy' FROM small WHERE sha < (SELECT max(sha) FROM small))")
_WEIGHTS = f"""
WITH r AS (SELECT event_type AS provider, (p4 >= 5000) = (seq % 3 = 0) AS correct, exp(-ln(2.0::DOUBLE) * ((SELECT max(event_id) + 100.0::DOUBLE FROM events) - seq) / 2000.0::DOUBLE) AS w FROM ({_SCORES.replace("SELECT user_id", "SELECT event_type, user_id")})),
o AS (SELECT provider, coalesce(sum(w) FILTER (WHERE correct), 0) AS good, coalesce(sum(w) FILTER (WHERE NOT correct), 0) AS bad FROM r GROUP BY provider),
m AS (SELECT provider, (1 - sh) * ((1 + good) / (2 + good + bad)) + sh * pool AS mean FROM (SELECT *, CASE WHEN good + bad < 5 THEN 1.0 ELSE 10.0::DOUBLE / (10.0::DOUBLE + good + bad) END AS sh FROM o), (SELECT (1 + sum(good)) / (2 + sum(good) + sum(bad)) AS pool FROM o))
SELECT provider, {sql6('mean')} AS mean, {sql6('mean / sum(mean) OVER ()')} AS weight FROM m
"""

QUERIES = {
    "stream_gate": (stream_gate, with_views("", "FINGERPRINTS").replace("WITH ", "WITH RECURSIVE ", 1).strip() + _GATED),
    "stream_reliability": (stream_reliability, _WEIGHTS),
    "stream_sprt": (
        stream_sprt,
        f"""WITH r AS (SELECT site, row_number() OVER w AS n, sum(x * ln(0.9::DOUBLE / 0.5) + (1 - x) * ln((1 - 0.9::DOUBLE) / (1 - 0.5))) OVER (w ROWS UNBOUNDED PRECEDING) AS total
        FROM (SELECT site, seq, greatest(0.01::DOUBLE, least(0.99::DOUBLE, p4 / 10000.0::DOUBLE)) AS x FROM ({_SCORES}) WHERE ts < (SELECT max(ts) FROM events)) WINDOW w AS (PARTITION BY site ORDER BY seq)),
        s AS (SELECT *, CASE WHEN total >= ln(0.95::DOUBLE / 0.05) THEN 'nsfw' WHEN total <= ln(0.05::DOUBLE / 0.95) THEN 'clean' END AS state FROM r)
        SELECT site, arg_min(state, n) AS state, min(n) AS used FROM s WHERE state IS NOT NULL GROUP BY site""",
    ),
    "stream_sessions": (stream_sessions, f"SELECT site AS name, count(*) AS scans, max(p4) AS agg_max, arg_max(p4, seq) AS last_agg, CAST(sum(seq % 5) AS BIGINT) AS hits FROM ({_SCORES}) GROUP BY site"),
    "stream_ledger": (stream_ledger, with_views("SELECT entry_id, arg_max(CASE event_type WHEN 'added' THEN 'pending' ELSE event_type END, seq) FILTER (WHERE event_type <> 'annotated') AS status, count(*) AS events FROM ledger GROUP BY entry_id", "LEDGER")),
    "stream_windows": (stream_windows, _FINAL),
    "stream_first": (stream_first, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_quiet": (stream_quiet, _QUIET),
}
