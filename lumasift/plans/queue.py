"""Queries on the review queue, costs, case groups, sessions and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumasift.functions import text as T
from lumasift.functions import url as U
from lumasift.operators import decision as D
from lumasift.operators import grouping as G
from lumasift.operators import ledger as L
from lumasift.plans.decision import _ASSESS, _ENSEMBLE, q6, sql6
from lumasift.plans.sql_views import LEDGER, with_views
from lumasift.plans.urls_text import _HOSTED, _KEYED
from lumasift.sources import views as V

STATUSES = ("pending", "approved", "rejected", "submitted")


def queue_status_counts(spark, sf):
    return G.counts_with_zeros(V.entries(spark, sf), "status", (*STATUSES[:3], "submitted"))


def batch_pivot(spark, sf):
    batches = V.entries(spark, sf).withColumn("batch_id", F.pmod("id", F.lit(40)))
    return G.pivot_counts(batches, "batch_id", "status", STATUSES)


def queue_page(spark, sf, offset: int = 100, limit: int = 50):
    return V.entries(spark, sf).filter(F.col("status") == "pending").orderBy("id").offset(offset).limit(limit).select("id", "site", "verdict")


def latest_of_site(spark, sf):
    return V.entries(spark, sf).groupBy("site").agg(F.max("id").alias("last_id"))


def daily_trend(spark, sf):
    e = V.entries(spark, sf).withColumn("day", F.to_date("created_at"))
    return e.groupBy("day").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES], F.count("*").alias("total")).withColumn("day", F.col("day").cast("string")).orderBy("day")


def reconcile_human_machine(spark, sf):
    """How people's decisions stand to the machine's scores."""
    e = V.entries(spark, sf)
    resolved = F.col("status").isin("approved", "submitted")
    doubtful = (F.col("status") == "rejected") & ((F.col("verdict") == "nsfw") | (F.col("agg4") >= 9000))
    return e.agg(
        F.count(F.when(resolved, 1)).alias("confirmed"),
        F.count(F.when(F.col("status") == "rejected", 1)).alias("rejected"),
        F.count(F.when(doubtful, 1)).alias("fp_candidates"),
        F.count(F.when(F.col("note").contains("组"), 1)).alias("noted"),
        F.count(F.when(F.col("agg4") < 0, 1)).alias("no_score"),
    )


def cost_by_model(spark, sf):
    return G.cost_report(V.cost_rows(spark, sf), "model", "(未知模型)")


def cost_by_run(spark, sf):
    return G.cost_report(V.cost_rows(spark, sf), "run_id", "(未标记批次)")


def cost_by_day(spark, sf):
    return G.cost_report(V.cost_rows(spark, sf), "day", "(未知日期)")


def _cost(key: str, missing: str) -> str:
    shown = f"coalesce(CAST({key} AS VARCHAR), '{missing}')"
    sums = "count(*) AS calls, CAST(sum(images) AS BIGINT) AS images, CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cost_cents, count(*) FILTER (WHERE cost_cents IS NULL) AS unpriced"
    return with_views(f"SELECT {shown} AS {key}, {sums} FROM cost_rows GROUP BY {shown} UNION ALL SELECT NULL, {sums} FROM cost_rows", "COST_ROWS")


def budget_status(spark, sf, cents: int = 20_000_000):
    """Per run: spent, and whether it is over the budget."""
    spent = V.cost_rows(spark, sf).groupBy("run_id").agg(F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("spent"))
    return spent.withColumn("over", F.col("spent") > cents // 100)


def _grouped(spark, sf):
    pages = V.table(spark, sf, "pages").select(F.col("page_id").alias("site"), "url")
    e = V.entries(spark, sf).join(pages, "site", "left").withColumn("raw", F.coalesce("url", F.concat(F.lit("site-"), F.col("site").cast("string"))))
    return e.select("id", "raw", "verdict", "agg4", "status", U.host(F.col("raw")).alias("host"), U.canonical_key(F.col("raw")).alias("key"))


_GROUPED = """
SELECT e.id, coalesce(k.url, 'site-' || e.site) AS raw, verdict, agg4, status, coalesce(k.host, '') AS host, coalesce(k.key, '') AS key,
       CASE WHEN coalesce(k.key, '') <> '' THEN k.key ELSE 'raw::' || coalesce(k.url, 'site-' || e.site) END AS grp
FROM entries e LEFT JOIN keyed k ON e.site = k.page_id
"""
_GROUPS = """
SELECT grp AS "group", count(*) AS size, count(DISTINCT raw) AS urls, count(DISTINCT nullif(host, '')) AS hosts, max(agg4) AS agg4,
       CASE max(CASE verdict WHEN 'nsfw' THEN 2 WHEN 'suspect' THEN 1 ELSE 0 END) WHEN 2 THEN 'nsfw' WHEN 1 THEN 'suspect' ELSE 'clean' END AS verdict, min(id) AS first_id
FROM grouped GROUP BY grp
"""


def _on_groups(body: str) -> str:
    return with_views(body, "ENTRIES", hosted=_HOSTED, keyed=_KEYED, grouped=_GROUPED, groups=_GROUPS)


def case_groups(spark, sf):
    return G.case_groups(_grouped(spark, sf))


def group_stats(spark, sf):
    g = G.case_groups(_grouped(spark, sf))
    return g.agg(
        F.count("*").alias("groups"),
        F.count(F.when(F.col("hosts") >= 2, 1)).alias("multi_site"),
        F.count(F.when(F.col("hosts") < 2, 1)).alias("single_site"),
        F.sum("urls").alias("urls"),
        *[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in D.VERDICTS],
    )


def group_stats_top5(spark, sf):
    return G.case_groups(_grouped(spark, sf)).orderBy(F.desc("urls"), F.desc("agg4"), "group").limit(5).select("group", "urls", "agg4")


def repeat_offenders(spark, sf):
    """Rejected entries whose key has a group of several urls; each site and group once."""
    e = _grouped(spark, sf)
    groups = G.case_groups(e).filter(F.col("urls") >= 2).select(F.col("group").alias("key"), "urls")
    return e.filter((F.col("status") == "rejected") & (F.col("key") != "")).join(groups, "key").groupBy("raw", "key").agg(F.min("id").alias("id"), F.max("urls").alias("urls"))


def group_rows(spark, sf):
    """Groups for a table: scores at two places, and whether they are attested."""
    attested = V.table(spark, sf, "nation").filter(F.pmod("n_nationkey", F.lit(2)) == 0).select(F.concat(F.lit("g"), F.pmod("n_nationkey", F.lit(7)).cast("string")).alias("name")).distinct().withColumn("attested", F.lit(True))
    named = V.entries(spark, sf).withColumn("name", T.marker_group(F.col("note"))).filter(F.col("name") != "")
    rows = named.groupBy("name").agg(F.count("*").alias("entries"), (F.floor(F.max("agg4") / 100.0 + 0.5) / 100.0).alias("agg"))
    return rows.join(attested, "name", "left").withColumn("attested", F.coalesce("attested", F.lit(False)))


def ready_entries(spark, sf, limit: int = 20):
    """Approved entries of attested groups, the first ones by id."""
    attested = V.table(spark, sf, "nation").filter(F.pmod("n_nationkey", F.lit(2)) == 0).select(F.concat(F.lit("g"), F.pmod("n_nationkey", F.lit(7)).cast("string")).alias("name")).distinct()
    named = V.entries(spark, sf).filter(F.col("status") == "approved").withColumn("name", T.marker_group(F.col("note")))
    return named.join(attested, "name", "left_semi").orderBy("id").limit(limit).select("id", "name")


def resume_pending(spark, sf):
    """Sites to scan that no journal row marks as done."""
    todo = V.entries(spark, sf).select("site").distinct()
    done = V.entries(spark, sf).filter(F.col("status") == "submitted").select("site")
    return todo.join(done, "site", "left_anti")


def dedup_first_seen(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("flag"))
    return G.first_seen(orders, "site", "id")


def session_groups(spark, sf):
    e = V.image_score(spark, sf)
    verdict = F.when(F.col("p4") >= 9000, "nsfw").when(F.col("p4") >= 5000, "suspect").otherwise("clean")
    rows = e.select(F.col("site").alias("name"), verdict.alias("verdict"), F.col("p4").alias("agg4"), F.pmod("seq", F.lit(5)).alias("hits"), "seq", "ts")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")}
    return G.sessions(rows).withColumns(shown)


_SESSIONS = """
SELECT name, count(*) AS scans, CASE max(r) WHEN 2 THEN 'nsfw' WHEN 1 THEN 'suspect' ELSE 'clean' END AS verdict,
       arg_max(CASE r WHEN 2 THEN 'nsfw' WHEN 1 THEN 'suspect' ELSE 'clean' END, seq) AS last_verdict, max(p4) AS agg_max, arg_max(p4, seq) AS last_agg, CAST(sum(seq % 5) AS BIGINT) AS hits,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM (SELECT site AS name, p4, seq, ts, CASE WHEN p4 >= 9000 THEN 2 WHEN p4 >= 5000 THEN 1 ELSE 0 END AS r FROM image_score) GROUP BY name
"""


def ledger_projection(spark, sf):
    p = L.projection(V.ledger(spark, sf))
    return p.select("entry_id", "status", "note", F.concat_ws(">", "chain").alias("chain"), "created_seq", "events", "other_events")


_STATUS = "CASE event_type WHEN 'added' THEN 'pending' WHEN 'approved' THEN 'approved' WHEN 'rejected' THEN 'rejected' WHEN 'submitted' THEN 'submitted' END"
_PROJECTED = f"""
SELECT entry_id, arg_max(s, seq) FILTER (WHERE s IS NOT NULL) AS status, arg_max(note, seq) FILTER (WHERE s IS NOT NULL AND note <> '') AS note,
       coalesce(string_agg(s, '>' ORDER BY seq), '') AS chain, min(seq) AS created_seq, count(*) AS events, count(*) FILTER (WHERE s IS NULL) AS other_events
FROM (SELECT *, {_STATUS} AS s FROM ledger) GROUP BY entry_id
"""


def _actual(spark, sf):
    """The table as it might stand: some entries lag, some differ, some are absent on either side."""
    p = L.projection(V.ledger(spark, sf)).filter(F.pmod("entry_id", F.lit(10)) != 0)
    status = F.when(F.pmod("entry_id", F.lit(4)) == 1, "pending").when(F.pmod("entry_id", F.lit(9)) == 2, "submitted").otherwise(F.col("status"))
    lost = V.table(spark, sf, "region").select((F.col("r_regionkey") + 900000).alias("entry_id"), F.lit("pending").alias("status"), F.lit("x").alias("note"))
    return p.select("entry_id", status.alias("status"), F.when(F.pmod("entry_id", F.lit(7)) == 3, "changed").otherwise(F.col("note")).alias("note")).unionByName(lost)


_ACTUAL = """
SELECT entry_id, CASE WHEN entry_id % 4 = 1 THEN 'pending' WHEN entry_id % 9 = 2 THEN 'submitted' ELSE status END AS status,
       CASE WHEN entry_id % 7 = 3 THEN 'changed' ELSE note END AS note FROM projected WHERE entry_id % 10 <> 0
UNION ALL SELECT r_regionkey + 900000, 'pending', 'x' FROM region
"""
_DIFFS = """
SELECT entry_id, kind, expected_status, actual_status FROM (
  SELECT coalesce(p.entry_id, a.entry_id) AS entry_id, p.status AS expected_status, a.status AS actual_status,
    CASE WHEN p.status IS NULL THEN '账本缺失'
         WHEN a.status IS NULL OR (a.status = 'pending' AND p.status IN ('approved', 'rejected', 'submitted')) OR (a.status = 'approved' AND p.status = 'submitted') THEN '事件超前'
         WHEN p.status <> a.status THEN '状态不一致' WHEN p.note IS DISTINCT FROM a.note THEN '字段不一致' END AS kind
  FROM projected p FULL OUTER JOIN actual a ON p.entry_id = a.entry_id) WHERE kind IS NOT NULL
"""


def _on_ledger(body: str) -> str:
    return with_views(body, "LEDGER", projected=_PROJECTED, actual=_ACTUAL, diffs=_DIFFS)


def ledger_reconcile(spark, sf):
    return L.reconcile(L.projection(V.ledger(spark, sf)), _actual(spark, sf))


def heal_plan(spark, sf):
    return L.heal_plan(ledger_reconcile(spark, sf))


def illegal_transitions(spark, sf):
    return L.illegal_transitions(V.ledger(spark, sf))


def approvals_reconcile(spark, sf):
    """Reviewers by event against the table's: lagging if a beginning, else inconsistent."""
    by_event = V.ledger(spark, sf).filter(F.col("event_type") == "approved").groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "actor"))), lambda x: x["actor"]).alias("expected"))
    there = by_event.select("entry_id", F.when(F.pmod("entry_id", F.lit(3)) == 0, F.slice("expected", 1, 1)).when(F.pmod("entry_id", F.lit(3)) == 1, F.array(F.lit("someone"))).otherwise(F.col("expected")).alias("actual"))
    both = by_event.join(there, "entry_id")
    kind = F.when(F.col("expected") == F.col("actual"), "same").when(F.slice("expected", 1, F.size("actual")) == F.col("actual"), "lagging").otherwise("inconsistent")
    return both.select("entry_id", kind.alias("kind"), F.size("expected").alias("expected_n"), F.size("actual").alias("actual_n"))


_APPROVALS = """
SELECT entry_id, CASE WHEN expected = actual THEN 'same' WHEN expected[1:len(actual)] = actual THEN 'lagging' ELSE 'inconsistent' END AS kind,
       CAST(len(expected) AS INTEGER) AS expected_n, CAST(len(actual) AS INTEGER) AS actual_n
FROM (SELECT entry_id, expected, CASE entry_id % 3 WHEN 0 THEN expected[1:1] WHEN 1 THEN ['someone'] ELSE expected END AS actual
      FROM (SELECT entry_id, list(actor ORDER BY seq) AS expected FROM ledger WHERE event_type = 'approved' GROUP BY entry_id))
"""


def ledger_health(spark, sf):
    e = V.ledger(spark, sf)
    return e.agg(F.max("seq").alias("latest_seq"), F.count("*").alias("events"), F.max_by("event_type", "seq").alias("last_type"))


def merkle_root(spark, sf):
    leaves = V.ledger(spark, sf).select("seq", F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "event_type", "note"), 256).alias("leaf"))
    return L.merkle_root(leaves, "seq", "leaf")


_MERKLE = """
WITH RECURSIVE ledger AS ({ledger}), leaves AS (SELECT list(sha256(seq || '|' || event_type || '|' || note) ORDER BY seq) AS l, count(*) AS n FROM ledger),
up AS (SELECT l, n FROM leaves UNION ALL SELECT list_transform(range(0, CAST((len(l) + 1) // 2 AS BIGINT)), lambda i: sha256(unhex(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1])))), n FROM up WHERE len(l) > 1)
SELECT l[1] AS root, n AS leaves FROM up WHERE len(l) = 1
"""


def span_tree(spark, sf):
    """Orders as roots, their lines as children of the line before."""
    line = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    spans = line.select(
        F.col("l_orderkey").alias("trace_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("span_id"),
        F.when(F.col("l_linenumber") > 1, F.concat_ws("-", F.col("l_orderkey").cast("string"), (F.col("l_linenumber") - 1).cast("string"))).alias("parent_span_id"),
    ).distinct()
    return L.span_tree(spans)


_SPANS = """
WITH RECURSIVE spans AS (SELECT DISTINCT l_orderkey AS trace_id, l_orderkey || '-' || l_linenumber AS span_id, CASE WHEN l_linenumber > 1 THEN l_orderkey || '-' || (l_linenumber - 1) END AS parent FROM lineitem),
tree AS (SELECT trace_id, span_id, 0 AS depth, span_id AS root FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent)
  UNION ALL SELECT s.trace_id, s.span_id, depth + 1, root FROM tree t JOIN spans s ON s.trace_id = t.trace_id AND s.parent = t.span_id)
SELECT * FROM tree
"""


def telemetry_p95(spark, sf):
    e = V.table(spark, sf, "events").select("event_type", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("v"))
    return L.timer_stats(e, "event_type", "event_id", "v").select("event_type", "n", q6(F.col("mean")).alias("mean"), "p95", "max")


_P95 = f"""
WITH r AS (SELECT event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS rank, CAST(count(*) OVER (PARTITION BY event_type) AS BIGINT) AS n FROM r WHERE back <= 256)
SELECT event_type, n, {sql6('avg(v)')} AS mean, max(v) FILTER (WHERE rank = greatest(1, CAST(round_even(n * 0.95::DOUBLE, 0) AS INTEGER))) AS p95, max(v) AS max FROM k GROUP BY event_type, n
"""


def _snapshot(spark, sf, early: bool):
    e = V.table(spark, sf, "events").filter(F.pmod("event_id", F.lit(2)) == (0 if early else 1))
    e = e.filter(F.col("user_id") % 7 != (3 if early else 4))
    return e.groupBy((F.col("user_id") % 7).alias("name")).agg(F.count("*").alias("v"))


def snapshot_diff(spark, sf):
    """Counters that one of two snapshots adds or changes."""
    a = _snapshot(spark, sf, True).withColumnRenamed("v", "a")
    b = _snapshot(spark, sf, False).withColumnRenamed("v", "b")
    both = a.join(b, "name", "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("name", "kind", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))


_SNAPS = """
WITH a AS (SELECT user_id % 7 AS name, count(*) AS a FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 3 GROUP BY 1), b AS (SELECT user_id % 7 AS name, count(*) AS b FROM events WHERE event_id % 2 = 1 AND user_id % 7 <> 4 GROUP BY 1)
SELECT name, kind, delta FROM (SELECT coalesce(a.name, b.name) AS name, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'gone' WHEN a <> b THEN 'changed' END AS kind, coalesce(b, 0) - coalesce(a, 0) AS delta
  FROM a FULL OUTER JOIN b ON a.name = b.name) WHERE kind IS NOT NULL
"""


def prometheus_text(spark, sf):
    """Counters and timers as exposition lines."""
    counts = V.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    lines = counts.select(F.concat(T.metric_name(F.concat(F.lit("event."), F.col("event_type"))), F.lit("_total "), F.col("n").cast("string")).alias("line"))
    timers = L.timer_stats(V.table(spark, sf, "events").select("event_type", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("v")), "event_type", "event_id", "v")
    name = T.metric_name(F.concat(F.lit("timer."), F.col("event_type")))
    gauges = timers.select(F.explode(F.array(F.concat(name, F.lit("_count "), F.col("n").cast("string")), F.concat(name, F.lit("_avg "), (F.floor(F.col("mean") * 1000 + 0.5) / 1000).cast("decimal(20,3)").cast("string")), F.concat(name, F.lit("_p95 "), F.col("p95").cast("string")), F.concat(name, F.lit("_max "), F.col("max").cast("string")))).alias("line"))
    return lines.unionByName(gauges).orderBy("line")


_PROM = f"""
WITH t AS ({_P95})
SELECT 'event_' || regexp_replace(event_type, '[^a-zA-Z0-9_:]', '_', 'g') || '_total ' || count(*) AS line FROM events GROUP BY event_type
UNION ALL SELECT unnest(['timer_' || event_type || '_count ' || n, 'timer_' || event_type || '_avg ' || CAST(floor(mean * 1000 + 0.5) / 1000 AS DECIMAL(20, 3)), 'timer_' || event_type || '_p95 ' || p95, 'timer_' || event_type || '_max ' || max]) FROM t
"""


def site_need_review(spark, sf):
    """Groups to review, with the site that leads each."""
    sites = D.assess(D.ensemble(V.image_score(spark, sf), {"click": 2, "purchase": 3})).withColumn("name", F.pmod("site", F.lit(20)))
    rank = D.rank_of(F.col("verdict"))
    led = sites.groupBy("name").agg(F.max(rank).alias("severity"), F.max("agg").alias("agg"), F.max_by("site", F.struct(rank, "agg", -F.col("site"))).alias("lead"))
    return led.filter((F.col("severity") >= 1) | (F.col("agg") >= 0.5)).select("name", "severity", q6(F.col("agg")).alias("agg"), "lead")


_NEED = f"""
SELECT site % 20 AS name, CAST(max(r) AS INTEGER) AS severity, {sql6('max(agg)')} AS agg, arg_max(site, (r, agg, -site)) AS lead
FROM (SELECT *, CASE verdict WHEN 'nsfw' THEN 2 WHEN 'suspect' THEN 1 ELSE 0 END AS r FROM assessed) GROUP BY site % 20 HAVING max(r) >= 1 OR max(agg) >= 0.5
"""


def rate_limit(spark, sf, per_day: int = 3, gap_hours: int = 6):
    """Per site whether one more entry is allowed after the last: day's count and gap."""
    e = V.entries(spark, sf).withColumn("day", F.to_date("created_at"))
    last = e.groupBy("site").agg(F.max("created_at").alias("last"), F.max("day").alias("day"))
    same = e.join(last.select("site", F.col("day").alias("last_day")), "site").filter(F.col("day") == F.col("last_day")).groupBy("site").agg(F.count("*").alias("today"))
    hours = (F.unix_timestamp(F.lit("2001-08-01 12:00:00").cast("timestamp")) - F.unix_timestamp("last")) / F.lit(3600.0)
    reason = F.when((F.col("today") >= per_day) & (F.col("day") == F.to_date(F.lit("2001-08-01"))), "day").when(hours < gap_hours, "gap").otherwise("ok")
    return last.join(same, "site").select("site", "today", reason.alias("reason"))


QUERIES = {
    "queue_status_counts": (queue_status_counts, with_views("SELECT s.status, count(e.id) AS n FROM (VALUES ('pending'), ('approved'), ('rejected'), ('submitted')) s(status) LEFT JOIN entries e ON s.status = e.status GROUP BY s.status", "ENTRIES")),
    "batch_pivot": (batch_pivot, with_views("SELECT id % 40 AS batch_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES) + " FROM entries GROUP BY 1", "ENTRIES")),
    "queue_page": (queue_page, with_views("SELECT id, site, verdict FROM entries WHERE status = 'pending' ORDER BY id LIMIT 50 OFFSET 100", "ENTRIES")),
    "latest_of_site": (latest_of_site, "SELECT o_custkey AS site, max(o_orderkey) AS last_id FROM orders GROUP BY o_custkey"),
    "daily_trend": (daily_trend, with_views("SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES) + ", count(*) AS total FROM entries GROUP BY 1", "ENTRIES")),
    "reconcile_human_machine": (reconcile_human_machine, with_views("SELECT count(*) FILTER (WHERE status IN ('approved', 'submitted')) AS confirmed, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'rejected' AND (verdict = 'nsfw' OR agg4 >= 9000)) AS fp_candidates, count(*) FILTER (WHERE contains(note, '组')) AS noted, count(*) FILTER (WHERE agg4 < 0) AS no_score FROM entries", "ENTRIES")),
    "cost_by_model": (cost_by_model, _cost("model", "(未知模型)")),
    "cost_by_run": (cost_by_run, _cost("run_id", "(未标记批次)")),
    "cost_by_day": (cost_by_day, _cost("day", "(未知日期)")),
    "budget_status": (budget_status, with_views("SELECT run_id, CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS spent, coalesce(sum(cost_cents), 0) > 200000 AS over FROM cost_rows GROUP BY run_id", "COST_ROWS")),
    "case_groups": (case_groups, _on_groups("SELECT * FROM groups")),
    "group_stats": (group_stats, _on_groups("SELECT count(*) AS groups, count(*) FILTER (WHERE hosts >= 2) AS multi_site, count(*) FILTER (WHERE hosts < 2) AS single_site, CAST(sum(urls) AS BIGINT) AS urls, count(*) FILTER (WHERE verdict = 'clean') AS clean, count(*) FILTER (WHERE verdict = 'suspect') AS suspect, count(*) FILTER (WHERE verdict = 'nsfw') AS nsfw FROM groups")),
    "group_stats_top5": (group_stats_top5, _on_groups('SELECT "group", urls, agg4 FROM groups ORDER BY urls DESC, agg4 DESC, "group" LIMIT 5')),
    "repeat_offenders": (repeat_offenders, _on_groups('SELECT raw, key, min(id) AS id, max(urls) AS urls FROM grouped JOIN (SELECT "group" AS key, urls FROM groups WHERE urls >= 2) USING (key) WHERE status = \'rejected\' AND key <> \'\' GROUP BY raw, key')),
    "group_rows": (group_rows, with_views("SELECT name, entries, agg, name IN (SELECT 'g' || (n_nationkey % 7) FROM nation WHERE n_nationkey % 2 = 0) AS attested FROM (SELECT regexp_extract(note, '组:([^\\]]*)', 1) AS name, count(*) AS entries, floor(max(agg4) / 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS agg FROM entries WHERE note IS NOT NULL GROUP BY 1)", "ENTRIES")),
    "ready_entries": (ready_entries, with_views("SELECT id, name FROM (SELECT id, regexp_extract(note, '组:([^\\]]*)', 1) AS name FROM entries WHERE status = 'approved' AND note IS NOT NULL) WHERE name IN (SELECT 'g' || (n_nationkey % 7) FROM nation WHERE n_nationkey % 2 = 0) ORDER BY id LIMIT 20", "ENTRIES")),
    "resume_pending": (resume_pending, with_views("SELECT DISTINCT site FROM entries WHERE site NOT IN (SELECT site FROM entries WHERE status = 'submitted')", "ENTRIES")),
    "dedup_first_seen": (dedup_first_seen, "SELECT o_custkey AS site, min(o_orderkey) AS id, arg_min(o_orderstatus, o_orderkey) AS flag FROM orders GROUP BY o_custkey"),
    "session_groups": (session_groups, with_views(_SESSIONS, "IMAGE_SCORE")),
    "ledger_projection": (ledger_projection, _on_ledger("SELECT * FROM projected")),
    "ledger_reconcile": (ledger_reconcile, _on_ledger("SELECT * FROM diffs")),
    "heal_plan": (heal_plan, _on_ledger("SELECT entry_id, CAST(i - 1 AS INTEGER) AS step, path[i] AS to_status FROM (SELECT entry_id, CASE WHEN actual_status = 'pending' AND expected_status = 'submitted' THEN ['approved', 'submitted'] ELSE [expected_status] END AS path FROM diffs WHERE kind = '事件超前' AND actual_status IS NOT NULL), range(1, 3) r(i) WHERE i <= len(path)")),
    "illegal_transitions": (illegal_transitions, _on_ledger(f"SELECT entry_id, seq, from_status, to_status FROM (SELECT *, lag(to_status) OVER (PARTITION BY entry_id ORDER BY seq) AS from_status FROM (SELECT *, {_STATUS} AS to_status FROM ledger) WHERE to_status IS NOT NULL) WHERE from_status IS NOT NULL AND NOT ((from_status = 'pending' AND to_status IN ('approved', 'rejected')) OR (from_status = 'approved' AND to_status = 'submitted'))")),
    "approvals_reconcile": (approvals_reconcile, _on_ledger(_APPROVALS)),
    "ledger_health": (ledger_health, _on_ledger("SELECT max(seq) AS latest_seq, count(*) AS events, arg_max(event_type, seq) AS last_type FROM ledger")),
    "merkle_root": (merkle_root, _MERKLE.replace("{ledger}", LEDGER)),
    "span_tree": (span_tree, _SPANS),
    "telemetry_p95": (telemetry_p95, _P95),
    "snapshot_diff": (snapshot_diff, _SNAPS),
    "prometheus_text": (prometheus_text, _PROM),
    "site_need_review": (site_need_review, with_views(_NEED, "IMAGE_SCORE", ensemble=_ENSEMBLE, assessed=_ASSESS)),
    "rate_limit": (rate_limit, with_views("SELECT l.site, today, CASE WHEN today >= 3 AND day = DATE '2001-08-01' THEN 'day' WHEN (epoch(TIMESTAMP '2001-08-01 12:00:00') - epoch(last)) / 3600.0 < 6 THEN 'gap' ELSE 'ok' END AS reason FROM (SELECT site, max(created_at) AS last, max(CAST(created_at AS DATE)) AS day FROM entries GROUP BY site) l JOIN (SELECT e.site, count(*) AS today FROM entries e JOIN (SELECT site, max(CAST(created_at AS DATE)) AS d FROM entries GROUP BY site) x ON e.site = x.site AND CAST(e.created_at AS DATE) = x.d GROUP BY e.site) t ON l.site = t.site", "ENTRIES")),
}
