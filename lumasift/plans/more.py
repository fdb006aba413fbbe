"""Further queries: lookups, planning, numeric functions, evaluation of guards and hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumasift.functions import mathx as M
from lumasift.functions import model_output as O
from lumasift.functions import text as T
from lumasift.functions import url as U
from lumasift.operators import decision as D
from lumasift.operators import ledger as L
from lumasift.operators import sequential as S
from lumasift.operators.meetings import shared_media
from lumasift.plans.decision import q6, sql6
from lumasift.plans.stats import _BINS
from lumasift.plans.sql_views import with_views
from lumasift.plans.urls_text import _HOSTED, _KEYED
from lumasift.sources import views as V


def ledger_query(spark, sf):
    """Approvals from the second conversation on, in order."""
    return L.query(V.ledger(spark, sf), event_type="approved", seq_from=1000).select("seq", "entry_id", "actor")


def journal_counts(spark, sf):
    kind = F.when(F.col("status") == "submitted", "done").when(F.col("status") == "rejected", "failed").otherwise("other")
    return V.entries(spark, sf).groupBy(F.pmod("id", F.lit(6)).alias("batch_id")).agg(*[F.count(F.when(kind == k, 1)).alias(k) for k in ("done", "failed", "other")])


def cache_stats(spark, sf):
    """Live and expired rows by model, whole days since writing against 30."""
    rows = V.cost_rows(spark, sf)
    age = F.datediff(F.lit("2001-06-01").cast("date"), F.col("day"))
    return rows.groupBy("model").agg(F.count("*").alias("rows"), F.count(F.when(age < 30, 1)).alias("live"), F.count(F.when(age >= 30, 1)).alias("expired"))


def labelled_stats(spark, sf):
    return V.labelled(spark, sf).groupBy("source_kind").agg(F.count("*").alias("rows"), F.sum("label").alias("positive"), F.count(F.when(F.col("p4") == 0, 1)).alias("pending"))


def decision_candidates(spark, sf):
    e = V.image_score(spark, sf)
    return e.filter((F.col("width") >= 200) | (F.col("height") >= 200)).groupBy("site").agg(F.count("*").alias("candidates"), F.count_distinct("path").alias("images"))


def run_rows(spark, sf):
    """One row per run: calls by provider as a line, unmarked runs left out."""
    c = V.cost_rows(spark, sf).filter(F.col("run_id").isNotNull()).groupBy("run_id", "provider").agg(F.count("*").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("provider", "n"))), lambda x: F.concat(x["provider"], F.lit(":"), x["n"].cast("string"))), " ")
    return c.groupBy("run_id").agg(F.sum("n").alias("calls"), line.alias("dist"))


def calibrated_probs(spark, sf):
    p = F.col("p4") / F.lit(10000.0)
    return V.image_score(spark, sf).select("seq", q6(M.calibrated(p)).alias("p"))


_X = "p4 / 10000.0::DOUBLE"
_CALIBRATED = "CASE " + " ".join(f"WHEN x <= {x1}::DOUBLE THEN {y0}::DOUBLE + (x - {x0}::DOUBLE) * {y1 - y0!r}::DOUBLE / {x1 - x0!r}::DOUBLE" for (x0, y0), (x1, y1) in zip(M.ANCHORS, M.ANCHORS[1:])) + " END"


def significant_digits(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.significant(F.col("l_extendedprice") / F.lit(7.0), 12).alias("x"))


def matmul_counts(spark, sf):
    """Event types by users times users by types: co-occurrence counts."""
    e = V.table(spark, sf, "events").select(F.pmod("user_id", F.lit(30)).alias("u"), F.length("event_type").alias("t"))
    a = e.groupBy(F.col("t").alias("i"), F.col("u").alias("j")).agg(F.count("*").alias("v"))
    b = e.groupBy(F.col("u").alias("i"), F.col("t").alias("j")).agg(F.count("*").alias("v"))
    return M.matmul(a, b)


def trapezoid_auc(spark, sf):
    """Area below each model's mean probability over ten steps."""
    e = V.image_score(spark, sf).withColumn("x", F.pmod("seq", F.lit(10)))
    curve = e.groupBy("model", "x").agg((F.sum("p4") / F.count("*")).alias("y"))
    w = Window.partitionBy("model").orderBy("x")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    steps = curve.withColumn("part", (nx - F.col("x")) * (F.col("y") + ny) / F.lit(2.0))
    return steps.groupBy("model").agg(q6(F.sum("part") / F.lit(10000.0)).alias("area"))


def next_runs(spark, sf):
    """When each site is due: its last entry and an interval from its volatility."""
    e = V.entries(spark, sf)
    v = S.volatility(e, "site", "id", "verdict")
    last = e.groupBy("site").agg(F.max("created_at").alias("last"))
    hours = S.interval_hours(F.col("volatility"), F.col("n"))
    due = F.col("last") + F.make_interval(hours=hours.cast("int"))
    return v.join(last, "site").select("site", F.date_format(due, "yyyy-MM-dd HH:mm").alias("due"))


def scan_plan(spark, sf):
    """What becomes of each page: scanned, a repeat of its key, or unchanged since the fingerprint that is known of its key.

    Known is the number of links of each key's last page.
    """
    pages = V.table(spark, sf, "pages").select("page_id", "url", U.canonical_key(F.col("url")).alias("key"), F.size(T.hrefs(F.col("html"))).alias("print"))
    known = pages.groupBy("key").agg(F.max_by("print", "page_id").alias("print"))
    return D.scan_plan(pages.withColumnRenamed("page_id", "pos"), known).select(F.col("pos").alias("page_id"), "url", "decision")


_PLAN = """
, p AS (SELECT page_id, url, coalesce(key, '') AS key, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']*)["'']')) AS print FROM keyed),
q AS (SELECT *, CASE WHEN key <> '' THEN key ELSE url END AS site FROM p), k AS (SELECT key, arg_max(print, page_id) AS print FROM p GROUP BY key), f AS (SELECT site, min(page_id) AS first FROM q GROUP BY site)
SELECT page_id, url, CASE WHEN page_id <> first THEN 'duplicate' WHEN q.key <> '' AND q.print = k.print THEN 'unchanged' ELSE 'scan' END AS decision FROM q JOIN f ON q.site = f.site LEFT JOIN k ON q.key = k.key
"""


def _hour_edges(spark, sf):
    """Edges of customers by order: kind and hour."""
    kind = F.element_at(F.array(*map(F.lit, ("phash_near", "redirect", "shared_image"))), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return V.table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_orderkey") * 31, F.lit(1000)).alias("dst"), kind.alias("kind"), F.col("o_orderdate").alias("created_at"))


def edge_hours(spark, sf):
    """Hours of the near and redirect edges at each site, either end."""
    return S.edge_hours(_hour_edges(spark, sf)).groupBy("site").agg(F.count("*").alias("edges"), F.min("t").alias("first"), F.max("t").alias("last"))


def dynamic_ttl(spark, sf):
    """Rescan times of sites with bursts of such edges; sites without keep theirs."""
    hours = S.edge_hours(_hour_edges(spark, sf))
    now = hours.agg(F.max("t")).first()[0]
    return S.dynamic_ttl(hours, now, 72.0).select("site", q6(F.col("hours")).alias("hours"))


def guard_calibration(spark, sf):
    """Per family of guards its confusion, and smoothed shares of hits."""
    rows = V.labelled(spark, sf).withColumn("family", F.pmod("doc_id", F.lit(4))).withColumn("hit", F.when(F.col("p4") >= 6000, 1).otherwise(0))
    cell = lambda h, y: F.count(F.when((F.col("hit") == h) & (F.col("label") == y), 1))
    c = rows.groupBy("family").agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    return c.select("*", q6((F.col("tp") + 1) / (F.col("tp") + F.col("fn") + 2)).alias("p_unsafe"), q6((F.col("fp") + 1) / (F.col("fp") + F.col("tn") + 2)).alias("p_safe"))


def conformal_bounds(spark, sf):
    """Lower bounds of precision at each score, to choose a threshold by."""
    c = S.suffix_counts(V.labelled(spark, sf), "p4", "label")
    return c.select("p4", "selected", "hits", q6(M.exact_lower(F.col("hits"), F.col("selected"), 0.05)).alias("lower"))


def bootstrap_means(spark, sf):
    """Percentile intervals of resampled means; tests compare them with the normal ones."""
    b = M.bootstrap_mean(V.image_score(spark, sf).select("model", "p4"), "model", "p4")
    return b.select("model", *[q6(F.col(c)).alias(c) for c in ("mean", "lo", "hi")])


def permutation_tests(spark, sf):
    """Whether scores of large and small images of a path differ: sign flips of the mean difference."""
    e = V.image_score(spark, sf)
    d = e.groupBy("model", "path").agg((F.avg(F.when(F.col("width") >= 200, F.col("p4"))) - F.avg(F.when(F.col("width") < 200, F.col("p4")))).alias("d")).filter(F.col("d").isNotNull())
    p = M.sign_flip_test(d.select("model", F.floor(F.col("d") + 0.5).cast("long").alias("d")), "model", "d")
    return p.select("model", "n", q6(F.col("mean")).alias("mean"), q6(F.col("p")).alias("p"))


def _answers(spark, sf):
    """Answers of five shapes, as models give them, about each document."""
    docs = V.table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    k, p = F.pmod("doc_id", F.lit(5)), (F.pmod("n_chars", F.lit(1500)) / F.lit(1000.0)).cast("string")
    cats = F.element_at(F.array(F.lit('"a", "z"'), F.lit('"b"'), F.lit("")), (F.pmod("n_chars", F.lit(3)) + 1).cast("int"))
    level = F.element_at(F.array(*map(F.lit, ("low", "high", "odd"))), (F.pmod("n_chars", F.lit(7)) % 3 + 1).cast("int"))
    text = (
        F.when(k == 0, F.concat(F.lit('```json\n{"nsfw_prob": '), p, F.lit(', "confidence": "'), level, F.lit('", "categories": ['), cats, F.lit("],}\n```")))
        .when(k == 1, F.concat(F.lit("{'nsfw_prob': "), p, F.lit(", 'confidence': '"), level, F.lit("', 'categories': None}")))
        .when(k == 2, F.concat(F.lit('says “x”: {"nsfw_prob": '), p, F.lit(', "confidence": "'), level, F.lit('", "note": "{"} done')))
        .when(k == 3, F.concat(F.lit('{"confidence": "'), level, F.lit('", "categories": ['), cats, F.lit("]}")))
        .otherwise(F.concat(F.lit("no answer {"), p))
    )
    return docs.select("doc_id", F.col("lang").alias("provider"), text.alias("text"))


def parsed_answers(spark, sf):
    """How model answers of several shapes are mended and checked."""
    made = _answers(spark, sf).select("doc_id", O.mended_json(F.col("text")).alias("m")).select("doc_id", "m.mends", O.checked(F.col("m.json"), ["a", "b"]).alias("c"))
    return made.select("doc_id", "mends", "c.prob", F.concat_ws(",", "c.categories").alias("categories"), F.coalesce("c.valid", F.lit(False)).alias("valid"))


_ANSWERS = """
SELECT doc_id, lang AS provider, CAST([2, 2, 0, 0, -1][doc_id % 5 + 1] AS INTEGER) AS mends, CASE WHEN doc_id % 5 < 3 THEN least(1.0::DOUBLE, CAST((n_chars % 1500) / 1000.0::DOUBLE AS DOUBLE)) END AS prob,
  CASE WHEN doc_id % 5 IN (0, 3) THEN ['a', 'b', ''][n_chars % 3 + 1] ELSE '' END AS categories, doc_id % 5 < 3 AND (n_chars % 7) % 3 < 2 AS valid FROM documents
"""


def provider_parsing(spark, sf):
    """Per provider: answers parsed, of a valid schema, and mean mendings of those parsed."""
    made = _answers(spark, sf).select("provider", O.mended_json(F.col("text")).alias("m")).select("provider", "m.mends", O.checked(F.col("m.json"), ["a", "b"]).alias("c"))
    parsed = F.col("mends") >= 0
    return made.groupBy("provider").agg(F.count("*").alias("n"), q6(F.count(F.when(parsed, 1)) / F.count("*")).alias("parse_rate"), q6(F.count(F.when(F.col("c.valid"), 1)) / F.count("*")).alias("schema_rate"), q6(F.avg(F.when(parsed, F.col("mends")))).alias("mends"))


def _shown_names(spark, sf):
    part = V.table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.repeat(F.lit("举报"), F.pmod("p_size", F.lit(4)).cast("int")), F.col("p_name"), F.lit("（"), F.col("p_brand"), F.lit("）")).alias("s"))


def display_width(spark, sf):
    """Columns that a terminal needs: wide characters count two."""
    return _shown_names(spark, sf).select("id", T.display_width(F.col("s")).alias("width"))


def display_truncated(spark, sf):
    """Names cut to twenty columns, with an ellipsis of one."""
    return _shown_names(spark, sf).select("id", T.truncated(F.col("s"), 20).alias("s"))


_NAMES = "SELECT p_partkey AS id, repeat('举报', CAST(p_size % 4 AS BIGINT)) || p_name || '（' || p_brand || '）' AS s FROM part"
_WIDE = f"list_transform(string_split(s, ''), lambda c: CASE WHEN regexp_matches(c, '[{T.WIDE}]') THEN 2 ELSE 1 END)"


def graph_export(spark, sf):
    """Edges in a fixed order as JSON lines."""
    e = shared_media(V.media(spark, sf)).select("a", "b", "shared")
    return e.orderBy("a", "b").select(F.to_json(F.struct("a", "b", "shared")).alias("line"))


def _attacks(spark, sf):
    """Scores of each image under five kinds of change at three strengths."""
    e = V.image_score(spark, sf).select("site", "path", "seq", "p4")
    grid = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("strength")) for k in range(5) for x in (1, 2, 3)])
    hit = F.pmod(F.col("seq") * (F.col("kind") + 3), F.lit(700)) * F.col("strength") + 150 * F.col("kind")
    return e.withColumn("g", F.explode(grid)).select("seq", "p4", "g.kind", "g.strength").withColumn("q4", F.greatest(F.lit(0), F.col("p4") - hit))


def perturbation_stats(spark, sf):
    """Mean drop and flips of altered scores by kind and strength."""
    return _attacks(spark, sf).groupBy("kind", "strength").agg(F.count("*").alias("n"), q6(F.avg((F.col("p4") - F.col("q4")) / F.lit(10000.0))).alias("drop"), F.count(F.when((F.col("p4") >= 5000) & (F.col("q4") < 5000), 1)).alias("flips"))


def least_attacks(spark, sf):
    """Per kind how many images the least strength flips that flips them at all."""
    flipped = _attacks(spark, sf).filter((F.col("p4") >= 5000) & (F.col("q4") < 5000)).groupBy("kind", "seq").agg(F.min("strength").alias("strength"))
    return flipped.groupBy("kind", "strength").agg(F.count("*").alias("images"))


_ATTACKS = "SELECT seq, p4, kind, strength, greatest(0, p4 - ((seq * (kind + 3)) % 700) * strength - 150 * kind) AS q4 FROM image_score, range(0, 5) k(kind), range(1, 4) x(strength)"


def kernel_gate(spark, sf):
    """Whether labelled rows allow automatic stops: five conditions, and the digest that an approval binds to."""
    return D.kernel_gate(V.labelled(spark, sf))


_GATE = """
WITH bins AS ({bins}), one AS (SELECT CAST(sum(label) AS BIGINT) AS pos, count(*) FILTER (WHERE label = 0) AS neg, floor(avg((p4 / 10000.0::DOUBLE - label) * (p4 / 10000.0::DOUBLE - label)) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS brier, count(*) FILTER (WHERE p4 < 9000 AND label = 1) AS fn, count(*) FILTER (WHERE p4 >= 5000 AND label = 0) AS fp FROM labelled),
ece AS (SELECT floor(sum(n * abs(avg_prob - freq)) / sum(n) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS ece FROM bins),
d AS (SELECT *, CAST(floor(brier * 10000 + 0.5) AS BIGINT) AS b4, CAST(floor(ece * 10000 + 0.5) AS BIGINT) AS e4 FROM one, ece)
SELECT unnest(['enough', 'ece', 'brier', 'fn', 'fp']) AS rule, unnest([pos >= 20 AND neg >= 20, ece <= 0.1::DOUBLE, brier <= 0.2::DOUBLE, fn <= 0.1::DOUBLE * pos, fp <= 0.1::DOUBLE * neg]) AS holds,
  sha256('{"brier":' || b4 || ',"ece":' || e4 || ',"fn":' || fn || ',"fp":' || fp || ',"neg":' || neg || ',"pos":' || pos || '}') AS digest FROM d
"""


QUERIES = {
    "ledger_query": (ledger_query, with_views("SELECT seq, entry_id, actor FROM ledger WHERE seq >= 1000 AND event_type = 'approved'", "LEDGER")),
    "journal_counts": (journal_counts, with_views("SELECT id % 6 AS batch_id, count(*) FILTER (WHERE status = 'submitted') AS done, count(*) FILTER (WHERE status = 'rejected') AS failed, count(*) FILTER (WHERE status IN ('pending', 'approved')) AS other FROM entries GROUP BY 1", "ENTRIES")),
    "cache_stats": (cache_stats, with_views("SELECT model, count(*) AS rows, count(*) FILTER (WHERE date_diff('day', day, DATE '2001-06-01') < 30) AS live, count(*) FILTER (WHERE date_diff('day', day, DATE '2001-06-01') >= 30) AS expired FROM cost_rows GROUP BY model", "COST_ROWS")),
    "labelled_stats": (labelled_stats, with_views("SELECT source_kind, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positive, count(*) FILTER (WHERE p4 = 0) AS pending FROM labelled GROUP BY source_kind", "LABELLED")),
    "decision_candidates": (decision_candidates, with_views("SELECT site, count(*) AS candidates, count(DISTINCT path) AS images FROM image_score WHERE width >= 200 OR height >= 200 GROUP BY site", "IMAGE_SCORE")),
    "run_rows": (run_rows, with_views("SELECT run_id, CAST(sum(n) AS BIGINT) AS calls, string_agg(provider || ':' || n, ' ' ORDER BY provider) AS dist FROM (SELECT run_id, provider, count(*) AS n FROM cost_rows WHERE run_id IS NOT NULL GROUP BY ALL) GROUP BY run_id", "COST_ROWS")),
    "calibrated_probs": (calibrated_probs, with_views(f"SELECT seq, {sql6(_CALIBRATED)} AS p FROM (SELECT seq, {_X} AS x FROM image_score)", "IMAGE_SCORE")),
    "significant_digits": (significant_digits, "SELECT l_orderkey, l_linenumber, CAST(printf('%.12g', l_extendedprice / 7.0::DOUBLE) AS DOUBLE) AS x FROM lineitem"),
    "matmul_counts": (matmul_counts, "WITH e AS (SELECT user_id % 30 AS u, CAST(length(event_type) AS INTEGER) AS t, count(*) AS v FROM events GROUP BY 1, 2) SELECT a.t AS i, b.t AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM e a JOIN e b ON a.u = b.u GROUP BY 1, 2"),
    "trapezoid_auc": (trapezoid_auc, with_views(f"SELECT model, {sql6('sum((nx - x) * (y + ny) / 2.0::DOUBLE) / 10000.0::DOUBLE')} AS area FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM (SELECT model, seq % 10 AS x, sum(p4)::DOUBLE / count(*) AS y FROM image_score GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY x)) GROUP BY model", "IMAGE_SCORE")),
    "next_runs": (next_runs, with_views("SELECT site, strftime(last + to_hours(CASE WHEN v >= 0.5 THEN 24 WHEN v <= 0.1 AND n >= 3 THEN 96 ELSE 48 END), '%Y-%m-%d %H:%M') AS due FROM (SELECT site, max(created_at) AS last, count(*) AS n, coalesce(sum(CASE WHEN verdict <> prev THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*) - 1, 0), 0) AS v FROM (SELECT *, lag(verdict) OVER (PARTITION BY site ORDER BY id) AS prev FROM entries) GROUP BY site)", "ENTRIES")),
    "scan_plan": (scan_plan, with_views("", hosted=_HOSTED, keyed=_KEYED).strip() + _PLAN),
    "edge_hours": (edge_hours, "SELECT site, count(*) AS edges, min(t) AS first, max(t) AS last FROM (SELECT unnest([o_custkey, o_orderkey * 31 % 1000]) AS site, epoch(o_orderdate) / 3600.0::DOUBLE AS t FROM orders WHERE o_orderkey % 3 < 2) GROUP BY site"),
    "dynamic_ttl": (dynamic_ttl, None),
    "guard_calibration": (guard_calibration, with_views(f"SELECT family, tp, fp, fn, tn, {sql6('(tp + 1)::DOUBLE / (tp + fn + 2)')} AS p_unsafe, {sql6('(fp + 1)::DOUBLE / (fp + tn + 2)')} AS p_safe FROM (SELECT doc_id % 4 AS family, count(*) FILTER (WHERE p4 >= 6000 AND label = 1) AS tp, count(*) FILTER (WHERE p4 >= 6000 AND label = 0) AS fp, count(*) FILTER (WHERE p4 < 6000 AND label = 1) AS fn, count(*) FILTER (WHERE p4 < 6000 AND label = 0) AS tn FROM labelled GROUP BY 1)", "LABELLED")),
    "conformal_bounds": (conformal_bounds, None),
    "bootstrap_means": (bootstrap_means, None),
    "permutation_tests": (permutation_tests, None),
    "parsed_answers": (parsed_answers, f"SELECT doc_id, mends, prob, categories, valid FROM ({_ANSWERS})"),
    "provider_parsing": (provider_parsing, f"SELECT provider, count(*) AS n, {sql6('count(*) FILTER (WHERE mends >= 0)::DOUBLE / count(*)')} AS parse_rate, {sql6('count(*) FILTER (WHERE valid)::DOUBLE / count(*)')} AS schema_rate, {sql6('avg(mends) FILTER (WHERE mends >= 0)')} AS mends FROM ({_ANSWERS}) GROUP BY provider"),
    "display_width": (display_width, f"SELECT id, CAST(list_sum({_WIDE}) AS BIGINT) AS width FROM ({_NAMES})"),
    "display_truncated": (display_truncated, f"SELECT id, CASE WHEN list_sum(w) <= 20 THEN s ELSE substr(s, 1, CAST(len(list_filter(list_transform(range(1, len(w) + 1), lambda i: list_sum(w[1:i])), lambda x: x <= 19)) AS BIGINT)) || '…' END AS s FROM (SELECT id, s, {_WIDE} AS w FROM ({_NAMES}))"),
    "graph_export": (graph_export, with_views("SELECT '{\"a\":' || x.site || ',\"b\":' || y.site || ',\"shared\":' || count(*) || '}' AS line FROM media x JOIN media y ON x.media = y.media AND x.site < y.site GROUP BY x.site, y.site", "MEDIA")),
    "perturbation_stats": (perturbation_stats, with_views(f"SELECT CAST(kind AS INTEGER) AS kind, CAST(strength AS INTEGER) AS strength, count(*) AS n, {sql6('avg((p4 - q4) / 10000.0::DOUBLE)')} AS drop, count(*) FILTER (WHERE p4 >= 5000 AND q4 < 5000) AS flips FROM ({_ATTACKS}) GROUP BY ALL", "IMAGE_SCORE")),
    "least_attacks": (least_attacks, with_views(f"SELECT CAST(kind AS INTEGER) AS kind, CAST(strength AS INTEGER) AS strength, count(*) AS images FROM (SELECT kind, seq, min(strength) AS strength FROM ({_ATTACKS}) WHERE p4 >= 5000 AND q4 < 5000 GROUP BY kind, seq) GROUP BY ALL", "IMAGE_SCORE")),
    "kernel_gate": (kernel_gate, with_views("", "LABELLED").strip() + ", " + _GATE.strip()[5:].replace("{bins}", _BINS)),
}
