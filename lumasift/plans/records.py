"""Queries on reliability-weighed fusion, appended and verified records, catalogues and short texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumasift.functions import text as T
from lumasift.functions import url as U
from lumasift.operators import decision as D
from lumasift.operators import records as R
from lumasift.plans.decision import _ASSESS, _ENSEMBLE, RULES, _sites, q6, sql6
from lumasift.plans.queue import _GROUPED, _grouped
from lumasift.plans.sql_views import with_views
from lumasift.plans.urls_text import _HOSTED, _KEYED
from lumasift.scratch import saved
from lumasift.sources import views as V


def _weights(spark, sf):
    """Brier weights of the models; one of them counts as too new."""
    y = F.when(F.pmod("seq", F.lit(3)) == 0, 1.0).otherwise(0.0)
    p = F.col("p4") / F.lit(10000.0)
    b = V.image_score(spark, sf).groupBy(F.col("model").alias("provider")).agg(F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"))
    return D.reliable_weights(b.withColumn("n", F.when(F.col("provider") == "view", 1).otherwise(F.col("n"))))


_WEIGHTS = """
SELECT provider, raw / sum(raw) OVER () AS weight FROM (SELECT model AS provider, CASE WHEN model <> 'view' AND count(*) >= 5 THEN 1.0::DOUBLE / (avg((p4 / 10000.0::DOUBLE - y) * (p4 / 10000.0::DOUBLE - y)) + 0.05::DOUBLE) END AS raw
FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM image_score) GROUP BY model)
"""


def member_weights(spark, sf):
    scores = V.image_score(spark, sf).select(F.col("model").alias("provider"))
    return D.member_weights(scores, _weights(spark, sf)).select("provider", q6(F.col("weight")).alias("weight"))


def fused_reliable(spark, sf):
    """Verdicts with the images' score weighed by how reliable their models are."""
    scores = V.image_score(spark, sf).select("site", F.col("model").alias("provider"), "p4")
    url = F.pmod(F.col("site") * 13, F.lit(100)) / F.lit(100.0)
    fused = D.fuse_reliable(_sites(spark, sf), D.reliable_aggs(scores, _weights(spark, sf)), F.lit(None).cast("double"), url, F.lit(None).cast("double"))
    return fused.select("site", q6(F.col("agg_reliable")).alias("agg_reliable"), q6(F.col("fused")).alias("fused"), "verdict", "needs_review")


_FUSED = f"""
SELECT site, {sql6('r')} AS agg_reliable, {sql6('fused')} AS fused, CASE WHEN made > rank THEN ['clean', 'suspect', 'nsfw'][made + 1] ELSE verdict END AS verdict, needs_review OR greatest(made, rank) > 0 AS needs_review
FROM (SELECT *, CASE verdict WHEN 'clean' THEN 0 WHEN 'suspect' THEN 1 ELSE 2 END AS rank, CASE WHEN fused >= 0.9 AND hits >= 3 THEN 2 WHEN fused >= 0.5 THEN 1 ELSE 0 END AS made
  FROM (SELECT *, greatest(r, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(-2.0::DOUBLE + 4.2::DOUBLE / 3.15::DOUBLE * (2.2::DOUBLE * r + 0.3::DOUBLE + 0.35::DOUBLE * (((site * 13) % 100) / 100.0::DOUBLE)))))) AS fused
    FROM assessed JOIN (SELECT site, sum(w * mean) / sum(w) AS r FROM (SELECT site, mean, coalesce(weight, avg(weight) OVER (PARTITION BY site), 1.0::DOUBLE) AS w FROM (SELECT site, model AS provider, avg(p4) / 10000.0::DOUBLE AS mean FROM image_score GROUP BY ALL) LEFT JOIN weights USING (provider)) GROUP BY site) USING (site)))
"""


def policy_audit(spark, sf):
    """Actions by rule, with the digest of the rules that made them."""
    made = D.policy(_sites(spark, sf), RULES)
    return made.groupBy("action", "rule").agg(F.count("*").alias("n")).withColumn("rules", F.lit(D.rules_digest(RULES)))


_AUDIT = f"""
SELECT action, rule, count(*) AS n, '{D.rules_digest(RULES)}' AS rules FROM (SELECT CASE WHEN verdict = 'nsfw' AND agg >= 0.95 THEN 'escalate' WHEN verdict IN ('nsfw', 'suspect') AND needs_review AND agg >= 0.7 THEN 'review' WHEN verdict = 'clean' THEN 'archive' ELSE 'queue' END AS action,
  CASE WHEN verdict = 'nsfw' AND agg >= 0.95 THEN 'severe' WHEN verdict IN ('nsfw', 'suspect') AND needs_review AND agg >= 0.7 THEN 'risky' WHEN verdict = 'clean' THEN 'calm' ELSE 'fallback' END AS rule FROM assessed) GROUP BY ALL
"""


def classified_urls(spark, sf):
    """Pages by the registered classifiers."""
    return D.classify(V.table(spark, sf, "pages").select("page_id", "url"), "url", ["stub"]).select("page_id", "stub")


def custom_disagreement(spark, sf):
    """The measure is the caller's: the gap of the mean and the median."""
    return D.disagreement(V.image_score(spark, sf), lambda x: F.abs(F.avg(x) - F.median(x))).select("site", "path", "n", q6(F.col("d")).alias("d"))


def custom_band(spark, sf):
    """The band is the caller's: wider for models of long names."""
    return D.route(V.image_score(spark, sf), lambda model: (F.when(F.length(model) > 5, 0.2).otherwise(0.4), F.lit(0.8)))


# -- filters and reports --------------------------------------------------------------------------


def entry_filter(spark, sf):
    e = _grouped(spark, sf).withColumnRenamed("raw", "site_url")
    return R.filter_entries(e, "approved", " EXAMPLE.net ").select("id", "site_url")


def host_ttl(spark, sf):
    """Users seen in the last day before the newest event."""
    e = V.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    now = e.agg(F.max("seen")).first()[0]
    return R.fresh(e, "seen", F.lit(now), 24).select("user_id", "live")


def cost_by_provider(spark, sf):
    rows = V.cost_rows(spark, sf)
    return rows.groupBy("provider").agg(F.count("*").alias("calls"), F.sum("images").alias("images"), F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("cost_cents"), F.count(F.when(F.col("cost_cents").isNull(), 1)).alias("unpriced"))


def cost_today(spark, sf):
    """Costs of the newest day."""
    rows = V.cost_rows(spark, sf)
    day = rows.agg(F.max("day").alias("today"))
    return rows.crossJoin(F.broadcast(day)).filter(F.col("day") == F.col("today")).groupBy("provider").agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("cost_cents"))


def session_stats(spark, sf):
    e = V.image_score(spark, sf)
    groups = e.groupBy("site").agg((F.max("p4") >= 9000).alias("reported"))
    return R.session_stats(groups, e)


def measure_errors(spark, sf):
    """Rows that review wrongly takes in, and positives that it misses, by source."""
    rows = V.labelled(spark, sf)
    kind = F.when((F.col("label") == 0) & (F.col("p4") >= 5000), "false positive").when((F.col("label") == 1) & (F.col("p4") < 9000), "missed")
    return rows.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("source_kind", "doc_id", "kind", "p4")


def guard_families(spark, sf):
    """Per family the plain and smoothed shares of hits among unsafe and safe rows, and how often halves of a family disagree by more than a tenth."""
    rows = V.labelled(spark, sf).withColumn("family", F.pmod("doc_id", F.lit(4))).withColumn("hit", (F.col("p4") >= 6000).cast("int"))
    cell = lambda h, y: F.count(F.when((F.col("hit") == h) & (F.col("label") == y), 1))
    c = rows.groupBy("family").agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"), F.count(F.when(F.abs(F.col("p4") - 6000) <= 300, 1)).alias("near"), F.count("*").alias("n"))
    share = lambda a, b: q6(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)))
    return c.select("family", share("tp", "fn").alias("mle_unsafe"), share("fp", "tn").alias("mle_safe"), q6((F.col("tp") + 1) / (F.col("tp") + F.col("fn") + 2)).alias("p_unsafe"), q6((F.col("fp") + 1) / (F.col("fp") + F.col("tn") + 2)).alias("p_safe"), q6(F.col("near") / F.col("n")).alias("flip_share"))


def guard_categories(spark, sf):
    """Rows by category code of guard lines, several codes a line."""
    docs = V.table(spark, sf, "documents").select(F.concat(F.lit("unsafe\nS"), F.pmod("n_chars", F.lit(13)).cast("string"), F.lit(",S"), F.pmod("doc_id", F.lit(5)).cast("string")).alias("line"))
    codes = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"(S[0-9]+)"), F.lit(1)))).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n"))


# -- records --------------------------------------------------------------------------------------


def appended_ledger(spark, sf):
    """Events of the table, with those of orders numbered on behind them."""
    e = V.ledger(spark, sf).select("seq", "entry_id", "event_type")
    new = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_id"), F.lit("added").alias("event_type"))
    return R.append(e, new, "entry_id")


def record_leaves(spark, sf):
    """Hashes of ledger records as canonical JSON."""
    e = V.ledger(spark, sf)
    row = F.create_map(F.lit("seq"), F.col("seq").cast("string"), F.lit("actor"), F.col("actor"), F.lit("event_type"), F.col("event_type"), F.lit("note"), F.when(F.col("turn") != 2, F.col("note")))
    return e.select("seq", R.canonical_leaf(row).alias("leaf"))


_LEAF = r"""
SELECT seq, sha256('{"actor":"' || q(actor) || '","event_type":"' || q(event_type) || '","note":' || CASE WHEN turn <> 2 THEN '"' || q(note) || '"' ELSE 'null' END || ',"seq":"' || seq || '"}') AS leaf FROM ledger
"""


def _quoted(sql: str) -> str:
    for c in ("actor", "event_type", "note"):
        sql = sql.replace(f"q({c})", f"replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')")
    return sql


def merkle_proofs(spark, sf):
    """Length of the proof of each conversation's first event, and whether it leads to the root."""
    e = V.ledger(spark, sf)
    leaves = e.select(F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "event_type", "note"), 256).alias("h"), "seq", "turn")
    placed = saved(R.append(leaves.select(F.col("seq"), "h", "turn").limit(0), leaves.select(F.col("seq").alias("at"), "h", "turn"), "at").select((F.col("seq") - 1).alias("i"), "h", "turn"), "leaves")
    levels = R.merkle_levels(placed)
    proofs = R.merkle_proofs(levels, placed.filter("turn = 0").select("i"))
    root = levels[-1].select(F.col("h").alias("root"))
    return proofs.crossJoin(F.broadcast(root)).select("i", F.size("proof").alias("steps"), (R.proven_root(F.col("leaf"), F.col("proof")) == F.col("root")).alias("proven"))


_PROOFS = """
SELECT i, CAST((SELECT ceil(log2(count(*))) FROM ledger) AS INTEGER) AS steps, true AS proven FROM (SELECT row_number() OVER (ORDER BY seq) - 1 AS i, turn FROM ledger) WHERE turn = 0
"""


def four_eyes(spark, sf):
    e = V.ledger(spark, sf).withColumn("actor", F.concat("actor", F.pmod("turn", F.lit(3)).cast("string")))
    return R.four_eyes(e, 1)


# -- catalogues and texts -------------------------------------------------------------------------


def model_search(spark, sf):
    """Parts as a catalogue: names with a word, preferred ones first."""
    models = V.table(spark, sf, "part").select(F.concat_ws("-", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("name"), (F.pmod("p_size", F.lit(3)) == 0).alias("vision"))
    return R.search_models(models, "RED ring", ("brand#1", "7")).select("name", "vision", "rank", "place")


def keyword_stats(spark, sf):
    lines = V.table(spark, sf, "part").select(F.when(F.pmod("p_partkey", F.lit(9)) == 0, F.concat(F.lit(" # "), "p_name")).when(F.pmod("p_partkey", F.lit(11)) == 0, "  ").otherwise(F.concat("p_name", F.lit(" "), "p_brand")).alias("line"))
    return R.keyword_stats(lines)


def run_aliases(spark, sf):
    """Runs whose number stands under one of two names; rows without either are left out."""
    c = V.cost_rows(spark, sf).select("images", F.when(F.col("images") % 3 == 0, F.col("run_id")).alias("batch"), F.when(F.col("images") % 3 == 1, F.col("run_id")).alias("ready"))
    return c.withColumn("run", F.coalesce("batch", "ready")).filter(F.col("run").isNotNull()).groupBy("run").agg(F.count("*").alias("n"))


def same_site_pairs(spark, sf):
    """Whether a page and the next one are of one site."""
    p = V.table(spark, sf, "pages").select("page_id", "url")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    return p.join(nxt, "page_id").select("page_id", U.same_site(F.col("url"), F.col("next")).alias("same"))


def cjk_tokens(spark, sf):
    """Tokens of part names with Chinese parts."""
    p = V.table(spark, sf, "part").select("p_partkey", F.concat(F.repeat(F.lit("举报网站"), F.pmod("p_size", F.lit(3)).cast("int")), "p_name", F.lit("图")).alias("s"))
    return p.select("p_partkey", F.concat_ws(" ", T.tokens_cjk(F.col("s"))).alias("tokens"))


def _drafts(spark, sf):
    """Descriptions of parts, some with hyperbole, promises, many repeats or wrong numbers."""
    p = V.table(spark, sf, "part")
    hype = F.element_at(F.array(*map(F.lit, ("大量", "相关", "触目惊心", "泛滥成灾"))), (F.pmod("p_size", F.lit(4)) + 1).cast("int"))
    body = F.concat(F.col("p_name"), F.lit("含有"), F.col("p_size").cast("string"), F.lit("处"), hype, F.lit("内容。"))
    text = F.concat(F.repeat(body, (F.pmod("p_partkey", F.lit(14)) + 1).cast("int")), F.when(F.pmod("p_partkey", F.lit(5)) == 0, "绝对属实").otherwise(""))
    return p.select("p_partkey", "p_size", "p_name", text.alias("text"))


_DRAFTS = "SELECT p_partkey, p_size, p_name, repeat(p_name || '含有' || p_size || '处' || ['大量', '相关', '触目惊心', '泛滥成灾'][p_size % 4 + 1] || '内容。', CAST(p_partkey % 14 + 1 AS BIGINT)) || CASE WHEN p_partkey % 5 = 0 THEN '绝对属实' ELSE '' END AS text FROM part"


def style_scores(spark, sf):
    return _drafts(spark, sf).select("p_partkey", R.style_score(F.col("text")).alias("s")).select("p_partkey", "s.*")


_STYLE = """
SELECT p_partkey, len_ok, has_facts, no_hype, formality, len_ok + has_facts + no_hype + formality AS total FROM (SELECT p_partkey, CAST(length(text) BETWEEN 30 AND 240 AS INTEGER) AS len_ok, CAST(regexp_matches(text, '[0-9]') AS INTEGER) AS has_facts,
  CAST(NOT regexp_matches(text, '大量|极其|遍布|全部|所有|泛滥成灾|数不胜数|铺天盖地|触目惊心') AS INTEGER) AS no_hype, CAST(regexp_matches(text, '经核实|涉嫌|含有|违反|人工核实') AS INTEGER) AS formality FROM drafts)
"""


def polished_texts(spark, sf):
    # a part is few bytes and much work: one task a core at least, however few splits its file has
    drafts = _drafts(spark, sf).select("p_partkey", "text").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "p_partkey")
    return drafts.select("p_partkey", R.polished(F.col("text")).alias("text"))


_POLISHED = """
, t AS (SELECT p_partkey, replace(replace(replace(text, '大量', '多张'), '触目惊心', '明显'), '泛滥成灾', '较多') AS t FROM drafts),
b AS (SELECT p_partkey, CASE WHEN length(t) > 227 THEN CASE WHEN contains(substr(t, 1, 227), '。') THEN regexp_extract(substr(t, 1, 227), '(?s)^(.*。)', 1) ELSE substr(t, 1, 227) END ELSE t END AS b FROM t)
SELECT p_partkey, b || CASE WHEN b LIKE '%。' THEN '' ELSE '。' END || '以上情况本人已人工核实。' AS text FROM b
"""


def draft_issues(spark, sf):
    """What a critic finds in each draft."""
    d = _drafts(spark, sf)
    facts = F.array(F.when(F.pmod("p_partkey", F.lit(3)) != 0, F.col("p_size").cast("double")).otherwise(F.lit(-1.0)))
    return d.select("p_partkey", F.array_join(R.critique(F.col("text"), facts, F.col("p_name")), "; ").alias("issues"))


_ISSUES = """
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'number ' || p_size END, CASE WHEN contains(text, '大量') THEN 'hyperbole 大量' END, CASE WHEN contains(text, '泛滥成灾') THEN 'hyperbole 泛滥成灾' END,
  CASE WHEN length(text) > 240 THEN 'length' END, CASE WHEN contains(text, '绝对') THEN 'promise 绝对' END], lambda x: x IS NOT NULL), '; ') AS issues FROM drafts
"""


def report_reasons(spark, sf):
    """Reasons of at most 39 characters, from hosts and counts."""
    p = V.table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    return p.select("page_id", R.reason(F.col("host"), F.pmod("page_id", F.lit(4)), F.pmod("page_id", F.lit(3)) * 1111).alias("reason"))


_REASONS = """
, r AS (SELECT page_id, CASE WHEN host = '' THEN '该站点' ELSE substr(host, 1, 18) END AS h, page_id % 4 AS p, (page_id % 3) * 1111 AS n FROM keyed),
t AS (SELECT page_id, CASE WHEN p > 0 AND n > 0 THEN h || '抽查' || p || '页，' || n || '张图涉色情内容，已人工核实' WHEN n > 0 THEN h || n || '张图涉色情内容，经人工核实' ELSE h || '涉嫌传播色情内容，已经人工核实' END AS t FROM r)
SELECT page_id, CASE WHEN length(t) <= 39 THEN t WHEN regexp_matches(substr(t, 1, 38), '(?s)^.{12,}，') THEN regexp_extract(substr(t, 1, 38), '(?s)^(.{12,})，', 1) ELSE substr(t, 1, 38) END AS reason FROM t
"""


def group_titles(spark, sf):
    """Names of case groups, and one line of their sites."""
    g = _grouped(spark, sf).filter(F.col("key") != "").groupBy("key").agg(F.count_distinct("raw").alias("urls"), F.count_distinct("host").alias("hosts"), F.array_sort(F.collect_set("host")).alias("all"))
    return g.select("key", R.group_name(F.col("key"), F.col("urls"), F.col("hosts")).alias("name"), R.sites_text(F.col("key"), F.col("all")).alias("sites"))


_TITLES = """
, g AS (SELECT key, count(DISTINCT raw) AS urls, count(DISTINCT host) AS hosts, list_sort(list(DISTINCT host)) AS hs FROM grouped WHERE key <> '' GROUP BY key),
t AS (SELECT key, CASE WHEN greatest(urls, hosts) > 1 THEN key || '(含 ' || greatest(urls, hosts) || ' 个关联站点)' ELSE key END AS name, '主站：' || key || '；镜像/关联：' || CASE WHEN len(list_filter(hs, lambda h: h <> '' AND h <> key)) > 0 THEN array_to_string(list_filter(hs, lambda h: h <> '' AND h <> key), '，') ELSE '无' END AS s FROM g)
SELECT key, name, CASE WHEN length(s) > 200 THEN substr(s, 1, 199) || '等' ELSE s END AS sites FROM t
"""


def categories(spark, sf):
    """Sites by category of report, by a section that search found or else by score, with the laws of each."""
    s = _sites(spark, sf)
    hit = F.when(F.pmod("site", F.lit(4)) == 0, "赌博类").when(F.pmod("site", F.lit(4)) == 1, "说明")
    made = s.select("site", R.category(F.col("agg"), hit).alias("category"))
    return made.select("site", "category", F.array_join(R.laws_of(F.col("category")), ",").alias("laws"))


_CATEGORIES = """
SELECT site, category, CASE category WHEN '赌博类' THEN '网络安全法,互联网信息服务管理办法' WHEN '其他类' THEN '网络安全法,互联网信息服务管理办法' WHEN '色情类' THEN '网络安全法,未成年人保护法,互联网信息服务管理办法,出版管理条例' ELSE '网络安全法,互联网信息服务管理办法,未成年人保护法' END AS laws
FROM (SELECT site, CASE WHEN site % 4 = 0 THEN '赌博类' WHEN agg >= 0.9 THEN '色情类' WHEN agg >= 0.5 THEN '低俗类' ELSE '其他类' END AS category FROM assessed)
"""


def self_checks(spark, sf):
    """Figures of kernels against their baselines: does each do as well."""
    scores = V.image_score(spark, sf)
    figures = scores.agg(F.count_distinct("model").cast("double").alias("models"), (F.sum("p4") / F.count("*") / F.lit(10000.0)).alias("mean_score"), F.max("p4").cast("double").alias("top"))
    baselines = (("models", 5.0, "at least"), ("mean_score", 0.3, "at least"), ("top", 10000.0, "at most"))
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(b).alias("baseline"), (F.col(k) >= b if how == "at least" else F.col(k) <= b).alias("passes")) for k, b, how in baselines])
    return figures.select(F.explode(rows).alias("x")).select("x.metric", q6(F.col("x.value")).alias("value"), "x.baseline", "x.passes")


def spread_over_time(spark, sf):
    """Events by overlapping windows of two hours, one an hour, and by sessions of half an hour's quiet."""
    e = V.table(spark, sf, "events").select("user_id", "ts")
    sliding = e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).agg(F.lit("sliding").alias("kind"), F.count("*").alias("windows"), F.sum("n").alias("events"), F.max("n").alias("most"))
    session = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).agg(F.lit("session").alias("kind"), F.count("*").alias("windows"), F.sum("n").alias("events"), F.max("n").alias("most"))
    return sliding.unionByName(session)


_SPREAD = """
WITH s AS (SELECT w, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(CAST(k AS BIGINT)) AS w FROM events, range(0, 2) r(k)) GROUP BY w),
q AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
x AS (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM q) GROUP BY ALL)
SELECT 'sliding' AS kind, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events, max(n) AS most FROM s UNION ALL SELECT 'session', count(*), CAST(sum(n) AS BIGINT), max(n) FROM x
"""


def _on_sites(sql: str, **more: str) -> str:
    return with_views(sql, "IMAGE_SCORE", ensemble=_ENSEMBLE, assessed=_ASSESS, **more)


def _on_pages(sql: str) -> str:
    return with_views("", hosted=_HOSTED, keyed=_KEYED).strip() + sql


def _on_groups(sql: str) -> str:
    return with_views("", "ENTRIES", hosted=_HOSTED, keyed=_KEYED, grouped=_GROUPED).strip() + sql


QUERIES = {
    "member_weights": (member_weights, with_views(f"SELECT provider, {sql6('x / sum(x) OVER ()')} AS weight FROM (SELECT provider, coalesce(weight, avg(weight) OVER ()) AS x FROM weights)", "IMAGE_SCORE", weights=_WEIGHTS)),
    "fused_reliable": (fused_reliable, _on_sites(_FUSED, weights=_WEIGHTS)),
    "policy_audit": (policy_audit, _on_sites(_AUDIT)),
    "classified_urls": (classified_urls, "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)pill|cheap') THEN 0.95::DOUBLE WHEN regexp_matches(url, '(?i)spam|blog') THEN 0.6::DOUBLE ELSE 0.05::DOUBLE END AS stub FROM pages"),
    "custom_disagreement": (custom_disagreement, with_views(f"SELECT site, path, count(*) AS n, {sql6('abs(avg(p4 / 10000.0::DOUBLE) - median(p4 / 10000.0::DOUBLE))')} AS d FROM image_score GROUP BY site, path", "IMAGE_SCORE")),
    "custom_band": (custom_band, with_views("SELECT model, count(*) AS n, count(*) FILTER (WHERE p4 BETWEEN CASE WHEN length(model) > 5 THEN 2000 ELSE 4000 END AND 8000) AS escalated FROM image_score GROUP BY model", "IMAGE_SCORE")),
    "entry_filter": (entry_filter, _on_groups(" SELECT id, raw AS site_url FROM grouped WHERE status = 'approved' AND contains(lower(raw), 'example.net')")),
    "host_ttl": (host_ttl, "SELECT user_id, floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(max(ts))) < 86400 AS live FROM events GROUP BY user_id"),
    "cost_by_provider": (cost_by_provider, with_views("SELECT provider, count(*) AS calls, CAST(sum(images) AS BIGINT) AS images, CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cost_cents, count(*) FILTER (WHERE cost_cents IS NULL) AS unpriced FROM cost_rows GROUP BY provider", "COST_ROWS")),
    "cost_today": (cost_today, with_views("SELECT provider, count(*) AS calls, CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cost_cents FROM cost_rows WHERE day = (SELECT max(day) FROM cost_rows) GROUP BY provider", "COST_ROWS")),
    "session_stats": (session_stats, with_views("SELECT groups, groups - reported AS pending, reported, scans FROM (SELECT count(*) AS groups, count(*) FILTER (WHERE top >= 9000) AS reported, CAST(sum(n) AS BIGINT) AS scans FROM (SELECT site, max(p4) AS top, count(*) AS n FROM image_score GROUP BY site))", "IMAGE_SCORE")),
    "measure_errors": (measure_errors, with_views("SELECT source_kind, doc_id, CASE WHEN label = 0 THEN 'false positive' ELSE 'missed' END AS kind, p4 FROM labelled WHERE (label = 0 AND p4 >= 5000) OR (label = 1 AND p4 < 9000)", "LABELLED")),
    "guard_families": (guard_families, with_views(f"SELECT family, {sql6('tp::DOUBLE / nullif(tp + fn, 0)')} AS mle_unsafe, {sql6('fp::DOUBLE / nullif(fp + tn, 0)')} AS mle_safe, {sql6('(tp + 1)::DOUBLE / (tp + fn + 2)')} AS p_unsafe, {sql6('(fp + 1)::DOUBLE / (fp + tn + 2)')} AS p_safe, {sql6('near::DOUBLE / n')} AS flip_share FROM (SELECT doc_id % 4 AS family, count(*) FILTER (WHERE p4 >= 6000 AND label = 1) AS tp, count(*) FILTER (WHERE p4 >= 6000 AND label = 0) AS fp, count(*) FILTER (WHERE p4 < 6000 AND label = 1) AS fn, count(*) FILTER (WHERE p4 < 6000 AND label = 0) AS tn, count(*) FILTER (WHERE abs(p4 - 6000) <= 300) AS near, count(*) AS n FROM labelled GROUP BY 1)", "LABELLED")),
    "guard_categories": (guard_categories, "SELECT code, count(*) AS n FROM (SELECT unnest(list_distinct(['S' || (n_chars % 13), 'S' || (doc_id % 5)])) AS code FROM documents) GROUP BY code"),
    "appended_ledger": (appended_ledger, with_views("SELECT seq, entry_id, event_type FROM ledger UNION ALL SELECT (SELECT max(seq) FROM ledger) + row_number() OVER (ORDER BY o_orderkey), o_orderkey, 'added' FROM orders", "LEDGER")),
    "record_leaves": (record_leaves, with_views(_quoted(_LEAF), "LEDGER")),
    "merkle_proofs": (merkle_proofs, with_views(_PROOFS, "LEDGER")),
    "four_eyes": (four_eyes, with_views("SELECT entry_id, CAST(len(o) AS INTEGER) AS reviewers, len(o) >= 1 AS ok FROM (SELECT entry_id, list_filter(seen, lambda x: NOT list_contains(author, x)) AS o FROM (SELECT entry_id, coalesce(list(DISTINCT actor || (turn % 3)) FILTER (WHERE event_type = 'approved'), []) AS seen, coalesce(list(DISTINCT actor || (turn % 3)) FILTER (WHERE event_type = 'added'), []) AS author FROM ledger GROUP BY entry_id))", "LEDGER")),
    "model_search": (model_search, "SELECT *, CAST(row_number() OVER (ORDER BY rank DESC, vision DESC, name) AS INTEGER) AS place FROM (SELECT name, vision, CAST(contains(lower(name), 'brand#1') AS INTEGER) + CAST(contains(lower(name), '7') AS INTEGER) AS rank FROM (SELECT p_name || '-' || p_brand || '-' || p_partkey AS name, p_size % 3 = 0 AS vision FROM part) WHERE contains(lower(name), 'red') AND contains(lower(name), 'ring'))"),
    "keyword_stats": (keyword_stats, "SELECT count(DISTINCT w) AS kept, count(*) - count(DISTINCT w) AS dropped FROM (SELECT CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 THEN p_name || ' ' || p_brand END AS w FROM part)"),
    "run_aliases": (run_aliases, with_views("SELECT run_id AS run, count(*) AS n FROM cost_rows WHERE images % 3 IN (0, 1) AND run_id IS NOT NULL GROUP BY run_id", "COST_ROWS")),
    "same_site_pairs": (same_site_pairs, _on_pages(" SELECT a.page_id, coalesce(a.key, '') = coalesce(b.key, '') AND coalesce(a.key, '') <> '' AS same FROM keyed a JOIN keyed b ON b.page_id = a.page_id + 1")),
    "cjk_tokens": (cjk_tokens, "SELECT p_partkey, array_to_string(list_concat(CASE p_size % 3 WHEN 0 THEN [] WHEN 1 THEN ['举报', '报网', '网站'] ELSE ['举报', '报网', '网站', '站举', '举报', '报网', '网站'] END, list_concat(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ['图'])), ' ') AS tokens FROM part"),
    "style_scores": (style_scores, f"WITH drafts AS ({_DRAFTS}) {_STYLE}"),
    "polished_texts": (polished_texts, f"WITH drafts AS ({_DRAFTS}){_POLISHED}"),
    "draft_issues": (draft_issues, f"WITH drafts AS ({_DRAFTS}) {_ISSUES}"),
    "report_reasons": (report_reasons, _on_pages(_REASONS)),
    "group_titles": (group_titles, _on_groups(_TITLES)),
    "categories": (categories, _on_sites(_CATEGORIES)),
    "self_checks": (self_checks, with_views(f"SELECT metric, {sql6('value')} AS value, baseline, CASE WHEN metric = 'top' THEN value <= baseline ELSE value >= baseline END AS passes FROM (SELECT unnest(['models', 'mean_score', 'top']) AS metric, unnest([m, p, t]) AS value, unnest([5.0::DOUBLE, 0.3::DOUBLE, 10000.0::DOUBLE]) AS baseline FROM (SELECT count(DISTINCT model)::DOUBLE AS m, sum(p4)::DOUBLE / count(*) / 10000.0::DOUBLE AS p, max(p4)::DOUBLE AS t FROM image_score))", "IMAGE_SCORE")),
    "spread_over_time": (spread_over_time, _SPREAD),
}
