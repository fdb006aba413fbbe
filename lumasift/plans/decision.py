"""Queries on scores, verdicts, policies and triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumasift.operators import decision as D
from lumasift.plans.sql_views import with_views
from lumasift.sources import views as V

#: Parameters of the demonstration queries.
WEIGHTS = {"click": 2, "purchase": 3}
RULES = (
    {"name": "severe", "verdict": ("nsfw",), "min_agg": 0.95, "action": "escalate"},
    {"name": "risky", "verdict": ("nsfw", "suspect"), "needs_review": True, "min_agg": 0.7, "action": "review"},
    {"name": "calm", "verdict": ("clean",), "action": "archive"},
)
NOW = "2001-08-03 00:00:00"

_ENSEMBLE = """
SELECT site, path, greatest(0.0, least(1.0, sum(w * p4)::DOUBLE / sum(w) / 10000.0)) AS prob, count(*) AS members,
       arg_max(width, seq) AS width, arg_max(height, seq) AS height
FROM (SELECT *, CASE model WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 1 END AS w
      FROM (SELECT *, row_number() OVER (PARTITION BY site, path, model ORDER BY seq DESC) AS rn FROM image_score) WHERE rn = 1)
GROUP BY site, path
"""
_ASSESS = """
SELECT site, agg, hits, CASE WHEN agg >= 0.9 AND hits >= 3 THEN 'nsfw' WHEN agg >= 0.5 THEN 'suspect' ELSE 'clean' END AS verdict,
       NOT (agg < 0.5) AS needs_review
FROM (SELECT site, coalesce(max(prob) FILTER (WHERE width >= 200 OR height >= 200), 0.0) AS agg,
             count(*) FILTER (WHERE (width >= 200 OR height >= 200) AND prob >= 0.8) AS hits FROM ensemble GROUP BY site)
"""


def q6(x):
    return D.half_up(x, 6)


def sql6(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"


def _images(spark, sf) -> DataFrame:
    return D.ensemble(V.image_score(spark, sf), WEIGHTS)


def _sites(spark, sf) -> DataFrame:
    return D.assess(_images(spark, sf))


def site_verdicts(spark, sf):
    return _sites(spark, sf).select("site", q6(F.col("agg")).alias("agg"), "hits", "verdict", "needs_review").orderBy(F.desc(D.rank_of(F.col("verdict"))), F.desc("agg"), "site")


def ensemble_scores(spark, sf):
    return _images(spark, sf).select("site", "path", q6(F.col("prob")).alias("prob"), "members")


def site_verdicts_fused(spark, sf):
    some = F.pmod("site", F.lit(4))
    aid = lambda k: (F.pmod(F.col("site") * k, F.lit(100)) / F.lit(100.0))
    page = F.when(some != 0, aid(7))
    url = F.when(some < 3, aid(13))
    text = F.when(some == 1, aid(29))
    return D.fuse(_sites(spark, sf), page, url, text).select("site", q6(F.col("fused")).alias("fused"), "verdict")


_FUSED = f"""
SELECT site, {sql6("fused")} AS fused,
       CASE WHEN made_rank > rank THEN made ELSE verdict END AS verdict
FROM (SELECT *, CASE verdict WHEN 'clean' THEN 0 WHEN 'suspect' THEN 1 ELSE 2 END AS rank,
             CASE made WHEN 'clean' THEN 0 WHEN 'suspect' THEN 1 ELSE 2 END AS made_rank
      FROM (SELECT *, CASE WHEN fused >= 0.9 AND hits >= 3 THEN 'nsfw' WHEN fused >= 0.5 THEN 'suspect' ELSE 'clean' END AS made
            FROM (SELECT *, CASE WHEN page IS NULL AND url IS NULL AND text IS NULL THEN agg
                              ELSE greatest(agg, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(-2.0::DOUBLE + scale * (2.2::DOUBLE * agg + coalesce(1.2::DOUBLE * page, 0.3::DOUBLE) + coalesce(0.35::DOUBLE * url, 0) + coalesce(0.45::DOUBLE * text, 0)))))) END AS fused
                  FROM (SELECT *, CASE WHEN page IS NULL OR url IS NULL OR text IS NULL
                                  THEN 4.2::DOUBLE / (2.2::DOUBLE + CASE WHEN page IS NULL THEN 0.6::DOUBLE ELSE 1.2::DOUBLE END + CASE WHEN url IS NULL THEN 0.0 ELSE 0.35::DOUBLE END + CASE WHEN text IS NULL THEN 0.0 ELSE 0.45::DOUBLE END)
                                  ELSE 1.0::DOUBLE END AS scale
                        FROM (SELECT *, CASE WHEN site % 4 <> 0 THEN ((site * 7) % 100) / 100.0::DOUBLE END AS page,
                                     CASE WHEN site % 4 < 3 THEN ((site * 13) % 100) / 100.0::DOUBLE END AS url,
                                     CASE WHEN site % 4 = 1 THEN ((site * 29) % 100) / 100.0::DOUBLE END AS text FROM assessed)))))
"""


def policy_actions(spark, sf):
    return D.policy(_sites(spark, sf), RULES).select("site", "verdict", "action", "rule")


_POLICY = """
SELECT site, verdict,
       CASE WHEN verdict = 'nsfw' AND agg >= 0.95 THEN 'escalate' WHEN verdict IN ('nsfw', 'suspect') AND needs_review AND agg >= 0.7 THEN 'review'
            WHEN verdict = 'clean' THEN 'archive' ELSE 'queue' END AS action,
       CASE WHEN verdict = 'nsfw' AND agg >= 0.95 THEN 'severe' WHEN verdict IN ('nsfw', 'suspect') AND needs_review AND agg >= 0.7 THEN 'risky'
            WHEN verdict = 'clean' THEN 'calm' ELSE 'fallback' END AS rule
FROM assessed
"""


def triage_ranking(spark, sf):
    ranked = D.triage(V.entries(spark, sf), F.lit(NOW).cast("timestamp"))
    return ranked.select("id", "verdict", q6(F.col("priority")).alias("priority")).orderBy(F.desc("priority"), "id")


_OVERTURN = """
SELECT verdict, count(*) AS n, count(*) FILTER (WHERE CASE WHEN verdict = 'clean' THEN status <> 'rejected' ELSE status = 'rejected' END) AS o
FROM entries WHERE status IN ('approved', 'rejected', 'submitted') GROUP BY verdict
"""
_TRIAGE = f"""
SELECT id, e.verdict, {sql6('''0.4::DOUBLE * (agg4 / 10000.0::DOUBLE) + 0.3::DOUBLE * proxy
  + 0.1::DOUBLE * coalesce((o + 1)::DOUBLE / (n + 2), p_all) + 0.2::DOUBLE * age''')} AS priority
FROM (SELECT *, CASE verdict WHEN 'nsfw' THEN 0.9::DOUBLE WHEN 'suspect' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS proxy,
             least(1.0::DOUBLE, greatest(0.0::DOUBLE, (epoch(TIMESTAMP '{NOW}') - epoch(created_at))::DOUBLE / 3600.0::DOUBLE / 72.0::DOUBLE)) AS age
      FROM entries WHERE status = 'pending') e
LEFT JOIN overturn o ON e.verdict = o.verdict
CROSS JOIN (SELECT (sum(o) + 1)::DOUBLE / (sum(n) + 2) AS p_all FROM overturn)
"""


def overturn_probability(spark, sf):
    return D.overturn_stats(V.entries(spark, sf)).select("verdict", "n", "o", q6(F.col("p_overturn")).alias("p_overturn"))


def abstain_decisions(spark, sf):
    d = D.disagreement(V.image_score(spark, sf))
    return d.select("site", "path", "n", q6(F.col("d")).alias("d"), D.abstains(F.col("d"), F.col("n")).alias("abstain"))


def abstain_std(spark, sf):
    d = D.disagreement(V.image_score(spark, sf), "std")
    return d.select("site", "path", D.half_up(F.col("d"), 5).alias("d"))


def abstain_sweep(spark, sf):
    d = D.disagreement(V.image_score(spark, sf))
    kept = D.sweep(d.select(D.half_up(F.col("d"), 4).alias("d"), F.pmod("site", F.lit(2)).alias("wrong")))
    total = d.count()
    return kept.select("k", "kept", "wrong", q6(F.col("kept") / F.lit(float(total))).alias("coverage"), q6(F.try_divide(F.col("wrong").cast("double"), "kept")).alias("risk"))


_DISAGREE = "SELECT site, path, count(*) AS n, max(p4 / 10000.0::DOUBLE) - min(p4 / 10000.0::DOUBLE) AS d, stddev_pop(p4 / 10000.0::DOUBLE) AS sd FROM image_score GROUP BY site, path"


def arbiter_targets(spark, sf, budget: int = 3):
    """Images whose models differ by .35 or more: the few widest of each site."""
    last = D.last_per(V.image_score(spark, sf).select("site", "path", "model", "p4", "seq"), ["site", "path", "model"], "seq")
    spread = last.groupBy("site", "path").agg((F.max("p4") - F.min("p4")).alias("spread4"), F.count("*").alias("members"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("spread4"), "path"))
    return spread.filter((F.col("spread4") >= 3500) & (F.col("members") >= 2)).withColumn("place", rank).filter(F.col("place") <= max(1, min(3, budget))).select("site", "path", "spread4", "place")


def cascade_routing(spark, sf, low: float = 0.15, high: float = 0.85):
    """Scores in the middle band go to the costly model."""
    p = F.col("p4") / F.lit(10000.0)
    return V.image_score(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(p.between(low, high), 1)).alias("escalated"))


def _provider_means(spark, sf) -> DataFrame:
    return V.image_score(spark, sf).groupBy("site", "path", F.col("model").alias("provider")).agg(F.sum("p4").alias("s"), F.count("*").alias("c")).withColumn("p", F.col("s") / F.col("c"))


def provider_bias(spark, sf):
    """Mean of each provider's gap to the mean of all scores of an image."""
    means = _provider_means(spark, sf)
    consensus = means.groupBy("site", "path").agg((F.sum("s") / F.sum("c")).alias("all"))
    gaps = means.join(consensus, ["site", "path"]).groupBy("provider").agg(F.avg((F.col("p") - F.col("all")) / F.lit(10000.0)).alias("bias"), F.count("*").alias("images"))
    return gaps.select("provider", D.half_up(F.col("bias"), 4).alias("bias"), "images", (F.abs("bias") > 0.15).alias("outlier"))


def provider_agreement(spark, sf):
    """Share of images on which two providers are at most .2 apart."""
    m = _provider_means(spark, sf).select("site", "path", "provider", "p")
    other = m.select("site", "path", F.col("provider").alias("other"), F.col("p").alias("q"))
    pairs = m.join(other, ["site", "path"]).filter(F.col("provider") < F.col("other"))
    near = F.count(F.when(F.abs(F.col("p") - F.col("q")) <= 2000, 1))
    return pairs.groupBy("provider", "other").agg(F.count("*").alias("images"), near.alias("agree")).withColumn("share", q6(F.col("agree") / F.col("images")))


def agreement_matrix(spark, sf):
    """As provider_agreement, by the last score of each model."""
    last = D.last_per(V.image_score(spark, sf).select("site", "path", "model", "p4", "seq"), ["site", "path", "model"], "seq")
    other = last.select("site", "path", F.col("model").alias("other"), F.col("p4").alias("q4"))
    pairs = last.join(other, ["site", "path"]).filter(F.col("model") < F.col("other"))
    return pairs.groupBy("model", "other").agg(F.count("*").alias("images"), F.count(F.when(F.abs(F.col("p4") - F.col("q4")) <= 2000, 1)).alias("agree"))


def image_spread_top(spark, sf):
    """The twenty images whose provider means lie farthest apart."""
    wide = _provider_means(spark, sf).groupBy("site", "path").agg(F.max("p").alias("max"), F.min("p").alias("min"))
    shown = [D.half_up(F.col(c) / F.lit(10000.0), 4).alias(c) for c in ("max", "min")]
    return wide.select("site", "path", *shown, D.half_up((F.col("max") - F.col("min")) / F.lit(10000.0), 4).alias("spread")).orderBy(F.desc("spread"), "site", "path").limit(20)


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, path, model ORDER BY seq DESC) AS rn FROM image_score) WHERE rn = 1"
_MEANS = "SELECT site, path, model AS provider, sum(p4) AS s, count(*) AS c, sum(p4)::DOUBLE / count(*) AS p FROM image_score GROUP BY site, path, model"


def failure_escalation(spark, sf):
    """Sites with failed scores need review, whatever their verdict."""
    failed = V.image_score(spark, sf).groupBy("site").agg(F.count(F.when(F.pmod("seq", F.lit(97)) == 0, 1)).alias("failed"))
    both = _sites(spark, sf).join(failed, "site", "left")
    note = F.when(F.col("failed") > 0, F.concat(F.lit("[识别失败 "), F.col("failed").cast("string"), F.lit(" 张]"))).otherwise("")
    return both.select("site", "verdict", (F.col("needs_review") | (F.col("failed") > 0)).alias("needs_review"), note.alias("note"))


def uncertain_first(spark, sf, budget: int = 5):
    """Each site's images nearest to one half, in order of score distance and writing."""
    images = D.last_per(V.image_score(spark, sf).select("site", "path", "p4", "seq"), ["site", "path"], "seq")
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.abs(F.col("p4") - 5000), "seq"))
    return images.withColumn("place", place).filter(F.col("place") <= budget).select("site", "path", "p4", "place")


def stub_scores(spark, sf):
    """Probability from words in a file name."""
    pages = V.table(spark, sf, "pages")
    p = F.when(F.col("url").rlike("(?i)pill|cheap"), 0.95).when(F.col("url").rlike("(?i)spam|blog"), 0.6).otherwise(0.05)
    return pages.select("page_id", p.alias("prob"))


def merged_top_scores(spark, sf):
    """The ten highest probabilities of any image, by file."""
    return V.image_score(spark, sf).groupBy("path").agg(F.max("p4").alias("p4")).orderBy(F.desc("p4"), "path").limit(10)


def threshold_suggestions(spark, sf):
    """Medians of rejected scores, and the share of approvals, by verdict."""
    e = V.entries(spark, sf)
    return e.groupBy("verdict").agg(
        F.median(F.when(F.col("status") == "rejected", F.col("agg4"))).alias("median_rejected"),
        q6(F.avg(F.when(F.col("status").isin("approved", "submitted"), 1.0).otherwise(0.0))).alias("approve_ratio"),
    )


def _on_sites(sql: str) -> str:
    return with_views(sql, "IMAGE_SCORE", ensemble=_ENSEMBLE, assessed=_ASSESS)


def _on_scores(sql: str, **more: str) -> str:
    return with_views(sql, "IMAGE_SCORE", **more)


def _on_entries(sql: str, **more: str) -> str:
    return with_views(sql, "ENTRIES", **more)


QUERIES = {
    "site_verdicts": (site_verdicts, _on_sites(f"SELECT site, {sql6('agg')} AS agg, hits, verdict, needs_review FROM assessed")),
    "ensemble_scores": (ensemble_scores, _on_sites(f"SELECT site, path, {sql6('prob')} AS prob, members FROM ensemble")),
    "site_verdicts_fused": (site_verdicts_fused, _on_sites(_FUSED)),
    "policy_actions": (policy_actions, _on_sites(_POLICY)),
    "triage_ranking": (triage_ranking, _on_entries(_TRIAGE, overturn=_OVERTURN)),
    "overturn_probability": (overturn_probability, _on_entries(f"SELECT verdict, n, o, {sql6('(o + 1)::DOUBLE / (n + 2)')} AS p_overturn FROM overturn", overturn=_OVERTURN)),
    "abstain_decisions": (abstain_decisions, _on_scores(f"SELECT site, path, n, {sql6('d')} AS d, n > 1 AND d >= 0.35 AS abstain FROM dis", dis=_DISAGREE)),
    "abstain_std": (abstain_std, _on_scores("SELECT site, path, floor(sd * 100000.0::DOUBLE + 0.5) / 100000.0::DOUBLE AS d FROM dis", dis=_DISAGREE)),
    "abstain_sweep": (
        abstain_sweep,
        _on_scores(
            f"""SELECT CAST(k AS INTEGER) AS k, count(d) AS kept, coalesce(sum(site % 2), 0)::BIGINT AS wrong, {sql6('count(d)::DOUBLE / (SELECT count(*) FROM dis)')} AS coverage,
            {sql6('sum(site % 2)::DOUBLE / nullif(count(d), 0)')} AS risk
            FROM range(0, 21) g(k) LEFT JOIN (SELECT site, floor(d * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS d FROM dis) x
            ON least(20, floor((1.0::DOUBLE - d) * 20 + 1e-9)) >= k GROUP BY k""",
            dis=_DISAGREE,
        ),
    ),
    "arbiter_targets": (
        arbiter_targets,
        _on_scores("SELECT site, path, spread4, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY spread4 DESC, path) AS INTEGER) AS place FROM (SELECT site, path, max(p4) - min(p4) AS spread4, count(*) AS m FROM last GROUP BY site, path) WHERE spread4 >= 3500 AND m >= 2) WHERE place <= 3", last=_LAST),
    ),
    "cascade_routing": (cascade_routing, _on_scores("SELECT model, count(*) AS n, count(*) FILTER (WHERE p4 BETWEEN 1500 AND 8500) AS escalated FROM image_score GROUP BY model")),
    "provider_bias": (
        provider_bias,
        _on_scores("SELECT provider, floor(b * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS bias, images, abs(b) > 0.15 AS outlier FROM (SELECT provider, avg((p - a) / 10000.0::DOUBLE) AS b, count(*) AS images FROM means JOIN (SELECT site, path, sum(s)::DOUBLE / sum(c) AS a FROM means GROUP BY site, path) USING (site, path) GROUP BY provider)", means=_MEANS),
    ),
    "provider_agreement": (
        provider_agreement,
        _on_scores(f"SELECT provider, other, images, agree, {sql6('agree::DOUBLE / images')} AS share FROM (SELECT a.provider, b.provider AS other, count(*) AS images, count(*) FILTER (WHERE abs(a.p - b.p) <= 2000) AS agree FROM means a JOIN means b USING (site, path) WHERE a.provider < b.provider GROUP BY ALL)", means=_MEANS),
    ),
    "agreement_matrix": (agreement_matrix, _on_scores("SELECT a.model, b.model AS other, count(*) AS images, count(*) FILTER (WHERE abs(a.p4 - b.p4) <= 2000) AS agree FROM last a JOIN last b USING (site, path) WHERE a.model < b.model GROUP BY ALL", last=_LAST)),
    "image_spread_top": (
        image_spread_top,
        _on_scores("SELECT site, path, floor(hi / 10000.0::DOUBLE * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS max, floor(lo / 10000.0::DOUBLE * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS min, floor((hi - lo) / 10000.0::DOUBLE * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS spread FROM (SELECT site, path, max(p) AS hi, min(p) AS lo FROM means GROUP BY site, path) ORDER BY spread DESC, site, path LIMIT 20", means=_MEANS),
    ),
    "failure_escalation": (
        failure_escalation,
        _on_sites("SELECT a.site, verdict, needs_review OR failed > 0 AS needs_review, CASE WHEN failed > 0 THEN '[识别失败 ' || failed || ' 张]' ELSE '' END AS note FROM assessed a LEFT JOIN (SELECT site, count(*) FILTER (WHERE seq % 97 = 0) AS failed FROM image_score GROUP BY site) f ON a.site = f.site"),
    ),
    "uncertain_first": (
        uncertain_first,
        _on_scores("SELECT site, path, p4, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY abs(p4 - 5000), seq) AS INTEGER) AS place FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, path ORDER BY seq DESC) AS rn FROM image_score) WHERE rn = 1)) WHERE place <= 5"),
    ),
    "stub_scores": (stub_scores, "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)pill|cheap') THEN 0.95::DOUBLE WHEN regexp_matches(url, '(?i)spam|blog') THEN 0.6::DOUBLE ELSE 0.05::DOUBLE END AS prob FROM pages"),
    "merged_top_scores": (merged_top_scores, _on_scores("SELECT path, max(p4) AS p4 FROM image_score GROUP BY path ORDER BY p4 DESC, path LIMIT 10")),
    "threshold_suggestions": (threshold_suggestions, _on_entries(f"SELECT verdict, median(agg4) FILTER (WHERE status = 'rejected') AS median_rejected, {sql6('''avg(CASE WHEN status IN ('approved', 'submitted') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)''')} AS approve_ratio FROM entries GROUP BY verdict")),
}
