"""Queries on sequential tests, reliability, calibration, drift and schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumasift.operators import decision as D
from lumasift.operators import ranks as K
from lumasift.operators import sequential as S
from lumasift.plans.decision import q6, sql6
from lumasift.plans.sql_views import ENTRIES, with_views
from lumasift.scratch import fresh_path, saved
from lumasift.sources import views as V


def prob():
    return F.col("p4") / F.lit(10000.0)


def sprt_decisions(spark, sf):
    return S.sprt(V.image_score(spark, sf), "site", "seq", prob())


_SPRT = """
WITH image_score AS (SELECT * FROM iv), r AS (SELECT site, row_number() OVER w AS n, sum(x * ln(0.9::DOUBLE / 0.5) + (1 - x) * ln((1 - 0.9::DOUBLE) / (1 - 0.5))) OVER (w ROWS UNBOUNDED PRECEDING) AS total
  FROM (SELECT site, seq, greatest(0.01::DOUBLE, least(0.99::DOUBLE, p4 / 10000.0::DOUBLE)) AS x FROM image_score) WINDOW w AS (PARTITION BY site ORDER BY seq)),
s AS (SELECT *, CASE WHEN total >= ln(0.95::DOUBLE / 0.05) THEN 'nsfw' WHEN total <= ln(0.05::DOUBLE / 0.95) THEN 'clean' END AS state FROM r)
SELECT site, coalesce(arg_min(state, n) FILTER (WHERE state IS NOT NULL), 'undecided') AS state, CAST(coalesce(min(n) FILTER (WHERE state IS NOT NULL), max(n)) AS INTEGER) AS used FROM s GROUP BY site
"""


def next_images(spark, sf):
    """Images that sites' tests take, least certain first, six a site at most."""
    return S.next_images(V.image_score(spark, sf), "site", "seq", prob(), 6)


def next_images_budget(spark, sf):
    """As next_images, with one image for every twenty rows of the table in all: rounds over all sites."""
    scores = V.image_score(spark, sf)
    return S.next_images(scores, "site", "seq", prob(), 6, budget=scores.count() // 20)


_NEXT = """
WITH k AS (SELECT site, seq, row_number() OVER (PARTITION BY site ORDER BY abs(p4 - 5000), seq) AS nth, greatest(0.01::DOUBLE, least(0.99::DOUBLE, p4 / 10000.0::DOUBLE)) AS x FROM iv),
r AS (SELECT *, sum(x * ln(0.9::DOUBLE / 0.5) + (1 - x) * ln((1 - 0.9::DOUBLE) / (1 - 0.5))) OVER (PARTITION BY site ORDER BY nth ROWS UNBOUNDED PRECEDING) AS total FROM k WHERE nth <= 6),
s AS (SELECT site, seq, CAST(nth AS INTEGER) AS nth, CASE WHEN total >= ln(0.95::DOUBLE / 0.05) THEN 'nsfw' WHEN total <= ln(0.05::DOUBLE / 0.95) THEN 'clean' ELSE 'continue' END AS state FROM r),
n AS (SELECT *, coalesce(max(CASE WHEN state <> 'continue' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS settled FROM s)
"""


def conf_sequence(spark, sf):
    c = S.confidence_sequence(V.image_score(spark, sf), "site", "seq", prob())
    return c.select("site", "seq", "n", q6(F.col("mean")).alias("mean"), q6(F.col("radius")).alias("radius"))


_CONF = """
SELECT site, seq, n, mean, sqrt(ln(4.0::DOUBLE * pow(2.0::DOUBLE, k) / (0.05::DOUBLE / pow(2.0::DOUBLE, k + 1))) / (2 * n)) AS radius
FROM (SELECT site, seq, n, s::DOUBLE / n / 10000.0::DOUBLE AS mean, CASE WHEN n = 1 THEN 0 ELSE length(bin(n - 1)) END AS k
      FROM (SELECT site, seq, count(*) OVER w AS n, sum(p4) OVER w AS s FROM image_score WINDOW w AS (PARTITION BY site ORDER BY seq ROWS UNBOUNDED PRECEDING)))
"""


def ci_band_stop(spark, sf):
    return S.band_stop(S.confidence_sequence(V.image_score(spark, sf), "site", "seq", prob()), "site", 0.4, 0.6)


_BAND = """
SELECT site, coalesce(arg_min(state, n) FILTER (WHERE state IS NOT NULL), 'undecided') AS state, coalesce(min(n) FILTER (WHERE state IS NOT NULL), max(n)) AS used
FROM (SELECT *, CASE WHEN mean - radius > 0.4::DOUBLE THEN 'nsfw' WHEN mean + radius < 0.6::DOUBLE THEN 'clean' END AS state FROM conf) GROUP BY site
"""


def mixture_sprt(spark, sf):
    m = S.mixture_evalue(V.image_score(spark, sf), "site", "seq", F.col("p4") >= 5000)
    return m.select("site", "state", "used", q6(F.col("last_log_e")).alias("last_log_e"))


_MIXTURE = f"""
, r AS (SELECT site, count(*) OVER w AS n, CAST(sum(CASE WHEN p4 >= 5000 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS s FROM iv WINDOW w AS (PARTITION BY site ORDER BY seq ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, lgamma(s + 0.5::DOUBLE) + lgamma(n - s + 0.5::DOUBLE) - lgamma(n + 1.0::DOUBLE) - 2 * lgamma(0.5::DOUBLE) - s * ln(0.5::DOUBLE) - (n - s) * ln(0.5::DOUBLE) AS v FROM r),
h AS (SELECT *, v >= -ln(0.05::DOUBLE) AS hit, CASE WHEN s::DOUBLE / n > 0.5 THEN 'nsfw' ELSE 'clean' END AS side FROM e)
SELECT site, coalesce(arg_min(side, n) FILTER (WHERE hit), 'undecided') AS state, coalesce(min(n) FILTER (WHERE hit), max(n)) AS used, {sql6('arg_max(v, n)')} AS last_log_e FROM h GROUP BY site
"""


def brier_weights(spark, sf):
    y = F.when(F.pmod("seq", F.lit(3)) == 0, 1.0).otherwise(0.0)
    b = V.image_score(spark, sf).groupBy(F.col("model").alias("provider")).agg(F.count("*").alias("n"), F.avg((prob() - y) * (prob() - y)).alias("brier"))
    w = D.reliable_weights(b)
    return w.select("provider", "n", D.half_up(F.col("brier"), 8).alias("brier"), q6(F.col("weight")).alias("weight"))


_BRIER = f"""
WITH b AS (SELECT model AS provider, count(*) AS n, avg((p4 / 10000.0::DOUBLE - y) * (p4 / 10000.0::DOUBLE - y)) AS brier FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM iv) GROUP BY model)
SELECT provider, n, floor(brier * 1e8 + 0.5) / 1e8 AS brier, {sql6('raw / sum(raw) OVER ()')} AS weight FROM (SELECT *, CASE WHEN n >= 5 THEN 1.0::DOUBLE / (brier + 0.05::DOUBLE) END AS raw FROM b)
"""


def _outcomes(spark, sf):
    return V.image_score(spark, sf).select(F.col("model").alias("provider"), ((F.col("p4") >= 5000) == (F.pmod("seq", F.lit(3)) == 0)).alias("correct"), F.col("seq").cast("double").alias("t"))


def bayes_weights(spark, sf):
    """As of four fifths of the time; later rows don't count."""
    rows = _outcomes(spark, sf)
    as_of = rows.agg(F.max("t")).first()[0] * 0.8
    w = S.bayes_weights(rows, F.lit(as_of), 2000.0)
    return w.select("provider", q6(F.col("mean")).alias("mean"), q6(F.col("weight")).alias("weight"))


def bayes_checkpointed(spark, sf):
    """From a checkpoint of the even rows that later rows are folded into: what all rows give."""
    rows = _outcomes(spark, sf)
    first = saved(S.bayes_checkpoint(rows.filter(F.col("t") % 2 == 0), 2000.0), "checkpoint")
    both = S.bayes_checkpoint(rows.filter(F.col("t") % 2 != 0), 2000.0, first)
    w = S.checkpoint_weights(both, F.lit(rows.agg(F.max("t")).first()[0] + 100), 2000.0)
    return w.select("provider", q6(F.col("mean")).alias("mean"), q6(F.col("weight")).alias("weight"))


def bayes_folded(spark, sf):
    """Folds of 256 rows, saved, loaded, and later rows folded in: what all rows give."""
    rows = _outcomes(spark, sf)
    path = fresh_path(spark, "reliability")
    S.save_checkpoint(S.folded_checkpoint(rows.filter(F.col("t") % 3 != 1), 2000.0), path, 2000.0)
    both = S.bayes_checkpoint(rows.filter(F.col("t") % 3 == 1), 2000.0, S.load_checkpoint(spark, path, 2000.0))
    w = S.checkpoint_weights(both, F.lit(rows.agg(F.max("t")).first()[0] + 100), 2000.0)
    return w.select("provider", q6(F.col("mean")).alias("mean"), q6(F.col("weight")).alias("weight"))


def _bayes(now: str, where: str) -> str:
    return f"""
WITH r AS (SELECT model AS provider, (p4 >= 5000) = (seq % 3 = 0) AS correct, exp(-ln(2.0::DOUBLE) * ({now} - seq) / 2000.0::DOUBLE) AS w FROM iv WHERE {where}),
o AS (SELECT provider, coalesce(sum(w) FILTER (WHERE correct), 0) AS good, coalesce(sum(w) FILTER (WHERE NOT correct), 0) AS bad FROM r GROUP BY provider),
m AS (SELECT provider, (1 - sh) * ((1 + good) / (2 + good + bad)) + sh * pool AS mean FROM (SELECT *, CASE WHEN good + bad < 5 THEN 1.0 ELSE 10.0::DOUBLE / (10.0::DOUBLE + good + bad) END AS sh FROM o), (SELECT (1 + sum(good)) / (2 + sum(good) + sum(bad)) AS pool FROM o))
SELECT provider, {sql6('mean')} AS mean, {sql6('mean / sum(mean) OVER ()')} AS weight FROM m
"""


_NOW = "(SELECT max(seq) * 0.8::DOUBLE FROM iv)"
_BAYES, _CHECKPOINTED = _bayes(_NOW, f"seq <= {_NOW}"), _bayes("(SELECT max(seq) + 100.0::DOUBLE FROM iv)", "true")


def brier_ece(spark, sf):
    rows = V.labelled(spark, sf)
    bins = S.reliability_bins(rows, prob(), F.col("label"))
    ece = bins.agg(F.sum(F.col("n") * F.abs(F.col("avg_prob") - F.col("freq"))).alias("gap"), F.sum("n").alias("n"))
    brier = rows.agg(F.avg((prob() - F.col("label")) * (prob() - F.col("label"))).alias("brier"))
    return brier.crossJoin(ece).select("n", q6(F.col("brier")).alias("brier"), q6(F.col("gap") / F.col("n")).alias("ece"))


def reliability_bins(spark, sf):
    b = S.reliability_bins(V.labelled(spark, sf), prob(), F.col("label"))
    return b.select("bin", "n", D.half_up(F.col("avg_prob"), 4).alias("avg_prob"), D.half_up(F.col("freq"), 4).alias("freq"))


_BINS = """
SELECT CAST(g.k AS INTEGER) AS bin, count(l.p4) AS n, coalesce(avg(p4 / 10000.0::DOUBLE), 0.0) AS avg_prob, coalesce(avg(label::DOUBLE), 0.0) AS freq
FROM range(0, 10) g(k) LEFT JOIN labelled l ON least(floor(p4 / 10000.0::DOUBLE * 10), 9) = g.k GROUP BY g.k
"""

_GRID = (5000, 8000, 9000)


def confusion_grid(spark, sf):
    c = S.confusion(V.labelled(spark, sf), F.col("p4"), F.col("label"), list(_GRID))
    return c.select("threshold4", "tp", "fp", "fn", "tn", *[q6(F.col(x)).alias(x) for x in ("precision", "recall", "fp_rate", "fn_rate")])


_CONFUSION = f"""
SELECT threshold4, tp, fp, fn, tn, {sql6('tp::DOUBLE / nullif(tp + fp, 0)')} AS precision, {sql6('tp::DOUBLE / nullif(tp + fn, 0)')} AS recall, {sql6('fp::DOUBLE / nullif(fp + tn, 0)')} AS fp_rate, {sql6('fn::DOUBLE / nullif(tp + fn, 0)')} AS fn_rate
FROM (SELECT CAST(t AS INTEGER) AS threshold4, count(*) FILTER (WHERE p4 >= t AND label = 1) AS tp, count(*) FILTER (WHERE p4 >= t AND label = 0) AS fp, count(*) FILTER (WHERE p4 < t AND label = 1) AS fn, count(*) FILTER (WHERE p4 < t AND label = 0) AS tn
      FROM labelled, (VALUES (5000), (8000), (9000)) v(t) GROUP BY t)
"""


def confusion_by_source(spark, sf):
    """Calibration of labels by people and others apart."""
    rows = V.labelled(spark, sf)
    hit = F.col("p4") >= 9000
    return rows.groupBy("source_kind").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), q6(F.avg((prob() - F.col("label")) * (prob() - F.col("label")))).alias("brier"), F.count(F.when(hit & (F.col("label") == 0), 1)).alias("fp"), F.count(F.when(~hit & (F.col("label") == 1), 1)).alias("fn"))


def pr_curve(spark, sf):
    rows = V.labelled(spark, sf)
    total = rows.agg(F.sum("label")).first()[0]
    c = S.suffix_counts(rows, "p4", "label")
    return c.select("p4", "selected", "hits", q6(F.col("hits") / F.col("selected")).alias("precision"), q6(F.try_divide(F.col("hits").cast("double"), F.lit(total))).alias("recall"))


_SUFFIX = "SELECT p4, sum(n) OVER w AS selected, sum(pos) OVER w AS hits, sum(pos) OVER () AS total FROM (SELECT p4, count(*) AS n, sum(label) AS pos FROM labelled GROUP BY p4) WINDOW w AS (ORDER BY p4 DESC ROWS UNBOUNDED PRECEDING)"


def suggest_threshold(spark, sf):
    """The score with the highest F1; ties go to the highest score."""
    rows = V.labelled(spark, sf)
    c = S.suffix_counts(rows, "p4", "label").crossJoin(rows.agg(F.sum("label").alias("total")))
    f1 = q6(F.try_divide(2.0 * F.col("hits"), F.col("selected") + F.col("total")))
    return c.select("p4", f1.alias("f1")).agg(F.max(F.struct("f1", "p4")).alias("best")).select("best.p4", "best.f1")


def auc(spark, sf):
    a = S.auc(V.labelled(spark, sf), "p4", "label")
    return a.select(q6(F.col("auc")).alias("auc"), "pos", "neg")


def _calibration(spark, sf):
    """Scores with a truth that they tell: label, or a high score but for every tenth."""
    rows = V.labelled(spark, sf)
    return rows.withColumn("label", F.when((F.col("label") == 1) | ((F.col("p4") >= 6000) & (F.pmod("doc_id", F.lit(10)) != 0)), 1).otherwise(0).cast("long"))


def conformal_threshold(spark, sf):
    """The deepest score of precision .8 or more, and how sure that is."""
    c = S.conformal_threshold(S.suffix_counts(_calibration(spark, sf), "p4", "label").withColumnRenamed("p4", "score"), 0.8)
    shown = [q6(F.col(x)).alias(x) for x in ("empirical_precision", "p_value", "corrected_alpha")]
    return c.select(F.col("threshold").cast("long").alias("threshold"), "n", *shown, "n_candidates", "selection_mode", F.coalesce(F.col("ltt_threshold").cast("long"), F.lit(-1).cast("long")).alias("ltt_threshold"))


_CONFORMAL = f"""
, cal AS (SELECT p4, CASE WHEN label = 1 OR (p4 >= 6000 AND doc_id % 10 <> 0) THEN 1 ELSE 0 END AS y FROM labelled),
c AS (SELECT p4, CAST(sum(n) OVER w AS BIGINT) AS m, CAST(sum(pos) OVER w AS BIGINT) AS k FROM (SELECT p4, count(*) AS n, sum(y) AS pos FROM cal GROUP BY p4) WINDOW w AS (ORDER BY p4 DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT c.*, least(1.0, list_sum(list_transform(range(k, m + 1), lambda j: exp(lgamma(m + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - CASE WHEN m > j THEN lgamma(m - j + 1) ELSE 0 END + j * ln(0.8::DOUBLE) + (m - j) * ln(0.2::DOUBLE))))) AS p FROM c WHERE k >= 0.8::DOUBLE * m),
b AS (SELECT p4, m, k, p FROM t ORDER BY m DESC LIMIT 1), z AS (SELECT count(*) AS cand, max(m) AS n FROM c), l AS (SELECT p4, m FROM t, z WHERE k > 0.8::DOUBLE * m AND p <= 0.05::DOUBLE / cand ORDER BY m DESC LIMIT 1)
SELECT b.p4 AS threshold, n, {sql6('k::DOUBLE / b.m')} AS empirical_precision, {sql6('p')} AS p_value, {sql6('0.05::DOUBLE / cand')} AS corrected_alpha, cand AS n_candidates,
  CASE WHEN l.m IS NULL THEN 'empirical_fallback' WHEN l.m = b.m THEN 'ltt' ELSE 'ltt_advisory' END AS selection_mode, coalesce(l.p4, -1) AS ltt_threshold FROM b CROSS JOIN z LEFT JOIN l ON true
"""


def conformal_selected(spark, sf):
    return V.labelled(spark, sf).filter(F.col("p4") >= 9000).select("doc_id", "p4")


def _drift_histograms(spark, sf):
    e = V.image_score(spark, sf)
    half = K.discrete_percentile(e, ["model"], "seq", 0.5).withColumnRenamed("seq", "mid")
    k = F.least(F.floor(F.col("p4") / 1000), F.lit(9))
    rows = e.join(half, "model").withColumn("bin", k).withColumn("late", F.col("seq") > F.col("mid"))
    cells = lambda late: F.array(*[F.count(F.when((F.col("late") == late) & (F.col("bin") == b), 1)) for b in range(10)])
    return rows.groupBy(F.col("model").alias("source")).agg(cells(False).alias("ref"), cells(True).alias("cur"))


def drift_interval(spark, sf):
    """Percentiles of redrawn histograms; tests compare them with other draws."""
    d = S.drift_interval(_drift_histograms(spark, sf))
    return d.select("source", *[q6(F.col(c)).alias(c) for c in ("psi_lo", "psi_hi", "kl_lo", "kl_hi")])


def drift_by_window(spark, sf):
    """PSI of each tenth of a model's scores against the first one and against the one before."""
    e = K.numbered(V.image_score(spark, sf).select("model", "seq", "p4"), ["model"], [F.col("seq").asc()]).withColumn("part", K.tile(F.col("i"), F.col("n"), 10))
    k = F.least(F.floor(F.col("p4") / 1000), F.lit(9))
    hist = saved(e.groupBy("model", "part").agg(F.array(*[F.count(F.when(k == b, 1)) for b in range(10)]).alias("h")), "histograms")
    out = None
    for mode, shift in (("first", None), ("prev", 1)):
        ref = hist.filter("part = 1").select("model", F.col("h").alias("ref")) if shift is None else hist.select("model", (F.col("part") + shift).alias("part"), F.col("h").alias("ref"))
        pairs = hist.join(ref, ["model"] if shift is None else ["model", "part"]).filter("part > 1").withColumn("source", F.concat_ws("/", F.lit(mode), "model", F.col("part").cast("string")))
        made = S.histogram_drift(pairs.select("source", "ref", F.col("h").alias("cur")))
        out = made if out is None else out.unionByName(made)
    return out.select("source", q6(F.col("psi")).alias("psi"), "grade")


_WINDOWS = f"""
, e AS (SELECT *, ntile(10) OVER (PARTITION BY model ORDER BY seq) AS part FROM iv),
h AS (SELECT m.model, m.part, b.bin, count(e.seq) AS n FROM (SELECT DISTINCT model, part FROM e) m CROSS JOIN range(0, 10) b(bin) LEFT JOIN e ON e.model = m.model AND e.part = m.part AND least(e.p4 // 1000, 9) = b.bin GROUP BY ALL),
p AS (SELECT 'first/' || a.model || '/' || a.part AS source, a.bin, r.n AS ref, a.n AS cur FROM h a JOIN h r ON a.model = r.model AND a.bin = r.bin AND r.part = 1 WHERE a.part > 1
  UNION ALL SELECT 'prev/' || a.model || '/' || a.part, a.bin, r.n, a.n FROM h a JOIN h r ON a.model = r.model AND a.bin = r.bin AND r.part = a.part - 1),
s AS (SELECT source, greatest(1e-6, ref::DOUBLE / sum(ref) OVER (PARTITION BY source)) AS r, greatest(1e-6, cur::DOUBLE / sum(cur) OVER (PARTITION BY source)) AS c FROM p),
n AS (SELECT source, r / sum(r) OVER (PARTITION BY source) AS r, c / sum(c) OVER (PARTITION BY source) AS c FROM s),
d AS (SELECT source, sum((c - r) * ln(c / r)) AS psi FROM n GROUP BY source)
SELECT source, {sql6('psi')} AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'watch' WHEN psi < 0.3 THEN 'drift' ELSE 'severe' END AS grade FROM d
"""


def drift_conditional(spark, sf):
    """How the share of large images moved within each score bin, between a model's halves."""
    e = K.numbered(V.image_score(spark, sf).select("model", "seq", "p4", "width"), ["model"], [F.col("seq").asc()]).withColumn("late", K.tile(F.col("i"), F.col("n"), 2) == 2)
    rows = e.select(F.col("model").alias("source"), F.least(F.floor(F.col("p4") / 2500), F.lit(3)).alias("given"), F.when(F.col("width") >= 200, 1).otherwise(0).alias("outcome"), "late")
    cells = rows.groupBy("source", "given", "outcome").agg(F.count(F.when(~F.col("late"), 1)).alias("ref"), F.count(F.when(F.col("late"), 1)).alias("cur"))
    both = cells.select("source", "given").distinct().withColumn("outcome", F.explode(F.array(F.lit(0), F.lit(1))))
    return S.conditional_kl(both.join(cells, ["source", "given", "outcome"], "left").na.fill(0, ["ref", "cur"])).select("source", q6(F.col("kl")).alias("kl"))


_CONDITIONAL = f"""
, e AS (SELECT model AS source, least(p4 // 2500, 3) AS given, CASE WHEN width >= 200 THEN 1 ELSE 0 END AS outcome, ntile(2) OVER (PARTITION BY model ORDER BY seq) = 2 AS late FROM iv),
c AS (SELECT g.source, g.given, o.outcome, count(*) FILTER (WHERE e.outcome = o.outcome AND NOT late) AS ref, count(*) FILTER (WHERE e.outcome = o.outcome AND late) AS cur FROM (SELECT DISTINCT source, given FROM e) g CROSS JOIN range(0, 2) o(outcome) JOIN e ON e.source = g.source AND e.given = g.given GROUP BY ALL),
s AS (SELECT *, greatest(1e-6, coalesce(ref::DOUBLE / nullif(sum(ref) OVER w, 0), 0)) AS r, greatest(1e-6, coalesce(cur::DOUBLE / nullif(sum(cur) OVER w, 0), 0)) AS q FROM c WINDOW w AS (PARTITION BY source, given)),
n AS (SELECT source, given, ref, r / sum(r) OVER w AS r, q / sum(q) OVER w AS q FROM s WINDOW w AS (PARTITION BY source, given)),
k AS (SELECT source, given, sum(r * ln(r / q)) AS kl, sum(ref) AS n FROM n GROUP BY ALL)
SELECT source, {sql6('sum(kl * n) / sum(n)')} AS kl FROM k GROUP BY source
"""


def drift_psi_kl(spark, sf):
    d = S.histogram_drift(_drift_histograms(spark, sf))
    return d.select("source", q6(F.col("psi")).alias("psi"), q6(F.col("kl")).alias("kl"), "grade")


_DRIFT = f"""
WITH h AS (SELECT model, quantile_disc(seq, 0.5) AS mid FROM iv GROUP BY model),
c AS (SELECT e.model AS source, b.bin, count(*) FILTER (WHERE seq <= mid AND least(p4 // 1000, 9) = b.bin) AS ref, count(*) FILTER (WHERE seq > mid AND least(p4 // 1000, 9) = b.bin) AS cur FROM iv e JOIN h ON e.model = h.model, range(0, 10) b(bin) GROUP BY e.model, b.bin),
s AS (SELECT source, bin, greatest(1e-6, ref::DOUBLE / sum(ref) OVER (PARTITION BY source)) AS r, greatest(1e-6, cur::DOUBLE / sum(cur) OVER (PARTITION BY source)) AS c FROM c),
n AS (SELECT source, r / sum(r) OVER (PARTITION BY source) AS r, c / sum(c) OVER (PARTITION BY source) AS c FROM s),
d AS (SELECT source, sum((c - r) * ln(c / r)) AS psi, sum(r * ln(r / c)) AS kl FROM n GROUP BY source)
SELECT source, {sql6('psi')} AS psi, {sql6('kl')} AS kl, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'watch' WHEN psi < 0.3 THEN 'drift' ELSE 'severe' END AS grade FROM d
"""


def wilson_ci(spark, sf):
    g = V.image_score(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(F.col("p4") >= 5000, 1)).alias("k"))
    lo, hi = S.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.select("model", "n", "k", q6(lo).alias("lo"), q6(hi).alias("hi"))


_Z = "1.959963984540054::DOUBLE"
_WILSON = f"""
SELECT model, n, k, {sql6('c - h')} AS lo, {sql6('c + h')} AS hi FROM (SELECT *, (p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) AS c, {_Z} / (1 + {_Z} * {_Z} / n) * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) AS h
FROM (SELECT model, count(*) AS n, count(*) FILTER (WHERE p4 >= 5000) AS k, (count(*) FILTER (WHERE p4 >= 5000))::DOUBLE / count(*)::DOUBLE AS p FROM iv GROUP BY model))
"""


def grouping_purity(spark, sf):
    """Purity and the members' mean share of their label, of groups by user against event types."""
    e = V.table(spark, sf, "events").select((F.col("user_id") % 20).alias("grp"), F.col("event_type").alias("label"))
    cells = e.groupBy("grp", "label").agg(F.count("*").alias("c"))
    groups = cells.groupBy("grp").agg(F.sum("c").alias("size"), F.max("c").alias("top"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    return groups.agg(F.count("*").alias("n_groups"), q6(F.sum("top") / F.sum("size")).alias("purity"), q6(F.sum(F.col("sq") / F.col("size")) / F.sum("size")).alias("completeness"))


def volatility_interval(spark, sf):
    e = V.image_score(spark, sf).withColumn("fp", F.floor(F.col("p4") / 5000))
    v = S.volatility(e, "site", "seq", "fp")
    return v.select("site", "n", "changes", q6(F.col("volatility")).alias("volatility"), S.interval_hours(F.col("volatility"), F.col("n")).alias("hours"))


_VOL = f"""
SELECT site, n, changes, {sql6('v')} AS volatility, CASE WHEN v >= 0.5 THEN 24.0::DOUBLE WHEN v <= 0.1 AND n >= 3 THEN 96.0::DOUBLE ELSE 48.0::DOUBLE END AS hours
FROM (SELECT site, count(*) AS n, CAST(sum(CASE WHEN fp <> prev THEN 1 ELSE 0 END) AS BIGINT) AS changes, coalesce(sum(CASE WHEN fp <> prev THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*) - 1, 0), 0) AS v
      FROM (SELECT site, p4 // 5000 AS fp, lag(p4 // 5000) OVER (PARTITION BY site ORDER BY seq) AS prev FROM iv) GROUP BY site)
"""


def rescan_decisions(spark, sf):
    """Whether each site is due: first time, changed, or its last score older than a tenth of the time, with the reason."""
    e = V.image_score(spark, sf)
    w = Window.partitionBy("site").orderBy(F.desc("seq"))
    two = e.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= 2).groupBy("site").agg(F.max(F.when(F.col("back") == 1, F.col("p4"))).alias("now4"), F.max(F.when(F.col("back") == 2, F.col("p4"))).alias("before4"), F.max("seq").alias("seq"))
    old = e.agg((F.max("seq") * 0.9).alias("old"))
    reason = F.when(F.col("before4").isNull(), "first").when(F.abs(F.col("now4") - F.col("before4")) >= 3000, "changed").when(F.col("seq") < F.col("old"), "ttl")
    return two.crossJoin(F.broadcast(old)).select("site", reason.isNotNull().alias("due"), F.coalesce(reason, F.lit("fresh")).alias("reason"))


def gap_stats(spark, sf):
    """Gaps between a user's events."""
    e = V.table(spark, sf, "events").select("user_id", "event_id")
    gap = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")) - F.col("event_id")
    return e.withColumn("gap", gap).filter(F.col("gap").isNotNull()).groupBy("user_id").agg(F.count("*").alias("gaps"), F.min("gap").alias("shortest"), F.max("gap").alias("longest"), F.sum("gap").alias("total"))


def _times(spark, sf):
    return V.table(spark, sf, "events").select("user_id", F.col("event_id").cast("double").alias("t"))


def bursts(spark, sf):
    """Bursts of users' events of two levels; no SQL says this, tests compare with all paths of states."""
    b = S.bursts(_times(spark, sf), "user_id", "t")
    return b.select("user_id", "start", "end", "level", q6(F.col("weight")).alias("weight"))


def bursts_nested(spark, sf):
    """The tree of bursts within bursts, of three levels."""
    b = S.bursts(_times(spark, sf), "user_id", "t", levels=3, nested=True)
    return b.select("user_id", "start", "end", "level", q6(F.col("weight")).alias("weight"))


def bursts_tree(spark, sf):
    """Nested bursts with their parents and the number of their children."""
    b = S.burst_tree(S.bursts(_times(spark, sf), "user_id", "t", levels=4, nested=True), "user_id", 4)
    return b.select("user_id", "level", "start", "end", "parent", "children", q6(F.col("weight")).alias("weight"))


def burst_factor_ttl(spark, sf):
    """Rescan times shortened by bursts, as of the last event."""
    e = _times(spark, sf)
    now = e.agg(F.max("t")).first()[0]
    f = S.burst_factor(S.bursts(e, "user_id", "t"), "user_id", F.lit(now))
    return f.select("user_id", q6(F.col("factor")).alias("factor"), q6(S.suggested_ttl(48.0, F.col("factor"))).alias("hours"))


def ttl_calibration(spark, sf):
    """Which half-lives and shares shorten rescans best, played over each user's events; every seventh event is a change to be seen."""
    hours = V.table(spark, sf, "events").select("user_id", "event_id", (F.unix_timestamp("ts") / F.lit(3600.0)).alias("t"))
    spans = hours.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    truths = hours.filter(F.pmod("event_id", F.lit(7)) == 0).select("user_id", F.col("t").alias("at"))
    c = S.calibrate_ttl(S.bursts(hours, "user_id", "t"), spans, truths, "user_id", [6.0, 24.0, 96.0], [0.5, 0.8, 0.9])
    return c.select("half_life", "shrink", "hits", "truths", q6(F.col("hit_rate")).alias("hit_rate"), "rescans", "waste", "pareto")


def first_rescans(spark, sf):
    """The first rescan between two changes: an interval match."""
    e = V.image_score(spark, sf)
    truths = e.filter(F.col("p4") >= 9000).select("site", F.col("seq").alias("at"))
    visits = e.filter(F.pmod("seq", F.lit(3)) == 0).select("site", F.col("seq").alias("at"))
    return S.first_after(truths, visits, "site").withColumn("visit", F.coalesce("visit", F.lit(-1).cast("long")))


_FIRST = """
, t AS (SELECT site, seq AS at, coalesce(lag(seq) OVER (PARTITION BY site ORDER BY seq), -1) AS anchor FROM iv WHERE p4 >= 9000)
SELECT t.site, t.at, coalesce(min(v.seq), -1) AS visit FROM t LEFT JOIN (SELECT site, seq FROM iv WHERE seq % 3 = 0) v ON v.site = t.site AND v.seq > t.anchor AND v.seq <= t.at GROUP BY t.site, t.at
"""


def schedule_priority(spark, sf):
    """.45 volatility + .35 risk + .2 staleness + an age term (.1 here), in hours since each site's last score and since its first."""
    v = volatility_interval(spark, sf).select("site", "volatility")
    e = V.image_score(spark, sf)
    risk = e.groupBy("site").agg(F.max("p4").alias("p4"), F.max("seq").alias("seq"), F.min("seq").alias("seq0"))
    now = e.agg(F.max("seq").alias("now"))
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("now") - F.col(c)) / F.lit(168.0)))
    score = F.lit(0.45) * F.col("volatility") + F.lit(0.35) * (F.col("p4") / F.lit(10000.0)) + F.lit(0.2) * part("seq") + F.lit(0.1) * part("seq0")
    return v.join(risk, "site").crossJoin(F.broadcast(now)).select("site", q6(F.least(F.lit(1.0), score)).alias("priority"))


def select_round(spark, sf):
    e = V.entries(spark, sf).filter(F.col("status") == "pending").select("site", "id", F.col("agg4").cast("double").alias("value"), (F.pmod("id", F.lit(7)) + 1).cast("double").alias("cost"))
    return S.select_round(e.withColumn("site", F.pmod("site", F.lit(50))), "site", "value", "cost", 12.0)


_ROUND = """
WITH RECURSIVE entries AS ({entries}), i AS (SELECT site % 50 AS site, id, agg4::DOUBLE AS value, (id % 7 + 1)::DOUBLE AS cost FROM entries WHERE status = 'pending'),
x AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY value / cost DESC, id) AS n FROM i),
r AS (SELECT DISTINCT site, 0::BIGINT AS n, 12.0::DOUBLE AS rest, NULL::BIGINT AS id, NULL::DOUBLE AS value, NULL::DOUBLE AS cost, false AS taken FROM x
  UNION ALL SELECT x.site, x.n, CASE WHEN x.cost <= rest THEN rest - x.cost ELSE rest END, x.id, x.value, x.cost, x.cost <= rest FROM r JOIN x ON x.site = r.site AND x.n = r.n + 1)
SELECT site, id, value, cost FROM r WHERE taken
"""


def send_gate_counts(spark, sf):
    """Decisions by site: each fingerprint comes once more as a copy."""
    prints = V.fingerprints(spark, sf)
    size = lambda k: F.pmod(F.col("sha") * k, F.lit(400))
    images = prints.select("site", F.explode(F.array(F.col("sha"), F.col("sha") + 1_000_000_000_000)).alias("pos"), F.col("sha").cast("string").alias("sha"), "h", size(37).alias("width"), size(53).alias("height"))
    return S.send_gate(images, "site", "pos", near_bits=6).groupBy("site", "decision").agg(F.count("*").alias("n"))


#: Greedy keeping in order: a fingerprint is kept unless one kept before it is near.
_GREEDY = """
g AS (SELECT site, pos, h, row_number() OVER (PARTITION BY site ORDER BY pos) AS n FROM asked),
r AS (SELECT DISTINCT site, 0::BIGINT AS n, NULL::BIGINT AS pos, CAST([] AS BIT[]) AS kept, false AS sent FROM g
  UNION ALL SELECT g.site, g.n, g.pos, CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k, g.h)) <= 6)) = 0 THEN list_append(kept, g.h) ELSE kept END, len(list_filter(kept, lambda k: bit_count(xor(k, g.h)) <= 6)) = 0 FROM r JOIN g ON g.site = r.site AND g.n = r.n + 1)
"""
_GATE = f"""
, small AS (SELECT site, sha, h, (sha * 37) % 400 < 200 AND (sha * 53) % 400 < 200 AS tiny FROM fingerprints), asked AS (SELECT site, sha AS pos, h FROM small WHERE NOT tiny), {_GREEDY}
SELECT site, decision, count(*) AS n FROM (SELECT site, CASE WHEN sent THEN 'sent' ELSE 'near' END AS decision FROM r WHERE pos IS NOT NULL UNION ALL SELECT site, 'small' FROM small WHERE tiny UNION ALL SELECT site, 'copy' FROM small) GROUP BY ALL
"""


def evidence_pool(spark, sf):
    """Each site's ten best images by score, near copies of better ones left out, with the quotas of two portals."""
    prints = V.fingerprints(spark, sf).withColumn("prob4", F.pmod(F.col("sha") * 7919, F.lit(10000)))
    ranked = prints.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("prob4"), "sha")))
    gate = S.send_gate(ranked.select("site", F.col("pos").cast("long").alias("pos"), F.col("sha").cast("string").alias("sha"), "h", F.lit(400).alias("width"), F.lit(400).alias("height")), "site", "pos", near_bits=6)
    place = F.row_number().over(Window.partitionBy("site").orderBy("pos"))
    pool = gate.filter(F.col("decision") == "sent").withColumn("place", place).filter(F.col("place") <= 10)
    return pool.select("site", F.col("sha").cast("long").alias("sha"), "place", F.when(F.col("place") <= 5, "both").otherwise("first").alias("portals"))


_POOL = f"""
, asked AS (SELECT site, sha, h, row_number() OVER (PARTITION BY site ORDER BY (sha * 7919) % 10000 DESC, sha) AS pos FROM fingerprints), {_GREEDY}
SELECT site, sha, place, CASE WHEN place <= 5 THEN 'both' ELSE 'first' END AS portals FROM (SELECT r.site, a.sha, CAST(row_number() OVER (PARTITION BY r.site ORDER BY r.pos) AS INTEGER) AS place FROM r JOIN asked a ON a.site = r.site AND a.pos = r.pos WHERE sent) WHERE place <= 10
"""


def adaptive_band(spark, sf):
    """Around one half the cheapest band that keeps 60 % of the risk of the static one."""
    e = V.image_score(spark, sf)
    history = e.select((F.col("p4") / F.lit(10000.0)).alias("score"), F.when(F.pmod("seq", F.lit(4)) == 0, 3.0).otherwise(1.0).alias("cost"), (F.pmod("seq", F.lit(4)) == 0).alias("escalated"), F.when(F.pmod("seq", F.lit(3)) == 0, (F.col("p4") >= 5000) == (F.pmod("seq", F.lit(2)) == 0)).alias("correct"))
    return S.adaptive_band(history, 0.15, 0.85, 0.6)


_ADAPTIVE = """
, x AS (SELECT p4 / 10000.0::DOUBLE AS score, CASE WHEN seq % 4 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS cost, seq % 4 = 0 AS escalated, CASE WHEN seq % 3 = 0 THEN (p4 >= 5000) = (seq % 2 = 0) END AS correct FROM iv),
c AS (SELECT count(*) AS n, avg(cost) FILTER (WHERE NOT escalated) AS cheap, avg(cost) FILTER (WHERE escalated) - avg(cost) FILTER (WHERE NOT escalated) AS more, (count(*) FILTER (WHERE escalated AND correct = false) + 1)::DOUBLE / (count(*) FILTER (WHERE escalated AND correct IS NOT NULL) + 2) AS lft FROM x),
m AS (SELECT abs(score - 0.5::DOUBLE) AS off, greatest(0.0::DOUBLE, CASE WHEN NOT escalated AND correct IS NOT NULL THEN CASE WHEN correct THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE 1 - abs(2 * score - 1) END - lft) AS mass FROM x, c WHERE abs(score - 0.5::DOUBLE) <= 0.35::DOUBLE + 1e-12),
g AS (SELECT k, coalesce(sum(mass) FILTER (WHERE off <= 0.35::DOUBLE / 20 * k + 1e-12), 0) AS covered, count(*) FILTER (WHERE off <= 0.35::DOUBLE / 20 * k + 1e-12) AS inside, sum(mass) AS total FROM range(1, 21) r(k), m GROUP BY k),
b AS (SELECT k FROM g, c WHERE covered + 1e-12 >= 0.6::DOUBLE * total ORDER BY cheap + more * inside / n, -k LIMIT 1)
SELECT round(greatest(0.0::DOUBLE, 0.5::DOUBLE - w), 6) AS below, round(least(1.0::DOUBLE, 0.5::DOUBLE + w), 6) AS above, k FROM (SELECT CAST(k AS INTEGER) AS k, least(greatest(k * (0.35::DOUBLE / 20), 0.35::DOUBLE * 0.8::DOUBLE), 0.35::DOUBLE) AS w FROM b)
"""


def number_grounding(spark, sf):
    """Numbers in a note that no fact states at two places."""
    docs = V.table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    numbers = F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    shown = F.transform(numbers, lambda x: D.half_up(x.cast("double"), 2))
    facts = F.array(F.col("n_chars").cast("double"))
    return docs.select("doc_id", F.size(numbers).cast("long").alias("numbers"), F.size(F.array_except(shown, facts)).cast("long").alias("ungrounded"))


def guard_parse(spark, sf):
    """Verdict and category codes of a guard model's lines."""
    docs = V.table(spark, sf, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("unsafe\nS"), F.pmod("doc_id", F.lit(11)).cast("string"), F.lit(",S2"))).otherwise("safe").alias("line"))
    return docs.select("doc_id", F.regexp_extract("line", r"^\s*(safe|unsafe)", 1).alias("verdict"), F.concat_ws(",", F.regexp_extract_all("line", F.lit(r"(S[0-9]+)"), F.lit(1))).alias("codes"))


def frame_samples(spark, sf):
    """Indices of k frames spread over n, half-even."""
    n = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 5).cast("long").alias("n"))
    return n.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(4.0), 0).cast("long"))).alias("frame"))


def array_math(spark, sf):
    """Norm, dot with ones, softmax of the first and standardised last component."""
    e = V.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    added = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.size("v").cast("double")
    mean = added("v") / n
    var = added(F.transform("v", lambda x: (x - mean) * (x - mean))) / n
    top = F.array_max("v")
    soft = F.exp(F.col("v")[0] - top) / added(F.transform("v", lambda x: F.exp(x - top)))
    z = F.when(var > 0, (F.element_at("v", -1) - mean) / F.sqrt(var)).otherwise(0.0)
    return e.select("vec_id", *[D.half_up(c, 5).alias(k) for k, c in (("norm", F.sqrt(added(F.transform("v", lambda x: x * x)))), ("total", added("v")), ("softmax0", soft), ("last_z", z))])


def _iv(sql: str, **more: str) -> str:
    """``sql`` with the image scores as iv."""
    head = with_views("", "IMAGE_SCORE").strip()
    extra = "".join(f", {k} AS ({v})" for k, v in more.items())
    body = sql.strip()
    body = ", " + body[5:] if body.startswith("WITH ") else " " + body
    return f"{head}, iv AS (SELECT * FROM image_score){extra}{body}"


def _on_labels(sql: str, **more: str) -> str:
    return with_views(sql, "LABELLED", **more)


QUERIES = {
    "sprt_decisions": (sprt_decisions, _iv(_SPRT.replace("WITH image_score AS (SELECT * FROM iv), r AS", "WITH r AS"))),
    "conf_sequence": (conf_sequence, _iv(f"SELECT site, seq, n, {sql6('mean')} AS mean, {sql6('radius')} AS radius FROM conf", conf=_CONF)),
    "ci_band_stop": (ci_band_stop, _iv(_BAND, conf=_CONF)),
    "mixture_sprt": (mixture_sprt, _iv("").strip() + _MIXTURE),
    "brier_weights": (brier_weights, _iv(_BRIER)),
    "bayes_weights": (bayes_weights, _iv(_BAYES)),
    "bayes_checkpointed": (bayes_checkpointed, _iv(_CHECKPOINTED)),
    "bayes_folded": (bayes_folded, _iv(_CHECKPOINTED)),
    "brier_ece": (brier_ece, _on_labels(f"SELECT n, {sql6('brier')} AS brier, {sql6('gap / n')} AS ece FROM (SELECT avg((p4 / 10000.0::DOUBLE - label) * (p4 / 10000.0::DOUBLE - label)) AS brier FROM labelled), (SELECT sum(n * abs(avg_prob - freq)) AS gap, CAST(sum(n) AS BIGINT) AS n FROM bins)", bins=_BINS)),
    "reliability_bins": (reliability_bins, _on_labels("SELECT bin, n, floor(avg_prob * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS avg_prob, floor(freq * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS freq FROM bins", bins=_BINS)),
    "confusion_grid": (confusion_grid, _on_labels(_CONFUSION)),
    "confusion_by_source": (confusion_by_source, _on_labels(f"SELECT source_kind, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, {sql6('avg((p4 / 10000.0::DOUBLE - label) * (p4 / 10000.0::DOUBLE - label))')} AS brier, count(*) FILTER (WHERE p4 >= 9000 AND label = 0) AS fp, count(*) FILTER (WHERE p4 < 9000 AND label = 1) AS fn FROM labelled GROUP BY source_kind")),
    "pr_curve": (pr_curve, _on_labels(f"SELECT p4, CAST(selected AS BIGINT) AS selected, CAST(hits AS BIGINT) AS hits, {sql6('hits::DOUBLE / selected')} AS precision, {sql6('hits::DOUBLE / total')} AS recall FROM suf", suf=_SUFFIX)),
    "suggest_threshold": (suggest_threshold, _on_labels(f"SELECT p4, f1 FROM (SELECT p4, {sql6('2.0::DOUBLE * hits / (selected + total)')} AS f1 FROM suf) ORDER BY f1 DESC, p4 DESC LIMIT 1", suf=_SUFFIX)),
    "auc": (auc, _on_labels(f"SELECT {sql6('(SELECT sum(CASE WHEN a.p4 > b.p4 THEN 1.0::DOUBLE WHEN a.p4 = b.p4 THEN 0.5::DOUBLE ELSE 0 END) FROM labelled a, labelled b WHERE a.label = 1 AND b.label = 0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))')} AS auc, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM labelled")),
    "conformal_threshold": (conformal_threshold, with_views("", "LABELLED").strip() + _CONFORMAL),
    "conformal_selected": (conformal_selected, _on_labels("SELECT doc_id, p4 FROM labelled WHERE p4 >= 9000")),
    "drift_interval": (drift_interval, None),
    "drift_by_window": (drift_by_window, _iv("").strip() + _WINDOWS),
    "drift_conditional": (drift_conditional, _iv("").strip() + _CONDITIONAL),
    "drift_psi_kl": (drift_psi_kl, _iv(_DRIFT)),
    "wilson_ci": (wilson_ci, _iv(_WILSON)),
    "grouping_purity": (grouping_purity, f"SELECT count(*) AS n_groups, {sql6('sum(top)::DOUBLE / sum(size)')} AS purity, {sql6('sum(sq::DOUBLE / size) / sum(size)')} AS completeness FROM (SELECT grp, sum(c) AS size, max(c) AS top, sum(c * c) AS sq FROM (SELECT user_id % 20 AS grp, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY grp)"),
    "volatility_interval": (volatility_interval, _iv(_VOL)),
    "rescan_decisions": (rescan_decisions, _iv("SELECT site, reason IS NOT NULL AS due, coalesce(reason, 'fresh') AS reason FROM (SELECT site, CASE WHEN before4 IS NULL THEN 'first' WHEN abs(now4 - before4) >= 3000 THEN 'changed' WHEN seq < (SELECT max(seq) * 0.9::DOUBLE FROM iv) THEN 'ttl' END AS reason FROM (SELECT site, max(p4) FILTER (WHERE back = 1) AS now4, max(p4) FILTER (WHERE back = 2) AS before4, max(seq) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq DESC) AS back FROM iv) WHERE back <= 2 GROUP BY site))")),
    "gap_stats": (gap_stats, "SELECT user_id, count(*) AS gaps, min(gap) AS shortest, max(gap) AS longest, CAST(sum(gap) AS BIGINT) AS total FROM (SELECT user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id"),
    "next_images": (next_images, _iv(_NEXT + "SELECT site, seq, nth, state FROM n WHERE settled = 0")),
    "next_images_budget": (next_images_budget, _iv(_NEXT + "SELECT site, seq, nth, state FROM (SELECT *, row_number() OVER (ORDER BY nth, site) AS place FROM n WHERE settled = 0) WHERE place <= (SELECT count(*) // 20 FROM iv)")),
    "bursts": (bursts, None),
    "bursts_nested": (bursts_nested, None),
    "bursts_tree": (bursts_tree, None),
    "burst_factor_ttl": (burst_factor_ttl, None),
    "ttl_calibration": (ttl_calibration, None),
    "first_rescans": (first_rescans, _iv("").strip() + _FIRST),
    "schedule_priority": (schedule_priority, _iv(f"SELECT r.site, {sql6('least(1.0::DOUBLE, 0.45::DOUBLE * volatility + 0.35::DOUBLE * (p4 / 10000.0::DOUBLE) + 0.2::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (now - seq) / 168.0::DOUBLE)) + 0.1::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (now - seq0) / 168.0::DOUBLE)))')} AS priority FROM vol JOIN (SELECT site, max(p4) AS p4, max(seq) AS seq, min(seq) AS seq0 FROM iv GROUP BY site) r ON vol.site = r.site, (SELECT max(seq) AS now FROM iv)", vol=_VOL)),
    "select_round": (select_round, _ROUND.replace("{entries}", ENTRIES)),
    "send_gate_counts": (send_gate_counts, with_views("", "FINGERPRINTS").replace("WITH ", "WITH RECURSIVE ", 1).strip() + _GATE),
    "evidence_pool": (evidence_pool, with_views("", "FINGERPRINTS").replace("WITH ", "WITH RECURSIVE ", 1).strip() + _POOL),
    "adaptive_band": (adaptive_band, _iv("").strip() + _ADAPTIVE),
    "number_grounding": (number_grounding, "SELECT doc_id, len(nums) AS numbers, len(list_filter(list_distinct(list_transform(nums, lambda x: floor(CAST(x AS DOUBLE) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE)), lambda x: x <> n_chars::DOUBLE)) AS ungrounded FROM (SELECT doc_id, n_chars, regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?') AS nums FROM documents)"),
    "guard_parse": (guard_parse, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unsafe' ELSE 'safe' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN 'S' || (doc_id % 11) || ',S2' ELSE '' END AS codes FROM documents"),
    "frame_samples": (frame_samples, "SELECT p_partkey AS id, CAST(round_even(i * (p_size + 5 - 1) / 4.0::DOUBLE, 0) AS BIGINT) AS frame FROM part, range(0, 5) r(i)"),
    "array_math": (array_math, "SELECT vec_id, floor(norm * 1e5 + 0.5) / 1e5 AS norm, floor(total * 1e5 + 0.5) / 1e5 AS total, floor(exp(v[1] - top) / es * 1e5 + 0.5) / 1e5 AS softmax0, floor((v[-1] - mean) / sqrt(var) * 1e5 + 0.5) / 1e5 AS last_z FROM (SELECT vec_id, v, list_max(v) AS top, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm, list_sum(v) AS total, list_sum(v) / len(v) AS mean, list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS es, list_sum(list_transform(v, lambda x: (x - list_sum(v) / len(v)) * (x - list_sum(v) / len(v)))) / len(v) AS var FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"),
}
