"""Score fusion, verdicts, policy rules, triage, abstention and provider agreement."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts from mild to severe.
VERDICTS = ("clean", "suspect", "nsfw")


def rank_of(verdict: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in enumerate(VERDICTS) for x in (F.lit(v), F.lit(k))]), verdict), F.lit(0))


def half_up(x: Column, digits: int) -> Column:
    """x rounded half up at ``digits`` decimals, in plain double arithmetic."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def last_per(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key that was written last (max aggregation, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def ensemble(scores: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """Per site and path the weighted mean of each model's last score.

    Models without a weight count 1.  ``scores``: site, path, model, p4, width,
    height, seq.  Result: prob, members, and the size of the last scored row.
    """
    w = F.lit(1)
    for model, weight in (weights or {}).items():
        w = F.when(F.col("model") == model, F.lit(weight)).otherwise(w)
    last = last_per(scores.select("site", "path", "model", "p4", "width", "height", "seq"), ["site", "path", "model"], "seq").withColumn("w", w)
    total = F.sum("w")
    mean = F.when(total > 0, F.sum(F.col("w") * F.col("p4")) / total).otherwise(F.avg("p4")) / F.lit(10000.0)
    return last.groupBy("site", "path").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("prob"),
        F.count("*").alias("members"),
        F.max_by("width", "seq").alias("width"),
        F.max_by("height", "seq").alias("height"),
    )


def assess(images: DataFrame, nsfw: float = 0.9, review: float = 0.5, count_line: float = 0.8, least_images: int = 3, least_px: int = 200) -> DataFrame:
    """Per site: agg, count, verdict and whether it needs review.

    Images count when either side has ``least_px``; agg is their highest
    probability, 0 without any.
    """
    counted = (F.col("width") >= least_px) | (F.col("height") >= least_px)
    agg = F.coalesce(F.max(F.when(counted, F.col("prob"))), F.lit(0.0))
    hits = F.count(F.when(counted & (F.col("prob") >= count_line), 1))
    rated = images.groupBy("site").agg(agg.alias("agg"), hits.alias("hits"))
    verdict = F.when((F.col("agg") >= nsfw) & (F.col("hits") >= least_images), "nsfw").when(F.col("agg") >= review, "suspect").otherwise("clean")
    return rated.withColumn("verdict", verdict).withColumn("needs_review", F.col("verdict") != "clean")


def fuse(sites: DataFrame, page: Column, url: Column, text: Column) -> DataFrame:
    """``sites`` (agg, hits, verdict) with the fused score; a verdict only gets more severe.

    ``page``, ``url`` and ``text`` may be null.  A missing page score keeps half
    of its weight at 0.5 when any other aid is there; then the weights of what
    is there are scaled to the full sum.
    """
    image_w, page_w, url_w, text_w, bias = 2.2, 1.2, 0.35, 0.45, -2.0
    some = page.isNotNull() | url.isNotNull() | text.isNotNull()
    lacks = page.isNull() | url.isNull() | text.isNull()
    there = F.lit(image_w) + F.when(page.isNull(), F.lit(page_w / 2)).otherwise(F.lit(page_w)) + F.when(url.isNull(), 0.0).otherwise(F.lit(url_w)) + F.when(text.isNull(), 0.0).otherwise(F.lit(text_w))
    total = F.lit(image_w + page_w + url_w + text_w)
    scale = F.when(lacks, total / there).otherwise(F.lit(1.0))
    drive = F.lit(image_w) * F.col("agg") + F.when(page.isNull(), F.lit(page_w / 2 * 0.5)).otherwise(F.lit(page_w) * page) + F.coalesce(F.lit(url_w) * url, F.lit(0.0)) + F.coalesce(F.lit(text_w) * text, F.lit(0.0))
    z = F.lit(bias) + scale * drive
    fused = F.when(some, F.greatest(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), F.col("agg"))).otherwise(F.col("agg"))
    made = F.when((fused >= 0.9) & (F.col("hits") >= 3), "nsfw").when(fused >= 0.5, "suspect").otherwise("clean")
    worse = F.when(rank_of(made) > rank_of(F.col("verdict")), made).otherwise(F.col("verdict"))
    return sites.withColumn("fused", fused).withColumn("verdict", worse)


def reliable_weights(brier: DataFrame, least: int = 5, eps: float = 0.05) -> DataFrame:
    """provider, n, brier -> weight: 1 / (brier + eps), normed over providers of at least ``least`` rows, else null."""
    raw = F.when(F.col("n") >= least, F.lit(1.0) / (F.col("brier") + F.lit(eps)))
    everything = Window.partitionBy(F.lit(0))  # one row per provider
    return brier.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.sum("raw").over(everything)).drop("raw")


def member_weights(members: DataFrame, weights: DataFrame) -> DataFrame:
    """(provider, weight) of the members, norming to 1: known weights, the mean of those for the others, all alike if none is known.

    ``weights``: provider, weight (null: too few rows).  One row a provider.
    """
    known = weights.filter(F.col("weight").isNotNull()).select("provider", "weight")
    mean = known.agg(F.avg("weight").alias("mean"))
    filled = members.select("provider").distinct().join(known, "provider", "left").crossJoin(F.broadcast(mean)).select("provider", F.coalesce("weight", "mean", F.lit(1.0)).alias("raw"))
    return filled.select("provider", (F.col("raw") / F.sum("raw").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def reliable_aggs(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """site, agg: the mean of each site's providers' mean scores, weighed by reliability.

    ``scores``: site, provider, p4; ``weights``: provider, weight (null: too few
    rows).  A provider's share doesn't grow with its images.  A provider without
    a weight takes the mean of those that the site has; without any, all are alike.
    """
    means = scores.groupBy("site", "provider").agg((F.avg("p4") / F.lit(10000.0)).alias("mean")).join(weights.select("provider", "weight"), "provider", "left")
    at = Window.partitionBy("site")
    used = means.withColumn("w", F.coalesce("weight", F.avg("weight").over(at), F.lit(1.0)))
    return used.groupBy("site").agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("agg"))


def fuse_reliable(sites: DataFrame, aggs: DataFrame, page: Column, url: Column, text: Column) -> DataFrame:
    """As fuse(), with the reliability-weighed score in the place of the images'; sites without one keep theirs."""
    own = sites.join(aggs.withColumnRenamed("agg", "agg_reliable"), "site", "left").withColumn("agg_images", F.col("agg"))
    fused = fuse(own.withColumn("agg", F.coalesce("agg_reliable", "agg")), page, url, text)
    return fused.withColumn("agg_reliable", F.col("agg")).withColumn("agg", F.col("agg_images")).drop("agg_images").withColumn("needs_review", F.col("needs_review") | (F.col("verdict") != "clean"))


def rules_digest(rules: Sequence[Mapping]) -> str:
    """SHA-256 of rules as canonical JSON, for audit rows."""
    return hashlib.sha256(json.dumps([dict(r) for r in rules], sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def policy(reports: DataFrame, rules: Sequence[Mapping], fallback: str = "queue") -> DataFrame:
    """``action`` and ``rule`` of the first rule whose conditions all hold.

    Conditions: verdict (a set), min_agg, min_url_risk (null risk fails),
    needs_review.  Rules become one CASE expression.
    """
    action: Column | None = None
    name: Column | None = None
    for rule in rules:
        holds = F.lit(True)
        if "verdict" in rule:
            holds &= F.col("verdict").isin(*rule["verdict"])
        if "min_agg" in rule:
            holds &= F.col("agg") >= rule["min_agg"]
        if "min_url_risk" in rule:
            holds &= F.coalesce(F.col("url_risk") >= rule["min_url_risk"], F.lit(False))
        if "needs_review" in rule:
            holds &= F.col("needs_review") == rule["needs_review"]
        action = F.when(holds, rule["action"]) if action is None else action.when(holds, rule["action"])
        name = F.when(holds, rule["name"]) if name is None else name.when(holds, rule["name"])
    return reports.withColumn("action", action.otherwise(fallback) if action is not None else F.lit(fallback)).withColumn("rule", name.otherwise("fallback") if name is not None else F.lit("fallback"))


def overturn_stats(entries: DataFrame) -> DataFrame:
    """Per verdict: resolved n, overturned o, and (o + 1) / (n + 2)."""
    resolved = entries.filter(F.col("status").isin("approved", "rejected", "submitted"))
    over = F.when(F.col("verdict") == "clean", F.col("status") != "rejected").otherwise(F.col("status") == "rejected")
    return resolved.groupBy("verdict").agg(F.count("*").alias("n"), F.count(F.when(over, 1)).alias("o")).withColumn("p_overturn", (F.col("o") + 1) / (F.col("n") + 2))


def triage(entries: DataFrame, now: Column, boost: Column | None = None) -> DataFrame:
    """Pending entries with their priority: .4 p + .3 harm + .1 overturn + .2 age.

    Age is hours / 72, clipped to 0..1; a verdict without history takes the
    overturn share of all verdicts.
    """
    stats = overturn_stats(entries)
    overall = stats.agg(((F.sum("o") + 1) / (F.sum("n") + 2)).alias("p_all"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / F.lit(3600.0)
    age = F.least(F.lit(1.0), F.greatest(F.lit(0.0), hours / F.lit(72.0)))
    proxy = F.when(F.col("verdict") == "nsfw", 0.9).when(F.col("verdict") == "suspect", 0.5).otherwise(0.0)
    p = F.coalesce(F.col("agg4") / F.lit(10000.0), proxy)
    waiting = entries.filter(F.col("status") == "pending").join(F.broadcast(stats.select("verdict", "p_overturn")), "verdict", "left").crossJoin(F.broadcast(overall))
    score = F.lit(0.4) * p + F.lit(0.3) * proxy + F.lit(0.1) * F.coalesce("p_overturn", "p_all") + F.lit(0.2) * age
    return waiting.withColumn("priority", score if boost is None else score + boost)


#: Measures of disagreement by name: functions from a column of scores to an aggregate.
METRICS: dict[str, Callable[[Column], Column]] = {"range": lambda x: F.max(x) - F.min(x), "std": F.stddev_pop}


def disagreement(scores: DataFrame, metric: str | Callable[[Column], Column] = "range") -> DataFrame:
    """Per image: n and d by a named measure or one of the caller's; 0 for one score."""
    x = F.col("p4") / F.lit(10000.0)
    d = (METRICS[metric] if isinstance(metric, str) else metric)(x)
    return scores.groupBy("site", "path").agg(F.count("*").alias("n"), d.alias("d"))


def abstains(d: Column, n: Column, threshold: float = 0.35) -> Column:
    return (n > 1) & (d >= threshold)


def sweep(images: DataFrame, steps: int = 20) -> DataFrame:
    """For each confidence t = k / steps: rows kept (d <= 1 - t) and how many of them are wrong.

    ``images``: d and wrong (0/1).  One pass: each row is counted in the grid
    cell of the largest t that keeps it, and cells are summed from the top.
    """
    cell = F.least(F.lit(steps), F.floor((F.lit(1.0) - F.col("d")) * steps + F.lit(1e-9))).cast("int")
    cells = images.groupBy(cell.alias("k")).agg(F.count("*").alias("n"), F.sum("wrong").alias("w"))
    grid = images.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    full = grid.join(cells, "k", "left").na.fill(0, ["n", "w"])
    above = Window.orderBy(F.desc("k"))  # steps + 1 rows
    return full.select("k", F.sum("n").over(above).alias("kept"), F.sum("w").over(above).alias("wrong"))


def scan_plan(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``pages`` (pos, url, key, print) with a decision: duplicate of an earlier page of the key, unchanged, or scan.

    ``known``: key, print.  Urls without a key stand for themselves and are
    always scanned.
    """
    own = pages.withColumn("site", F.when(F.coalesce(F.col("key"), F.lit("")) != "", F.col("key")).otherwise(F.col("url")))
    first = own.groupBy("site").agg(F.min("pos").alias("first"))
    before = known.select("key", F.col("print").alias("known_print"))
    kind = F.when(F.col("pos") != F.col("first"), "duplicate").when((F.col("key") != "") & (F.col("print") == F.col("known_print")), "unchanged").otherwise("scan")
    return own.join(first, "site").join(before, "key", "left").withColumn("decision", kind).select(*pages.columns, "decision")


def kernel_gate(labelled: DataFrame) -> DataFrame:
    """rule, holds, digest: whether labelled rows (label, p4) allow automatic stops.

    Twenty of each class, calibration error at most .10, Brier score at most .20,
    at most a tenth of positives under .9 and of negatives at .5 or more.  An
    approval holds for the digest of these figures (Brier score and error in
    ten-thousandths, canonical JSON), so new rows need a new one.
    """
    from lumasift.operators.sequential import reliability_bins

    p, y = F.col("p4") / F.lit(10000.0), F.col("label")
    one = labelled.agg(
        F.sum("label").alias("pos"),
        F.count(F.when(y == 0, 1)).alias("neg"),
        half_up(F.avg((p - y) * (p - y)), 4).alias("brier"),
        F.count(F.when((F.col("p4") < 9000) & (y == 1), 1)).alias("fn"),
        F.count(F.when((F.col("p4") >= 5000) & (y == 0), 1)).alias("fp"),
    )
    bins = reliability_bins(labelled, p, y)
    ece = bins.agg(half_up(F.sum(F.col("n") * F.abs(F.col("avg_prob") - F.col("freq"))) / F.sum("n"), 4).alias("ece"))
    figures = {"brier": F.floor(F.col("brier") * 10000 + 0.5), "ece": F.floor(F.col("ece") * 10000 + 0.5), **{k: F.col(k) for k in ("fn", "fp", "neg", "pos")}}
    rules = {
        "enough": (F.col("pos") >= 20) & (F.col("neg") >= 20),
        "ece": F.col("ece") <= 0.1,
        "brier": F.col("brier") <= 0.2,
        "fn": F.col("fn") <= 0.1 * F.col("pos"),
        "fp": F.col("fp") <= 0.1 * F.col("neg"),
    }
    made = F.array(*[F.struct(F.lit(k).alias("rule"), c.alias("holds")) for k, c in rules.items()])
    digest = F.sha2(F.to_json(F.struct(*[c.cast("long").alias(k) for k, c in figures.items()])), 256)
    return one.crossJoin(ece).select(F.explode(made).alias("x"), digest.alias("digest")).select("x.rule", "x.holds", "digest")


#: Classifiers by name: functions from a column of file names or urls to a probability.
CLASSIFIERS: dict[str, Callable[[Column], Column]] = {}


def classifier(name: str) -> Callable:
    """Registers a function from a column to a probability column."""

    def register(made: Callable[[Column], Column]) -> Callable[[Column], Column]:
        CLASSIFIERS[name] = made
        return made

    return register


@classifier("stub")
def stub(name: Column) -> Column:
    """From words in a file name."""
    return F.when(name.rlike("(?i)pill|cheap"), 0.95).when(name.rlike("(?i)spam|blog"), 0.6).otherwise(0.05)


def classify(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """``rows`` with a column of each named classifier; an unknown name is an error."""
    unknown = [n for n in names if n not in CLASSIFIERS]
    if unknown:
        raise ValueError(f"no classifier is called {', '.join(unknown)}")
    return rows.withColumns({n: CLASSIFIERS[n](F.col(column)) for n in names})


def route(scores: DataFrame, band: Callable[[Column], tuple[Column, Column]], key: str = "model") -> DataFrame:
    """Per key how many scores lie in the band that ``band`` gives for it: these go to the costly model."""
    p = F.col("p4") / F.lit(10000.0)
    low, high = band(F.col(key))
    return scores.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(p.between(low, high), 1)).alias("escalated"))
