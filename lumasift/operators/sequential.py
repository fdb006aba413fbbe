"""Sequential tests, reliability, calibration, drift, bursts and schedules."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumasift.operators.ranks import numbered
from lumasift.operators.similarity import hamming_join
from lumasift.scratch import saved

# -- sequential tests -----------------------------------------------------------------------------


def sprt(scores: DataFrame, key: str, order: str, p: Column, alpha: float = 0.05, beta: float = 0.05, p0: float = 0.5, p1: float = 0.9) -> DataFrame:
    """Per key the state of Wald's test over its scores in order, and how many it took.

    The running log-likelihood ratio is a window sum; the first crossing
    settles the state (min_by), so later scores don't count.
    """
    x = F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))
    up, down = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    llr = x * F.lit(math.log(p1 / p0)) + (1 - x) * F.lit(math.log((1 - p1) / (1 - p0)))
    w = Window.partitionBy(key).orderBy(order)
    run = scores.select(key, order, llr.alias("llr")).withColumn("n", F.row_number().over(w)).withColumn("total", F.sum("llr").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(F.col("total") >= up, "nsfw").when(F.col("total") <= down, "clean")
    crossed = run.withColumn("state", state)
    hit = F.when(F.col("state").isNotNull(), F.col("n"))
    return crossed.groupBy(key).agg(F.coalesce(F.min_by("state", hit), F.lit("undecided")).alias("state"), F.coalesce(F.min(hit), F.max("n")).alias("used"))


def next_images(scores: DataFrame, key: str, image: str, p: Column, max_send: int = 8, budget: int | None = None, alpha: float = 0.05, beta: float = 0.05) -> DataFrame:
    """key, image, nth, state: images to look at, the least certain of a key first, until its test settles.

    A key sends at most ``max_send``; ``state`` is its test's after the image.
    A ``budget`` over all keys is spent in rounds: every open key's next image,
    keys in order, as long as it lasts.  Only a key's first images are ranked on,
    and rounds are numbered by counts, so neither a large key nor a large round is
    sorted by one task beyond its ``max_send`` rows.
    """
    # distances that differ in rounding alone are ties, which go to the smaller image
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round(F.abs(F.col("p") - 0.5), 9), image))
    first = scores.select(key, image, p.alias("p")).withColumn("nth", rank).filter(F.col("nth") <= max_send)
    x = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("p")))
    up, down = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    llr = x * F.lit(math.log(0.9 / 0.5)) + (1 - x) * F.lit(math.log((1 - 0.9) / (1 - 0.5)))
    before = Window.partitionBy(key).orderBy("nth")
    run = first.withColumn("total", F.sum(llr).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("state", F.when(F.col("total") >= up, "nsfw").when(F.col("total") <= down, "clean").otherwise("continue"))
    settled = F.coalesce(F.max(F.when(F.col("state") != "continue", 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sent = run.withColumn("settled", settled).filter("settled = 0").select(key, image, "nth", "state")
    if budget is None:
        return sent
    sent = saved(sent, "next-images")
    rounds = sent.groupBy("nth").count().orderBy("nth").collect()  # one row a round, max_send at most
    left, whole = budget, 0
    for r in rounds:
        if r["count"] > left:
            break
        left, whole = left - r["count"], r["nth"]
    last = sent.filter(F.col("nth") == whole + 1).orderBy(key).limit(left) if left else sent.limit(0)
    return sent.filter(F.col("nth") <= whole).unionByName(last)


def confidence_sequence(scores: DataFrame, key: str, order: str, p: Column, delta: float = 0.05) -> DataFrame:
    """Running mean with the stitched radius after each score."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = scores.select(key, order, p.alias("p")).withColumn("n", F.count("*").over(w)).withColumn("sum4", F.sum(F.floor(F.col("p") * 10000 + 0.5)).over(w))
    k = F.when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    m = F.pow(F.lit(2.0), k)
    radius = F.sqrt(F.log(F.lit(4.0) * m / (F.lit(delta) / F.pow(F.lit(2.0), k + 1))) / (2 * F.col("n")))
    mean = F.col("sum4") / F.col("n") / F.lit(10000.0)
    return run.select(key, order, "n", mean.alias("mean"), radius.alias("radius"))


def band_stop(sequence: DataFrame, key: str, nsfw_above: float = 0.5, clean_below: float = 0.5) -> DataFrame:
    """The first n at which the whole interval lies above or below."""
    state = F.when(F.col("mean") - F.col("radius") > nsfw_above, "nsfw").when(F.col("mean") + F.col("radius") < clean_below, "clean")
    hit = F.when(state.isNotNull(), F.col("n"))
    return sequence.groupBy(key).agg(F.coalesce(F.min_by(state, hit), F.lit("undecided")).alias("state"), F.coalesce(F.min(hit), F.max("n")).alias("used"))


def mixture_evalue(scores: DataFrame, key: str, order: str, outcome: Column, p0: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Beta-mixture e-value (Jeffreys prior) per key; n and successes are window sums.

    Stops at the first log e-value of at least -ln(alpha).  lgamma has no
    built-in, so it is a vectorised function of (n, s).
    """

    @F.pandas_udf("double")
    def log_e(n: pd.Series, s: pd.Series) -> pd.Series:
        def lgamma(x: pd.Series) -> np.ndarray:
            known, at = np.unique(x.to_numpy(), return_inverse=True)
            return np.array([math.lgamma(v) for v in known])[at]

        half = 2 * math.lgamma(0.5) - math.lgamma(1.0)
        return lgamma(s + 0.5) + lgamma(n - s + 0.5) - lgamma(n + 1) - half - s * math.log(p0) - (n - s) * math.log(1 - p0)

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = scores.select(key, order, outcome.cast("long").alias("y")).withColumn("n", F.count("*").over(w)).withColumn("s", F.sum("y").over(w))
    tested = run.withColumn("log_e", log_e("n", "s"))
    hit = F.when(F.col("log_e") >= -math.log(alpha), F.col("n"))
    side = F.when(F.col("s") / F.col("n") > p0, "nsfw").otherwise("clean")
    return tested.groupBy(key).agg(F.coalesce(F.min_by(side, hit), F.lit("undecided")).alias("state"), F.coalesce(F.min(hit), F.max("n")).alias("used"), F.max_by("log_e", "n").alias("last_log_e"))


def bayes_weights(rows: DataFrame, as_of: Column, half_life: float, kappa: float = 10.0) -> DataFrame:
    """Reliability of each provider from (provider, correct, t), older rows fading by half-lives.

    Rows after ``as_of`` don't count.  Means shrink to the pool's: fully under
    five effective rows, else by kappa / (kappa + n).
    """
    w = F.exp(F.lit(-math.log(2.0)) * (as_of - F.col("t")) / F.lit(float(half_life)))
    past = rows.filter(F.col("t") <= as_of).withColumn("w", w)
    own = past.groupBy("provider").agg(F.sum(F.when(F.col("correct"), F.col("w")).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("correct"), 0.0).otherwise(F.col("w"))).alias("bad"))
    return _shrunk(own, kappa)


# -- calibration and drift ------------------------------------------------------------------------


def reliability_bins(df: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """Bins [lo, hi), the last one closed; empty bins count 0."""
    k = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    found = df.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("avg_prob"), F.avg(y.cast("double")).alias("freq"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, "bin", "left").na.fill(0, ["n"]).na.fill(0.0, ["avg_prob", "freq"])


def confusion(df: DataFrame, p4: Column, y: Column, thresholds4: list[int]) -> DataFrame:
    """tp, fp, fn, tn and rates at each threshold (ten-thousandths), in one pass over the rows."""
    hit = lambda t, cond: F.count(F.when((p4 >= t) & cond, 1))
    cells = []
    for t in thresholds4:
        cells.append(F.struct(F.lit(t).alias("threshold4"), hit(t, y == 1).alias("tp"), hit(t, y == 0).alias("fp"), F.count(F.when((p4 < t) & (y == 1), 1)).alias("fn"), F.count(F.when((p4 < t) & (y == 0), 1)).alias("tn")))
    one = df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return one.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fp_rate"), ratio(fn, tp + fn).alias("fn_rate"))


def suffix_counts(df: DataFrame, p4: str, y: str) -> DataFrame:
    """For each distinct score the rows and positives at or above it.

    Scores are counted first, so the running sums go over distinct scores only
    (at most 10001 of ten-thousandths).
    """
    levels = df.groupBy(p4).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    above = Window.orderBy(F.desc(p4)).rowsBetween(Window.unboundedPreceding, 0)
    return levels.select(p4, F.sum("n").over(above).alias("selected"), F.sum("pos").over(above).alias("hits"))


def auc(df: DataFrame, p4: str, y: str) -> DataFrame:
    """Mann-Whitney AUC, ties counting half, from counts by distinct score."""
    levels = df.groupBy(p4).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy(p4).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = levels.withColumn("twice", F.col("pos") * (2 * below + F.col("neg")))
    return wins.agg((F.sum("twice") / (2.0 * F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def histogram_drift(hist: DataFrame, eps: float = 1e-6) -> DataFrame:
    """PSI and KL of each source's current histogram against its reference.

    ``hist``: source, ref and cur (arrays of counts).  Shares are floored at
    ``eps`` and normed again.
    """

    def shares(col: str) -> Column:
        total = F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + x)
        raw = F.transform(col, lambda x: F.greatest(F.lit(eps), x / total))
        return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, z: a + z))

    made = hist.select("source", shares("ref").alias("r"), shares("cur").alias("c"))
    added = lambda pair: F.aggregate(pair, F.lit(0.0), lambda a, x: a + x)
    psi = added(F.zip_with("r", "c", lambda r, c: (c - r) * F.log(c / r)))
    kl = added(F.zip_with("r", "c", lambda r, c: r * F.log(r / c)))
    graded = made.select("source", psi.alias("psi"), kl.alias("kl"))
    return graded.withColumn("grade", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.2, "watch").when(F.col("psi") < 0.3, "drift").otherwise("severe"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval."""
    p = successes / n
    z2 = F.lit(z * z)
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(z) / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return centre - half, centre + half


# -- bursts and schedules -------------------------------------------------------------------------


def burst_path(gaps: np.ndarray, log_base: float, s: float, gamma: float, levels: int, begin: int, end: int | None = None) -> tuple[list[float], list[int]]:
    """Least costs of each last state from state ``begin`` on, and the states of the path that ends in ``end`` (the cheapest by default).

    A gap g in state q costs rate * g - ln(rate), where ln(rate) is ``log_base``
    + q ln(s); each step up costs gamma * ln(s), steps down are free.  Ties go to
    the lowest state.
    """
    log_rates = log_base + math.log(s) * np.arange(levels)
    costs = (np.exp(log_rates[None, :] + np.log(gaps)[:, None]) - log_rates[None, :]).tolist()
    rise = [[gamma * max(0, q - p) * math.log(s) for p in range(levels)] for q in range(levels)]
    best = [0.0 if p == begin else math.inf for p in range(levels)]
    back = []
    for row in costs:
        options = [[best[p] + rise[q][p] for p in range(levels)] for q in range(levels)]
        came = [o.index(min(o)) for o in options]
        best = [options[q][came[q]] + row[q] for q in range(levels)]
        back.append(came)
    state = best.index(min(best)) if end is None else end
    path = []
    for came in reversed(back):
        path.append(state)
        state = came[state]
    return best, path[::-1]


def burst_paths(gaps: np.ndarray, lengths: np.ndarray, log_base: np.ndarray, s: float, gamma: float, levels: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The states of burst_path() for many keys at once: ``gaps`` of the keys in a row, the other arrays one value a key.

    A step goes over all keys that are long enough; an ``end`` of -1 is the cheapest.
    """
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    log_rates = np.repeat(log_base, lengths)[:, None] + math.log(s) * np.arange(levels)[None, :]
    costs = np.exp(log_rates + np.log(gaps)[:, None]) - log_rates
    rise = np.array([[gamma * max(0, q - p) * math.log(s) for p in range(levels)] for q in range(levels)])
    longest_first = np.argsort(-lengths, kind="stable")
    lengths, offsets, end = lengths[longest_first], offsets[longest_first], end[longest_first]
    best = np.where(np.arange(levels)[None, :] == begin[longest_first][:, None], 0.0, np.inf)
    # how many keys have more than i gaps
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")
    back = np.zeros(costs.shape, np.int8)
    for i, m in enumerate(active.tolist()):
        options = best[:m, None, :] + rise[None, :, :]
        rows = offsets[:m] + i
        back[rows] = options.argmin(2)
        best[:m] = options.min(2) + costs[rows]
    state = np.where(end < 0, best.argmin(1), end)
    path = np.zeros(len(gaps), np.int64)
    for i, m in zip(range(len(active) - 1, -1, -1), active[::-1].tolist()):
        rows = offsets[:m] + i
        path[rows] = state[:m]
        state[:m] = back[rows, state[:m]]
    return path


#: Distinct times that a task takes on, about, and those below which a part isn't worth a task.
BURST_ROWS, BURST_LEAST = 100_000, 5_000


def bursts(events: DataFrame, key: str, t: str, s: float = 2.0, gamma: float = 1.0, levels: int = 2, nested: bool = False, parts: int | None = None) -> DataFrame:
    """key, start, end, level, weight of each burst of a key's events (distinct times; two at least).

    A burst is a longest run of gaps in state 1 or above, with its highest state
    and what it saves against the base state, whose rate is the key's events over
    its time.  With ``nested`` a row is a longest run of state ``level`` or
    above, weighed against the level below: the tree of bursts within bursts.

    Times are range-partitioned into parts of alike size, and a call takes all
    keys of a part as arrays.  Only a key in several parts needs more: each of
    its parts gives its least cost from any first to any last state, and a fold
    over these tables fixes the states between them.
    """
    kind = events.schema[key].dataType.simpleString()
    times = saved(events.select(F.col(key).alias("k"), F.col(t).cast("double").alias("t")).filter(F.col("t").isNotNull()).distinct(), "burst-distinct")
    if parts is None:
        n = times.count()
        parts = max(-(-n // BURST_ROWS), min(events.sparkSession.sparkContext.defaultParallelism, -(-n // BURST_LEAST)), 1)
    ranged = saved(times.repartitionByRange(parts, "k", "t").withColumn("part", F.spark_partition_id()), "burst-times")
    ends = ranged.groupBy("k", "part").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    whole = Window.partitionBy("k")  # a row a part that the key is in
    n, total = F.sum("n").over(whole), F.max("hi").over(whole) - F.min("lo").over(whole)
    ends = ends.withColumns({"before": F.lag("hi").over(whole.orderBy("part")), "all": n, "split": F.count("*").over(whole) > 1, "log_base": F.log(n) - F.log(total)})
    heads = saved(ends.filter(F.col("all") >= 2).select(F.col("k").alias("of"), F.col("part").alias("in"), "before", "log_base", "split"), "burst-heads")
    pieces = saved(ranged.join(heads, F.col("k").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))).drop("of", "in"), "burst-pieces")

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        at, first = np.sort(pdf["t"].to_numpy()), pdf["before"].iloc[0]
        gaps = np.diff(at if pd.isna(first) else np.append(first, at))
        costs = [burst_path(gaps, pdf["log_base"].iloc[0], s, gamma, levels, p)[0] for p in range(levels)]
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "part": [pdf["part"].iloc[0]], "costs": [sum(costs, [])]})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        best, came = [0.0] + [math.inf] * (levels - 1), []
        for costs in pdf["costs"]:
            table = np.array(costs).reshape(levels, levels) + np.array(best)[:, None]
            came.append(table.argmin(0).tolist())
            best = table.min(0).tolist()
        state, rows = best.index(min(best)), []
        for part, back in zip(reversed(pdf["part"].tolist()), reversed(came)):
            rows.append((pdf["k"].iloc[0], part, back[state], state))
            state = back[state]
        return pd.DataFrame(rows, columns=["k", "part", "begin_state", "end_state"])

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pd.factorize(pdf["k"], use_na_sentinel=False)[0]
        order = np.lexsort([pdf["t"].to_numpy(), codes])
        codes, at = codes[order], pdf["t"].to_numpy()[order]
        head = np.append(True, codes[1:] != codes[:-1])
        since = np.where(head, pdf["before"].to_numpy(float)[order], np.append(np.nan, at[:-1]))
        # a gap ends at each time but the first of a key
        held = ~np.isnan(since)
        order, codes, at, since = order[held], codes[held], at[held], since[held]
        if not len(order):
            return pd.DataFrame(columns=["k", "part", "level", "start", "end", "top", "weight", "opens", "closes"])
        gaps, head = at - since, np.append(True, codes[1:] != codes[:-1])
        lengths = np.diff(np.append(np.flatnonzero(head), len(codes)))
        of = lambda name, fill: pdf[name].fillna(fill).to_numpy()[order][head]
        log_base = pdf["log_base"].to_numpy(float)[order]
        path = burst_paths(gaps, lengths, log_base[head], s, gamma, levels, of("begin_state", 0).astype(int), of("end_state", -1).astype(int))
        tail, log_s, found = np.append(head[1:], True), math.log(s), []
        for level in range(1, levels):
            inside = path >= level
            first = np.flatnonzero(inside & (head | ~np.append(False, inside[:-1])))
            last = np.flatnonzero(inside & (tail | ~np.append(inside[1:], False)))
            if not len(first):
                continue
            over = np.where(inside, path - (level - 1), 0)
            saves = np.where(inside, over * log_s - np.exp(log_base + (level - 1) * log_s + np.log(gaps)) * np.expm1(over * log_s), 0.0)
            bounds = np.column_stack([first, last + 1]).ravel()
            sums = np.add.reduceat(np.append(saves, 0.0), bounds)[::2]
            tops = np.maximum.reduceat(np.append(path, 0), bounds)[::2]
            keys = pdf["k"].iloc[order[first]].reset_index(drop=True)
            found.append(pd.DataFrame({"k": keys, "part": pdf["part"].iloc[0], "level": level, "start": since[first], "end": at[last], "top": tops, "weight": sums, "opens": head[first], "closes": tail[last]}))
        return pd.concat(found) if found else pd.DataFrame(columns=["k", "part", "level", "start", "end", "top", "weight", "opens", "closes"])

    split = pieces.filter("split").groupBy("k", "part").applyInPandas(through, f"k {kind}, part int, costs array<double>")
    paths = saved(split.groupBy("k").applyInPandas(fold, f"k {kind}, part int, begin_state int, end_state int"), "burst-paths").withColumnsRenamed({"k": "of", "part": "in"})
    held = pieces.join(paths, F.col("k").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")), "left").drop("of", "in")
    found = held.repartition(parts, "part").groupBy("part").applyInPandas(runs, f"k {kind}, part int, level int, start double, end double, top int, weight double, opens boolean, closes boolean")
    found = saved(found if nested else found.filter("level = 1"), "burst-runs")
    # runs that reach a part's end go on in the next one
    order = Window.partitionBy("k", "level").orderBy("start")
    joins = F.coalesce(F.col("opens") & F.lag("closes").over(order) & (F.lag("end").over(order) == F.col("start")), F.lit(False))
    numbered = found.withColumn("fresh", F.when(joins, 0).otherwise(1)).withColumn("nth", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("k", "level", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("top").alias("top"), F.sum("weight").alias("weight"))
    return joined.select(F.col("k").alias(key), "start", "end", (F.col("level") if nested else F.col("top")).alias("level"), "weight")


def burst_tree(found: DataFrame, key: str, levels: int) -> DataFrame:
    """Nested bursts (bursts() with ``nested``) with the start of their parent, a level below (null at level 1), and how many children they have.

    A burst lies in one of the level below, the last that began by then: so the
    sweep over begins is a running value, and a key's rows are sorted, not held.
    """
    order = Window.partitionBy(key).orderBy("start", "level").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("double")
    for level in range(2, levels):
        parent = F.when(F.col("level") == level, F.last(F.when(F.col("level") == level - 1, F.col("start")), ignorenulls=True).over(order)).otherwise(parent)
    placed = found.withColumn("parent", parent)
    born = placed.filter("parent IS NOT NULL").groupBy(F.col(key).alias("of"), (F.col("level") - 1).alias("at"), F.col("parent").alias("began")).agg(F.count("*").alias("children"))
    met = F.col(key).eqNullSafe(F.col("of")) & (F.col("level") == F.col("at")) & (F.col("start") == F.col("began"))
    return placed.join(born, met, "left").drop("of", "at", "began").withColumn("children", F.coalesce("children", F.lit(0)).cast("long"))


def burst_factor(found: DataFrame, key: str, now: Column, half_life: float = 24.0) -> DataFrame:
    """Strongest burst of each key: w / (w + 1), fading by half-lives after its end."""
    strength = F.when(F.col("weight") > 0, F.col("weight") / (F.col("weight") + 1)).otherwise(0.0)
    faded = F.when(now < F.col("start"), 0.0).when(now <= F.col("end"), strength).otherwise(strength * F.pow(F.lit(2.0), -(now - F.col("end")) / F.lit(half_life)))
    return found.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max(faded))).alias("factor"))


def suggested_ttl(base: float, factor: Column, least: float = 6.0, most: float = 720.0) -> Column:
    """Hours until a rescan: bursts shorten them by up to four fifths."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.lit(base) * (1 - F.lit(0.8) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), factor)))))


def edge_hours(edges: DataFrame, kinds: tuple[str, ...] = ("phash_near", "redirect")) -> DataFrame:
    """(site, t): hours since the epoch of the edges (src, dst, kind, created_at) of some kinds, at both ends."""
    hours = edges.filter(F.col("kind").isin(*kinds) & F.col("created_at").isNotNull()).withColumn("t", F.unix_timestamp("created_at") / F.lit(3600.0))
    return hours.select(F.explode(F.array("src", "dst")).alias("site"), "t")


def dynamic_ttl(hours: DataFrame, now: float, base: float) -> DataFrame:
    """(site, hours) of the sites whose edges burst; others keep their own."""
    factors = burst_factor(bursts(hours, "site", "t"), "site", F.lit(float(now))).filter(F.col("factor") > 0)
    return factors.select("site", suggested_ttl(base, F.col("factor")).alias("hours"))


def volatility(history: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Share of steps at which the value changes; n rows."""
    changed = F.when(F.lag(value).over(Window.partitionBy(key).orderBy(order)) != F.col(value), 1).otherwise(0)
    return history.withColumn("changed", changed).groupBy(key).agg(F.count("*").alias("n"), F.sum("changed").alias("changes")).withColumn("volatility", F.coalesce(F.try_divide(F.col("changes").cast("double"), F.col("n") - 1), F.lit(0.0)))


def interval_hours(vol: Column, n: Column, base: int = 48) -> Column:
    return F.when(vol >= 0.5, F.greatest(F.lit(6.0), F.lit(base / 2))).when((vol <= 0.1) & (n >= 3), F.least(F.lit(720.0), F.lit(base * 2.0))).otherwise(F.lit(float(base)))


def select_round(items: DataFrame, key: str, value: str, cost: str, budget: float, max_rounds: int = 1000) -> DataFrame:
    """Greedy by value / cost in each key's budget; what doesn't fit is passed over (ties: the smaller id).

    A round takes, from each key's items in order, all that fit one after the
    other, and leaves out what no longer fits alone; so it is a running sum and a
    filter, and a key's items are never in memory together.
    """
    left = saved(items.select(key, "id", value, cost, F.lit(float(budget)).alias("__left")).filter(F.col(cost) <= budget), "round-0")
    order = Window.partitionBy(key).orderBy(F.desc(F.col(value) / F.col(cost)), "id")
    taken = None
    for k in range(1, max_rounds + 1):
        used = F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0))
        summed = left.withColumn("__used", used).withColumn("__fits", F.col("__used") <= F.col("__left"))
        summed = saved(summed, f"round-sums-{k}")
        # used sums grow, so what fits is a prefix
        part = summed.filter("__fits").select(key, "id", value, cost)
        taken = part if taken is None else taken.unionByName(part)
        spent = summed.filter("__fits").groupBy(key).agg(F.max("__used").alias("__spent"))
        rest = summed.filter("NOT __fits").join(spent, key, "left").withColumn("__left", F.col("__left") - F.coalesce("__spent", F.lit(0.0)))
        left = saved(rest.filter(F.col(cost) <= F.col("__left")).select(key, "id", value, cost, "__left"), f"round-{k}")
        if not left.take(1):
            return taken
    raise RuntimeError(f"rounds didn't settle in {max_rounds}")


def send_gate(images: DataFrame, site: str, order: str, least_px: int = 200, near_bits: int = 4, max_rounds: int = 1000) -> DataFrame:
    """Per site, in order: exact copies, small images and near copies of what was sent are held back.

    ``images``: site, order, sha, h (signed 64-bit), width, height.  The result
    is each image with its decision: sent, copy, small or near.

    Copies and small images fall to a window and a filter.  Near pairs of a site
    come from a banded join.  An image is settled once all earlier near ones are
    (near if one of them was sent, else sent), so a round is a join of pairs with
    decisions, and there are as many as the longest chain needs.
    """
    rows = saved(images.select(site, order, "sha", "h", "width", "height").withColumn("uid", F.monotonically_increasing_id()), "gate-rows")
    nth = F.row_number().over(Window.partitionBy(site, "sha").orderBy(order, "uid"))
    kind = F.when(F.col("nth") > 1, "copy").when((F.col("width") < least_px) & (F.col("height") < least_px), "small")
    rows = saved(rows.withColumn("nth", nth).withColumn("decision", kind).drop("nth", "width", "height"), "gate-kinds")
    asked = rows.filter(F.col("decision").isNull())
    ends = asked.select(F.col("uid").alias("sha"), "h", F.col(site).alias("within"))
    place = asked.select("uid", F.col(order).alias("at"))
    pairs = hamming_join(ends, ends, near_bits, on="within").filter(F.col("sha") != F.col("other"))
    pairs = pairs.join(place.withColumnsRenamed({"uid": "sha", "at": "at_sha"}), "sha").join(place.withColumnsRenamed({"uid": "other", "at": "at_other"}), "other")
    earlier = F.struct("at_other", "other") < F.struct("at_sha", "sha")
    waits = saved(pairs.filter(earlier).select(F.col("sha").alias("uid"), F.col("other").alias("on")), "gate-waits")
    settled = asked.select("uid").join(waits, "uid", "left_anti").withColumn("decision", F.lit("sent"))
    settled = saved(settled, "gate-0")
    every = settled
    for k in range(1, max_rounds + 1):
        if not waits.take(1):
            break
        known = waits.join(settled.select(F.col("uid").alias("on"), "decision"), "on", "left")
        state = known.groupBy("uid").agg(F.max(F.col("decision") == "sent").alias("near"), F.count(F.when(F.col("decision").isNull(), 1)).alias("open"))
        fresh = state.select("uid", F.when(F.col("near"), "near").when(F.col("open") == 0, "sent").alias("decision")).filter(F.col("decision").isNotNull())
        settled = saved(fresh, f"gate-{k}")
        every = every.unionByName(settled)
        waits = saved(known.filter(F.col("decision").isNull()).select("uid", "on").join(settled.select("uid"), "uid", "left_anti"), f"gate-waits-{k}")
    else:
        raise RuntimeError(f"images didn't settle in {max_rounds} rounds")
    found = rows.join(every.withColumnRenamed("decision", "settled"), "uid", "left")
    return found.select(site, order, "sha", F.coalesce("decision", "settled").alias("decision"))


def drift_interval(hist: DataFrame, rounds: int = 2000, seed: int = 17, eps: float = 1e-6) -> DataFrame:
    """source, psi_lo, psi_hi, kl_lo, kl_hi: percentiles when current rows are drawn again (``hist`` as for histogram_drift).

    Rows are drawn as counts of a multinomial, so a source costs the same
    whatever the number of its rows.
    """

    def shares(counts: np.ndarray) -> np.ndarray:
        raw = np.maximum(eps, counts / np.maximum(1, counts.sum(-1, keepdims=True)))
        return raw / raw.sum(-1, keepdims=True)

    @F.pandas_udf("psi_lo double, psi_hi double, kl_lo double, kl_hi double")
    def interval(source: pd.Series, ref: pd.Series, cur: pd.Series) -> pd.DataFrame:
        out = []
        for of, r, c in zip(source, ref, cur):
            n = int(sum(c))
            if not n:
                out.append((None,) * 4)
                continue
            rng = np.random.default_rng([seed, *str(of).encode()])
            was, now = shares(np.array(r, float)), shares(rng.multinomial(n, np.array(c) / n, rounds).astype(float))
            psi, kl = ((now - was) * np.log(now / was)).sum(1), (was * np.log(was / now)).sum(1)
            out.append((*np.percentile(psi, (2.5, 97.5), method="inverted_cdf"), *np.percentile(kl, (2.5, 97.5), method="inverted_cdf")))
        return pd.DataFrame(out, columns=["psi_lo", "psi_hi", "kl_lo", "kl_hi"])

    return hist.select("source", interval("source", "ref", "cur").alias("x")).select("source", "x.*")


def conditional_kl(cells: DataFrame, eps: float = 1e-6) -> DataFrame:
    """source, kl: the mean of KL(reference, current) over the bins of a condition, weighed by the reference's share of each.

    ``cells``: source, given, outcome, ref, cur (counts, every outcome of every given).
    """
    w = Window.partitionBy("source", "given")
    share = lambda c: F.greatest(F.lit(eps), F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(w)), F.lit(0.0)))
    made = cells.withColumn("r", share("ref")).withColumn("c", share("cur")).withColumn("r", F.col("r") / F.sum("r").over(w)).withColumn("c", F.col("c") / F.sum("c").over(w))
    each = made.groupBy("source", "given").agg(F.sum(F.col("r") * F.log(F.col("r") / F.col("c"))).alias("kl"), F.sum("ref").alias("n"))
    return each.groupBy("source").agg((F.sum(F.col("kl") * F.col("n")) / F.sum("n")).alias("kl"))


#: Fixed value: fewer rows give no threshold.
LEAST_CALIBRATION = 30


def upper_tail(k: int, m: int, p: float) -> float:
    """P(Bin(m, p) >= k)."""
    if k <= 0 or k > m:
        return float(k <= 0)
    j = np.arange(k, m + 1)
    lg = np.vectorize(math.lgamma, otypes=[float])
    return min(1.0, float(np.exp(math.lgamma(m + 1) - lg(j + 1.0) - lg(m - j + 1.0) + j * math.log(p) + (m - j) * math.log1p(-p)).sum()))


def conformal_threshold(levels: DataFrame, target: float, delta: float = 0.05) -> DataFrame:
    """One row: the deepest score whose prefix has the target precision, and how sure that is.

    ``levels``: score, selected, hits (suffix_counts), one row a distinct score,
    which is at most 10,001 for ten-thousandths: they meet in one task.
    Columns: threshold, n, empirical_precision, lower_bound (Clopper-Pearson),
    p_value, corrected_alpha (delta over the candidates), n_candidates,
    selection_mode (ltt: the prefix passes the exact test at that level;
    ltt_advisory: only a shorter one does; empirical_fallback: none does;
    degraded: no threshold), ltt_threshold.  Under 30 rows, without positives, or
    without a prefix of the target precision it is degraded.
    """
    if not 0.5 < target < 1 or not 0 < delta < 0.5:
        raise ValueError("the target lies between 0.5 and 1, delta between 0 and 0.5")
    from lumasift.functions.mathx import beta_quantile

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("selected")
        score, m, k = (pdf[c].tolist() for c in ("score", "selected", "hits"))
        n, alpha = m[-1], delta / len(m)
        good = [i for i in range(len(m)) if k[i] >= target * m[i]]
        row = {"threshold": None, "n": n, "empirical_precision": None, "lower_bound": None, "p_value": None, "corrected_alpha": None, "n_candidates": None, "selection_mode": "degraded", "ltt_threshold": None}
        if n >= LEAST_CALIBRATION and k[-1] and good:
            at = good[-1]
            passed = [i for i in good if k[i] > target * m[i] and upper_tail(k[i], m[i], target) <= alpha]
            lower = delta ** (1 / m[at]) if k[at] == m[at] else beta_quantile(delta, k[at], m[at] - k[at] + 1) if k[at] else 0.0
            mode = "empirical_fallback" if not passed else "ltt" if passed[-1] == at else "ltt_advisory"
            row |= {"threshold": score[at], "empirical_precision": k[at] / m[at], "lower_bound": lower, "p_value": upper_tail(k[at], m[at], target), "corrected_alpha": alpha, "n_candidates": len(m), "selection_mode": mode, "ltt_threshold": score[passed[-1]] if passed else None}
        return pd.DataFrame([row])

    schema = "threshold double, n long, empirical_precision double, lower_bound double, p_value double, corrected_alpha double, n_candidates long, selection_mode string, ltt_threshold double"
    return levels.groupBy(F.lit(0).alias("one")).applyInPandas(fit, schema)


def adaptive_band(history: DataFrame, below: float, above: float, budget: float | None, steps: int = 20, max_step: float = 0.2, least: int = 20, previous: tuple[float, float] | None = None) -> DataFrame:
    """One row (below, above, k): the cheapest band around the static one's centre that keeps ``budget`` of its risk.

    ``history``: score, cost, escalated, correct (boolean or null).  A row's risk
    is its error if it is labelled and was not escalated, else 1 - |2 score - 1|,
    less the smoothed error share of labelled escalated rows.  Candidates are
    steps of the static width; of equal costs the widest counts; the width
    changes by at most ``max_step`` of the previous one and stays in the static
    band.  Without a budget, or with few rows, it is the static band.

    Rows are counted by the first candidate that holds them, in one pass.
    """
    eps, centre, width = 1e-12, (below + above) / 2, (above - below) / 2
    risk = F.when(~F.col("escalated") & F.col("correct").isNotNull(), F.when(F.col("correct"), 0.0).otherwise(1.0)).otherwise(1 - F.abs(2 * F.col("score") - 1))
    labelled = F.col("escalated") & F.col("correct").isNotNull()
    costs = history.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(~F.col("escalated"), F.col("cost"))), F.min("cost"), F.lit(1.0)).alias("cheap"),
        F.avg(F.when(F.col("escalated"), F.col("cost"))).alias("dear"),
        F.count(F.when(labelled, 1)).alias("seen"),
        F.count(F.when(labelled & ~F.col("correct"), 1)).alias("wrong"),
    ).select("n", "cheap", F.greatest(F.lit(0.0), F.coalesce(F.col("dear") - F.col("cheap"), F.lit(0.0))).alias("more"), F.when(F.col("seen") > 0, (F.col("wrong") + 1) / (F.col("seen") + 2)).otherwise(0.0).alias("left"))
    off = F.abs(F.col("score") - F.lit(centre))
    cell = F.greatest(F.lit(1), F.ceil((off - F.lit(eps)) / F.lit(width / steps))).cast("int")
    placed = history.filter(off <= F.lit(width + eps)).crossJoin(F.broadcast(costs.select("left"))).select(cell.alias("k"), F.greatest(F.lit(0.0), risk - F.col("left")).alias("mass"))
    cells = placed.groupBy("k").agg(F.sum("mass").alias("mass"), F.count("*").alias("inside"))
    grid = history.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("k")).join(cells, "k", "left").na.fill(0.0, ["mass"]).na.fill(0, ["inside"])
    # one row a candidate
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    curve = grid.select("k", F.sum("mass").over(upto).alias("covered"), F.sum("inside").over(upto).alias("inside"), F.sum("mass").over(Window.partitionBy(F.lit(0))).alias("total"))
    fair = curve.filter(F.col("covered") + F.lit(eps) >= F.lit(budget if budget is not None else 1.0) * F.col("total")).crossJoin(F.broadcast(costs))
    best = fair.agg(F.min_by("k", F.struct((F.col("cheap") + F.col("more") * F.col("inside") / F.col("n")).alias("c"), (-F.col("k")).alias("wide"))).alias("k"), F.max("n").alias("n"))
    last = (previous[1] - previous[0]) / 2 if previous else width
    chosen = F.least(F.greatest(F.col("k") * F.lit(width / steps), F.lit(max(0.0, last * (1 - max_step)))), F.lit(min(width, last * (1 + max_step))))
    static = F.lit(budget is None) | F.coalesce(F.col("n") < least, F.lit(True))
    low, high = F.round(F.greatest(F.lit(0.0), F.lit(centre) - chosen), 6), F.round(F.least(F.lit(1.0), F.lit(centre) + chosen), 6)
    return best.select(F.when(static, F.lit(below)).otherwise(low).alias("below"), F.when(static, F.lit(above)).otherwise(high).alias("above"), "k")


# -- checkpoints of reliability -------------------------------------------------------------------


def bayes_checkpoint(rows: DataFrame, half_life: float, before: DataFrame | None = None) -> DataFrame:
    """(provider, good, bad, n, anchor): sums of faded rows (provider, correct, t) as of the last time, with those of ``before`` folded in.

    Fading is exponential, so sums as of one time are those as of another but
    for one factor: a checkpoint and later rows give what all rows would.  The
    anchor never moves back; rows older than it fade further.
    """
    last = rows.agg(F.max("t").alias("t"))
    if before is not None:
        last = last.unionByName(before.agg(F.max("anchor").alias("t"))).agg(F.max("t").alias("t"))
    fade = lambda t: F.exp(F.lit(-math.log(2.0) / half_life) * (F.col("anchor_now") - t))
    now = F.broadcast(last.select(F.col("t").alias("anchor_now")))  # one row
    w = fade(F.col("t"))
    parts = rows.crossJoin(now).select("provider", F.when(F.col("correct"), w).otherwise(0.0).alias("good"), F.when(F.col("correct"), 0.0).otherwise(w).alias("bad"), F.lit(1).cast("long").alias("n"), F.col("anchor_now").alias("anchor"))
    if before is not None:
        old = before.crossJoin(now)
        parts = parts.unionByName(old.select("provider", (F.col("good") * fade(F.col("anchor"))).alias("good"), (F.col("bad") * fade(F.col("anchor"))).alias("bad"), "n", F.col("anchor_now").alias("anchor")))
    return parts.groupBy("provider").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.max("anchor").alias("anchor"))


def folded_checkpoint(rows: DataFrame, half_life: float, every: int = 256) -> DataFrame:
    """As bayes_checkpoint, in folds of ``every`` rows in order of t: each fades to its own last time, and folds fade to the last of all.

    A fade then spans a fold and a distance between folds, so weights of rows that
    are very old don't vanish one by one, and folds can be kept and added to.
    """
    fade = lambda to, t: F.exp(F.lit(-math.log(2.0) / half_life) * (to - t))
    placed = numbered(rows.select("provider", "correct", F.col("t").cast("double").alias("t")), [], [F.col("t").asc()], "folds").withColumn("fold", F.floor(F.col("i") / every))
    # one row a fold
    ends = placed.groupBy("fold").agg(F.max("t").alias("until"))
    w = fade(F.col("until"), F.col("t"))
    folds = placed.join(ends, "fold").groupBy("fold", "provider").agg(
        F.sum(F.when(F.col("correct"), w).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("correct"), 0.0).otherwise(w)).alias("bad"), F.count("*").alias("n"), F.max("until").alias("until")
    )
    folds = saved(folds, "folds")
    last = F.broadcast(folds.agg(F.max("until").alias("anchor")))  # one row
    at = fade(F.col("anchor"), F.col("until"))
    return folds.crossJoin(last).groupBy("provider").agg(F.sum(F.col("good") * at).alias("good"), F.sum(F.col("bad") * at).alias("bad"), F.sum("n").alias("n"), F.max("anchor").alias("anchor"))


def save_checkpoint(checkpoint: DataFrame, path: str, half_life: float, kappa: float = 10.0) -> None:
    """A checkpoint with the parameters that it holds for."""
    checkpoint.withColumns({"half_life": F.lit(float(half_life)), "kappa": F.lit(float(kappa))}).write.mode("overwrite").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, half_life: float, kappa: float = 10.0) -> DataFrame:
    """What save_checkpoint() wrote; other parameters than those asked for are an error."""
    kept = spark.read.parquet(path)
    if other := kept.filter((F.col("half_life") != half_life) | (F.col("kappa") != kappa)).select("half_life", "kappa").head(1):
        raise ValueError(f"{path} holds for half-life {other[0]['half_life']} and kappa {other[0]['kappa']}")
    return kept.drop("half_life", "kappa")


def checkpoint_weights(checkpoint: DataFrame, as_of: Column, half_life: float, kappa: float = 10.0) -> DataFrame:
    """As bayes_weights, from a checkpoint; an ``as_of`` before its anchor is an error."""
    factor = F.exp(F.lit(-math.log(2.0) / half_life) * (F.col("as_of") - F.col("anchor")))
    early = F.raise_error(F.lit("the checkpoint is later than the time asked for")).cast("double")
    at = checkpoint.withColumn("as_of", as_of).withColumn("factor", F.when(F.col("as_of") >= F.col("anchor"), factor).otherwise(early))
    return _shrunk(at.select("provider", (F.col("good") * F.col("factor")).alias("good"), (F.col("bad") * F.col("factor")).alias("bad")), kappa)


def _shrunk(own: DataFrame, kappa: float) -> DataFrame:
    """(provider, mean, weight) from faded sums (provider, good, bad), one row a provider."""
    pool = own.agg(((1 + F.sum("good")) / (2 + F.sum("good") + F.sum("bad"))).alias("pool"))
    n = F.col("good") + F.col("bad")
    share = F.when(n < 5, 1.0).otherwise(F.lit(kappa) / (F.lit(kappa) + n))
    raw = (1 + F.col("good")) / (2 + n)
    shrunk = own.crossJoin(F.broadcast(pool)).withColumn("mean", (1 - share) * raw + share * F.col("pool"))
    return shrunk.withColumn("weight", F.col("mean") / F.sum("mean").over(Window.partitionBy(F.lit(0)))).select("provider", "mean", "weight")


# -- calibration of schedules ---------------------------------------------------------------------


def calibrate_ttl(found: DataFrame, spans: DataFrame, truths: DataFrame, key: str, half_lives: list[float], shrinks: list[float], base: float = 72.0, least: float = 6.0, most: float = 720.0, max_steps: int = 100_000) -> DataFrame:
    """half_life, shrink, hits, truths, hit_rate, rescans, waste, pareto of each pair of the grid.

    ``found``: key, start, end, weight (bursts); ``spans``: key, lo, hi (hours);
    ``truths``: key, at.  From lo on, a site is visited again after base * (1 -
    shrink * factor) hours, kept within bounds, until hi.  A truth is hit if a
    visit falls between the one before (or lo) and itself, the end included.
    Each site and pair of parameters is one row of work; a site's bursts and
    truths travel in its row, and each step of the schedule looks at bursts that
    have begun only.  Windows with more steps than ``max_steps`` are an error.
    """
    grid = [(h, s) for h in half_lives for s in shrinks]
    rows = spans.select(key, "lo", "hi")
    rows = rows.join(found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "weight"))).alias("bursts")), key, "left")
    rows = rows.join(truths.groupBy(key).agg(F.array_sort(F.collect_set("at")).alias("at")), key, "left")
    rows = rows.withColumn("g", F.explode(F.array(*[F.struct(F.lit(float(h)).alias("half_life"), F.lit(float(s)).alias("shrink")) for h, s in grid])))

    @F.pandas_udf("hits long, rescans long")
    def replay(lo: pd.Series, hi: pd.Series, bursts: pd.Series, at: pd.Series, half_life: pd.Series, shrink: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, some, when, h, s in zip(lo, hi, bursts, at, half_life, shrink):
            begun = np.array([x["start"] for x in some]) if some is not None else np.zeros(0)
            ends = np.array([x["end"] for x in some]) if some is not None else np.zeros(0)
            force = np.array([x["weight"] / (x["weight"] + 1) if x["weight"] > 0 else 0.0 for x in some]) if some is not None else np.zeros(0)
            if (b - a) / least > max_steps:
                raise ValueError("the window has too many steps")
            visits, now = [], a
            while True:
                n = int(np.searchsorted(begun, now, side="right"))
                factor = float((force[:n] * np.exp2(-np.maximum(0.0, now - ends[:n]) / h)).max(initial=0.0))
                now += min(most, max(least, base * (1 - s * min(1.0, factor))))
                if now > b:
                    break
                visits.append(now)
            marks = np.array([a, *(when if when is not None else [])])
            after = np.searchsorted(visits, marks[:-1], side="right")
            hits = sum(k < len(visits) and visits[k] <= g for k, g in zip(after.tolist(), marks[1:].tolist()))
            out.append((hits, len(visits)))
        return pd.DataFrame(out, columns=["hits", "rescans"])

    known = F.coalesce(F.size("at"), F.lit(0))
    played = rows.select("g", known.alias("known"), replay("lo", "hi", "bursts", "at", F.col("g.half_life"), F.col("g.shrink")).alias("x"))
    total = played.groupBy("g.half_life", "g.shrink").agg(F.sum("x.hits").alias("hits"), F.sum(F.greatest(F.lit(0), "known")).alias("truths"), F.sum("x.rescans").alias("rescans"))
    total = saved(total.select("half_life", "shrink", "hits", "truths", F.coalesce(F.try_divide(F.col("hits").cast("double"), "truths"), F.lit(0.0)).alias("hit_rate"), "rescans", (F.col("rescans") - F.col("hits")).alias("waste")), "ttl-grid")
    other = total.select(F.col("hits").alias("h2"), F.col("waste").alias("w2"))  # a row a pair of parameters
    beats = (F.col("h2") >= F.col("hits")) & (F.col("w2") <= F.col("waste")) & ((F.col("h2") > F.col("hits")) | (F.col("w2") < F.col("waste")))
    front = total.join(F.broadcast(other), beats, "left_anti").select("half_life", "shrink").withColumn("pareto", F.lit(True))
    return total.join(front, ["half_life", "shrink"], "left").na.fill(False, ["pareto"])


def first_after(truths: DataFrame, visits: DataFrame, key: str) -> DataFrame:
    """key, at, visit: for each truth the first visit after the truth before it (or the start) and up to itself; null without one.

    An interval match by one window over both tables in order of time.
    """
    both = truths.select(key, F.col("at").alias("t"), F.lit(1).alias("truth")).unionByName(visits.select(key, F.col("at").alias("t"), F.lit(0).alias("truth")))
    order = Window.partitionBy(key).orderBy("t", "truth")
    # truths before this row number the interval that it lies in
    interval = F.coalesce(F.sum("truth").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = both.withColumn("interval", interval)
    found = placed.groupBy(key, "interval").agg(F.max(F.when(F.col("truth") == 1, F.col("t"))).alias("at"), F.min(F.when(F.col("truth") == 0, F.col("t"))).alias("visit"))
    return found.filter(F.col("at").isNotNull()).select(key, "at", "visit")
