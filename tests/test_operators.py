import datetime
import hashlib
import json
import math
import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumasift.functions import mathx as M
from lumasift.operators import decision as D
from lumasift.operators import graph as G
from lumasift.operators import html, ledger, search
from lumasift.operators import sequential as S
from lumasift.operators import similarity as H
from lumasift.operators.components import connected_components
from lumasift.sources import readers, sinks
from lumasift.streaming import processors


def test_assess_goldens(spark):
    rows = [("a", str(i), p, 1, 400, 300) for i, p in enumerate((0.95, 0.92, 0.91))] + [("b", str(i), p, 1, 100, 100) for i, p in enumerate((0.95, 0.92, 0.91))]
    df = spark.createDataFrame(rows, "site string, path string, prob double, members int, width int, height int")
    got = {r["site"]: (r["verdict"], r["hits"], r["agg"]) for r in D.assess(df).collect()}
    assert got == {"a": ("nsfw", 3, 0.95), "b": ("clean", 0, 0.0)}


def test_sprt_golden(spark):
    df = spark.createDataFrame([("s", i, 0.05) for i in range(20)], "k string, n int, p double")
    assert S.sprt(df, "k", "n", F.col("p")).first().asDict() == {"k": "s", "state": "clean", "used": 2}


def test_fusion_only_escalates(spark):
    df = spark.createDataFrame([(0.95, 3, "nsfw"), (0.1, 0, "clean")], "agg double, hits int, verdict string")
    got = D.fuse(df, F.lit(0.0), F.lit(0.0), F.lit(0.0)).collect()
    assert [r["verdict"] for r in got] == ["nsfw", "clean"]
    alone = D.fuse(df, *[F.lit(None).cast("double")] * 3).collect()
    assert [r["fused"] for r in alone] == [0.95, 0.1]


def test_overturn_without_history(spark):
    df = spark.createDataFrame([], "verdict string, status string")
    assert D.overturn_stats(df).count() == 0


def test_merkle(spark):
    def root(leaves):
        level = [bytes.fromhex(x) for x in leaves]
        while len(level) > 1:
            level += level[-1:] * (len(level) % 2)
            level = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2])]
        return level[0].hex() if level else hashlib.sha256(b"").hexdigest()

    for n in (0, 1, 2, 5, 7):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(leaves)], "seq long, leaf string")
        got = ledger.merkle_root(df, "seq", "leaf").first()
        assert (got["root"], got["leaves"]) == (root(leaves), n)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_prints(seed, flips):
    rng = random.Random(seed)
    prints = [(i, H.signed(rng.getrandbits(64))) for i in range(60)]
    for i, h in list(prints):
        x = h & (1 << 64) - 1
        for b in rng.sample(range(64), flips[i % len(flips)]):
            x ^= 1 << b
        prints.append((100 + i, H.signed(x)))
    return prints


@pytest.mark.parametrize("bands", [None, 3, 9])
def test_hamming_joins_lose_nothing(spark, bands):
    prints = near_prints(7, range(1, 12)) + [(500, 5), (501, 5)]
    df = spark.createDataFrame(prints, "sha long, h long")
    d = 8
    exact = [tuple(r) for r in H.self_join(df, d, bands).collect()]
    brute = sorted((a, b, ((x ^ y) & (1 << 64) - 1).bit_count()) for a, x in prints for b, y in prints if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= d)
    assert sorted(exact) == brute and len(exact) >= 15


def test_lossy_joins_have_recall(spark):
    prints = near_prints(8, range(1, 9))
    df = spark.createDataFrame(prints, "sha long, h long")
    every = {tuple(r) for r in H.self_join(df, 8).collect()}
    for found in (H.self_join(df, 8, bands=8, radius=0), H.multi_table_pairs(df, 8)):
        some = {tuple(r) for r in found.collect()}
        assert some <= every and len(some) / len(every) >= 0.9
    assert spark.range(1).select(H.hamming(H.from_hex(F.lit("f" * 16)), H.from_hex(F.lit("7" + "f" * 15)))).first()[0] == 1
    assert spark.range(1).select(H.reversed_bits(F.lit(1).cast("long")), H.reversed_bits(F.lit(6).cast("long"))).first()[:] == (-(1 << 63), 3 << 61)


def test_bands_follow_the_size():
    assert H.bands_for(10, 8) > H.bands_for(10**9, 8) and all(len(H.flips(8, r)) == n for r, n in ((0, 1), (1, 9), (2, 37)))


def test_near_groups_of_equal_prints(spark):
    df = spark.createDataFrame([(k, 77) for k in range(9)] + [(20, 76), (30, -1), (31, -2), (40, 1 << 40)], "sha long, h long")
    got = {r["node"]: r["component"] for r in H.near_groups(df, 2).collect()}
    assert got == {**{k: 0 for k in range(9)}, 20: 0, 30: 30, 31: 30} or got == {**{k: 0 for k in range(9)}, 20: 0, 30: 30, 31: 30, 40: 40}


def test_image_hashes_and_nulls(spark):
    rng = np.random.default_rng(1)
    img = rng.random(1024).tolist()
    flipped = np.array(img).reshape(32, 32)[:, ::-1].ravel().tolist()
    df = spark.createDataFrame([(1, img), (2, flipped), (3, None), (4, [1.0])], "id long, px array<double>")
    got = {r["id"]: r for r in H.image_hashes(df, "id", "px").collect()}
    assert got[1]["mirror_hash"] == got[2]["mirror_hash"] and got[3]["phash"] is None and got[4]["ahash"] is None


def test_incremental_links_equal_full(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(12), rng.randrange(25)) for _ in range(80)]
    df = spark.createDataFrame(rows, "site long, media long")
    touched = spark.createDataFrame([(1,), (4,)], "site long")
    full = {tuple(r) for r in G.shared_media(df).collect() if {r["a"], r["b"]} & {1, 4}}
    assert {tuple(r) for r in G.shared_media_of(df, touched).collect()} == full


def sequential_communities(edges, resolution=1.0):
    """Sweeps and folded levels on plain dictionaries, with every gain taken from modularity itself."""
    weight = {}
    for a, b, w in edges:
        weight[a, b] = weight.get((a, b), 0) + w
    two_m = 2 * sum(weight.values())
    home = {n: n for e in weight for n in e}

    def quality(label, weight):
        inside, total = {}, {}
        for (a, b), w in weight.items():
            total[label[a]] = total.get(label[a], 0) + w
            total[label[b]] = total.get(label[b], 0) + w
            if label[a] == label[b]:
                inside[label[a]] = inside.get(label[a], 0) + 2 * w
        return sum(inside.get(c, 0) / two_m - resolution * (t / two_m) ** 2 for c, t in total.items())

    while True:
        nodes = sorted({n for e in weight for n in e})
        label = {n: n for n in nodes}
        while True:
            before, moved = quality(label, weight), 0
            for n in nodes:
                near = sorted({label[b if a == n else a] for a, b in weight if n in (a, b) and a != b})
                stay = quality(label, weight)
                options = [(quality({**label, n: c}, weight) - stay, c) for c in near if c != label[n]]
                gain = max((g for g, _ in options), default=0)
                if gain > 1e-12:
                    label[n] = min(c for g, c in options if abs(g - gain) < 1e-12)
                    moved += 1
            if not moved or quality(label, weight) - before < 1e-7:
                break
        least = {}
        for n in nodes:
            least[label[n]] = min(least.get(label[n], n), n)
        label = {n: least[c] for n, c in label.items()}
        home = {n: label[c] for n, c in home.items()}
        folded = {}
        for (a, b), w in weight.items():
            key = tuple(sorted((label[a], label[b])))
            folded[key] = folded.get(key, 0) + w
        if len(least) in (1, len(nodes)):
            return home, quality({n: home[n] for n in home}, {tuple(sorted((a, b))): w for a, b, w in edges})
        weight = folded


def random_graph(seed, blocks=4, size=6):
    rng = random.Random(seed)
    edges = []
    for a in range(blocks * size):
        for b in range(a + 1, blocks * size):
            if rng.random() < (0.7 if a // size == b // size else 0.06):
                edges.append((a, b, float(rng.randrange(1, 8))))
    return edges


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_louvain_against_sequential_sweeps(spark, seed):
    edges = random_graph(seed) + [(100, 101, 1.0), (101, 102, 1.0)]
    got = {r["node"]: r["community"] for r in G.louvain(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert got == sequential_communities(edges)[0]


def test_louvain_in_rounds_is_about_as_good(spark):
    """No component is small enough for one task, so all levels take distributed rounds."""
    edges = random_graph(5)
    want, best = sequential_communities(edges)
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    parts = G.louvain(df, exact_edges=0, rounds=16)
    got = {r["node"]: r["community"] for r in parts.collect()}
    assert set(got) == set(want) and all(got[c] == c for c in set(got.values()))
    assert G.modularity(df, parts).first()["modularity"] >= 0.95 * best


def test_sites_of_equal_media_are_one_node(spark):
    """Copies of sites make no edges of their own, and communities are those of all pairs."""
    rng = random.Random(3)
    sets = [frozenset([(g, rng.randrange(12)) for _ in range(5)] + [(9, rng.randrange(9))]) for g in range(3) for _ in range(6)]
    rows = [(s + 18 * k, 100 * g + m) for s, own in enumerate(sets) for k in range(4) for g, m in own] + [(900, None), (901, None), (902, 7777), (903, 7777), (903, None), (904, 5555), (None, 1)]
    df = spark.createDataFrame(rows, "site long, media long")
    members, edges = G.twin_edges(df)
    plain = G.shared_media(df)
    assert edges.agg({"pairs": "sum"}).first()[0] == plain.count() and edges.count() <= 18 * 19 // 2 + 2
    for tags in ((), (F.pmod("a", F.lit(3)),)):
        members, edges = G.twin_edges(df, *tags)
        of = {}
        for r in members.collect():
            of.setdefault(r["twin"], []).append(r["node"])
        want = {(r["a"], r["b"]): (r["shared"], round(r["weight"], 9)) for r in plain.collect()}
        got = {}
        for r in edges.collect():
            for x in of[r["a"]]:
                for y in of[r["b"]]:
                    if r["a"] != r["b"] or x < y:
                        got[min(x, y), max(x, y)] = (r["shared"], round(r["weight"], 9))
        assert got == want and all(min(x) == t for t, x in of.items())
    members, edges = G.twin_edges(df)
    found = {r["node"]: r["community"] for r in G.of_twins(members, G.louvain(edges.select("a", "b", (F.col("weight") * F.col("pairs")).alias("weight")))).collect()}
    whole = [(r["a"], r["b"], r["weight"]) for r in plain.collect()]
    want, best = sequential_communities(whole)
    parts = spark.createDataFrame(list(found.items()), "node long, community long")
    assert set(found) == set(want) and all(found[c] == c for c in set(found.values()))
    assert G.modularity(plain, parts).first()["modularity"] >= 0.999 * best


def test_media_in_blocks(spark):
    rng = random.Random(12)
    rows = [(s, 0) for s in range(40)] + [(rng.randrange(40), rng.randrange(1, 30)) for _ in range(200)]
    df = spark.createDataFrame(rows, "site long, media long")
    sets = {}
    for s, m in rows:
        sets.setdefault(s, set()).add(m)
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b])
    for block in (3, 7, 512):
        assert sorted((r["a"], r["b"], r["shared"]) for r in G.shared_media(df, block=block).collect()) == want


def test_few_touched_sites_are_one_block(spark, monkeypatch):
    monkeypatch.setattr(G, "MANY_ROWS", 10)
    rng = random.Random(13)
    rows = [(rng.randrange(60), rng.randrange(40)) for _ in range(500)]
    sets = {}
    for s, m in rows:
        sets.setdefault(s, set()).add(m)
    df, touched = spark.createDataFrame(rows, "site long, media long"), spark.createDataFrame([(s,) for s in (3, 9, 50)], "site long")
    own = df.select(F.col("site").alias("a"), F.col("media").alias("m"), F.lit(0).alias("side")).distinct()
    _, blocks, first = G._packed(own, touched.withColumnRenamed("site", "a"), 8)
    assert first == 1 and blocks > 7  # every row is sent to each of the first blocks
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and {a, b} & {3, 9, 50} and sets[a] & sets[b])
    assert sorted((r["a"], r["b"], r["shared"]) for r in G.shared_media_of(df, touched, block=8).collect()) == want


def all_paths(times, s, gamma, levels):
    """Least cost of any sequence of states, and that sequence."""
    gaps = [b - a for a, b in zip(times, times[1:])]
    base = len(times) / (times[-1] - times[0])
    best = None
    for path in product(range(levels), repeat=len(gaps)):
        cost, before = 0.0, 0
        for q, g in zip(path, gaps):
            rate = base * s**q
            cost += rate * g - math.log(rate) + gamma * max(0, q - before) * math.log(s)
            before = q
        if best is None or cost < best[0] - 1e-12:
            best = (cost, path)
    return best[1], gaps, base


@pytest.mark.parametrize("levels,parts", [(2, None), (2, 5), (3, 4)])
def test_bursts_against_all_paths(spark, levels, parts):
    rng = random.Random(levels)
    keys = {k: sorted({round(t, 3) for t in [rng.uniform(0, 100) for _ in range(5)] + [40 + rng.uniform(0, 2) for _ in range(4)]}) for k in range(4)}
    df = spark.createDataFrame([(k, t) for k, ts in keys.items() for t in ts] + [(99, 1.0)], "k long, t double")
    want, tree = [], []
    for k, ts in keys.items():
        path, gaps, base = all_paths(ts, 2.0, 1.0, levels)
        for level in range(1, levels):
            i = 0
            while i < len(path):
                j = i
                while j < len(path) and path[j] >= level:
                    j += 1
                if j > i:
                    low = [base * 2.0 ** (level - 1)] * (j - i)
                    high = [base * 2.0**q for q in path[i:j]]
                    saved = sum(math.log(h / l) - (h - l) * g for h, l, g in zip(high, low, gaps[i:j]))
                    tree.append((k, ts[i], ts[j], level, round(saved, 6)))
                    if level == 1:
                        want.append((k, ts[i], ts[j], max(path[i:j]), round(saved, 6)))
                i = j + 1
    shape = lambda df: sorted((r["k"], r["start"], r["end"], r["level"], round(r["weight"], 6)) for r in df.collect())
    assert shape(S.bursts(df, "k", "t", levels=levels, parts=parts)) == sorted(want) and want
    assert shape(S.bursts(df, "k", "t", levels=levels, parts=parts, nested=True)) == sorted(tree)


def test_burst_factor_and_ttl(spark):
    found = spark.createDataFrame([("a", 10.0, 20.0, 3.0), ("a", 90.0, 95.0, 100.0), ("b", 0.0, 1.0, 1.0)], "k string, start double, end double, weight double")
    got = {r["k"]: r["factor"] for r in S.burst_factor(found, "k", F.lit(44.0)).collect()}
    assert abs(got["a"] - 0.75 * 0.5) < 1e-12 and abs(got["b"] - 0.5 * 2 ** (-43 / 24)) < 1e-12
    assert spark.range(1).select(S.suggested_ttl(48.0, F.lit(1.0)), S.suggested_ttl(7.0, F.lit(0.9)), S.suggested_ttl(48.0, F.lit(0.0))).first()[:] == (48 * (1 - 0.8), 6.0, 48.0)


def test_calibrated_ttl_against_a_replay(spark):
    found = spark.createDataFrame([(1, 10.0, 30.0, 4.0), (1, 200.0, 220.0, 1.5)], "site long, start double, end double, weight double")
    spans = spark.createDataFrame([(1, 0.0, 400.0), (2, 5.0, 300.0)], "site long, lo double, hi double")
    truths = [(1, 25.0), (1, 26.0), (1, 215.0), (2, 290.0)]

    def replay(half, shrink):
        hits = visits = 0
        for site, lo, hi in ((1, 0.0, 400.0), (2, 5.0, 300.0)):
            now, times = lo, []
            while True:
                f = 0.0
                for k, a, b, w in ((1, 10.0, 30.0, 4.0), (1, 200.0, 220.0, 1.5)):
                    if k == site and now >= a:
                        f = max(f, w / (w + 1) * (1 if now <= b else 2 ** (-(now - b) / half)))
                now += min(720, max(6, 72 * (1 - shrink * f)))
                if now > hi:
                    break
                times.append(now)
            anchor = lo
            for k, g in truths:
                if k == site:
                    hits += any(anchor < x <= g for x in times)
                    anchor = g
            visits += len(times)
        return hits, visits

    rows = S.calibrate_ttl(found, spans, spark.createDataFrame(truths, "site long, at double"), "site", [6.0, 48.0], [0.5, 0.9]).collect()
    assert {(r["half_life"], r["shrink"]): (r["hits"], r["rescans"]) for r in rows} == {(h, s): replay(h, s) for h in (6.0, 48.0) for s in (0.5, 0.9)}
    for r in rows:
        beaten = any(o["hits"] >= r["hits"] and o["waste"] <= r["waste"] and (o["hits"], -o["waste"]) != (r["hits"], -r["waste"]) for o in rows)
        assert r["pareto"] == (not beaten) and r["truths"] == 4


def test_conformal_modes(spark):
    fit = lambda rows, target=0.8: S.conformal_threshold(S.suffix_counts(spark.createDataFrame(rows, "p4 long, y long"), "p4", "y").withColumnRenamed("p4", "score"), target).first()
    sure = fit([(9000, 1)] * 60 + [(1000, 0)] * 60)
    assert (sure["selection_mode"], sure["threshold"], sure["n"], sure["n_candidates"]) == ("ltt", 9000.0, 120, 2) and abs(sure["lower_bound"] - 0.05 ** (1 / 60)) < 1e-12
    assert abs(sure["p_value"] - 0.8**60) < 1e-12
    advisory = fit([(9000, 1)] * 60 + [(8000, 1)] * 4 + [(8000, 0)] * 16 + [(1000, 0)] * 60)
    assert (advisory["selection_mode"], advisory["threshold"], advisory["ltt_threshold"]) == ("ltt_advisory", 8000.0, 9000.0)
    assert fit([(9000, 1)] * 5 + [(10, 0)] * 40)["selection_mode"] == "empirical_fallback"
    assert fit([(9000, 1)] * 20)["selection_mode"] == fit([(9000, 0)] * 40)["selection_mode"] == "degraded"
    with pytest.raises(ValueError):
        fit([(1, 1)], 0.4)
    assert abs(S.upper_tail(3, 5, 0.4) - sum(math.comb(5, j) * 0.4**j * 0.6 ** (5 - j) for j in (3, 4, 5))) < 1e-12


def test_intervals_against_normal_ones(spark):
    rng = random.Random(2)
    rows = [("a", rng.randrange(100)) for _ in range(900)]
    values = np.array([v for _, v in rows])
    r = M.bootstrap_mean(spark.createDataFrame(rows, "k string, v long"), "k", "v").first()
    half = 1.96 * values.std() / 30
    assert r["mean"] == values.mean() and abs(r["lo"] - (values.mean() - half)) < 0.3 * half and abs(r["hi"] - (values.mean() + half)) < 0.3 * half
    p = M.sign_flip_test(spark.createDataFrame([("x", v) for v in (3, 4, 5, 6, 7, 8)] + [("y", v) for v in (3, -3, 4, -4)], "k string, v long"), "k", "v").collect()
    got = {r["k"]: r["p"] for r in p}
    assert abs(got["x"] - 2 / 64) < 0.015 and got["y"] == 1.0
    drift = S.drift_interval(spark.createDataFrame([("s", [50, 50], [60, 40])], "source string, ref array<long>, cur array<long>")).first()
    draws = sorted((x / 100 - 0.5) * math.log((x / 100) / (1 - x / 100)) for x in (random.Random(k).getrandbits(1) and 60 or 60 for k in range(1)))
    assert drift["psi_lo"] < draws[0] < drift["psi_hi"]
    assert abs(M.norm_ppf(0.975) - 1.959964) < 1e-6


def test_checkpoints_equal_all_rows(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), rng.random() < 0.7, float(rng.randrange(1000))) for _ in range(120)]
    df = lambda part: spark.createDataFrame(part, "provider string, correct boolean, t double")
    point = None
    for lo in range(0, 120, 40):
        point = S.bayes_checkpoint(df(rows[lo : lo + 40]), 300.0, point)
    got = {r["provider"]: r["weight"] for r in S.checkpoint_weights(point, F.lit(1200.0), 300.0).collect()}
    want = {r["provider"]: r["weight"] for r in S.bayes_weights(df(rows), F.lit(1200.0), 300.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    with pytest.raises(Exception, match="later than"):
        S.checkpoint_weights(point, F.lit(1.0), 300.0).collect()


def test_adaptive_band_falls_back(spark):
    few = spark.createDataFrame([(0.5, 1.0, False, None)] * 5, "score double, cost double, escalated boolean, correct boolean")
    assert S.adaptive_band(few, 0.2, 0.8, 0.5).first()[:2] == (0.2, 0.8)
    many = spark.createDataFrame([(0.01 * k, 1.0 + 2 * (k % 2), bool(k % 2), None) for k in range(100)], few.schema)
    assert S.adaptive_band(many, 0.2, 0.8, None).first()[:2] == (0.2, 0.8)
    low, high, _ = S.adaptive_band(many, 0.2, 0.8, 0.3).first()
    assert (low, high) == (0.26, 0.74)  # a fifth narrower at most


def test_select_round_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, i, float(rng.randrange(1, 50)), float(rng.randrange(1, 12))) for k in range(4) for i in range(25)]
    want = []
    for k in range(4):
        left = 20.0
        for _, i, v, c in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2] / r[3], r[1])):
            if c <= left:
                left -= c
                want.append((k, i))
    df = spark.createDataFrame(rows, "k long, id long, value double, cost double")
    assert sorted((r["k"], r["id"]) for r in S.select_round(df, "k", "value", "cost", 20.0).collect()) == sorted(want)


def test_send_gate_against_a_loop(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for site in (1, 2):
        base = [rng.getrandbits(64) for _ in range(4)]
        for _ in range(40):
            h = rng.choice(base)
            for _ in range(rng.randrange(0, 5)):
                h ^= 1 << rng.randrange(64)
            rows.append((site, at, f"s{rng.randrange(60)}" if rng.random() < 0.3 else f"u{at}", H.signed(h), rng.choice((10, 300)), rng.choice((10, 300))))
            at += 1
    want = {}
    for site in (1, 2):
        seen, sent = set(), []
        for s, pos, sha, h, w, t in (r for r in rows if r[0] == site):
            if sha in seen:
                want[pos] = "copy"
            elif w < 200 and t < 200:
                want[pos] = "small"
            elif any(((h ^ x) & (1 << 64) - 1).bit_count() <= 4 for x in sent):
                want[pos] = "near"
            else:
                want[pos] = "sent"
                sent.append(h)
            seen.add(sha)
    df = spark.createDataFrame(rows, "site long, pos long, sha string, h long, width long, height long")
    got = {r["pos"]: r["decision"] for r in S.send_gate(df, "site", "pos").collect()}
    assert got == want and {"copy", "small", "near", "sent"} == set(want.values())


def test_deep_spans_and_bounds(spark):
    rows = [(1, str(k), str(k - 1) if k else None) for k in range(40)] + [(1, "x", "gone"), (2, "a", "b"), (2, "b", "a")]
    df = spark.createDataFrame(rows, "trace_id long, span_id string, parent_span_id string")
    got = {(r["span_id"]): (r["depth"], r["root"]) for r in ledger.span_tree(df).collect()}
    assert got == {**{str(k): (k, "0") for k in range(40)}, "x": (0, "x")}
    with pytest.raises(ValueError):
        ledger.span_tree(df, 10)


def test_page_text():
    assert html.read("<title>A&amp;B</title><style>x</style><p>one</p>two<script>no</script>") == ("A&B", "one two")
    assert html.read(None) == ("", "")


def test_tfidf_of_empty_text(spark):
    seeds = spark.createDataFrame([(1, "good words here", True), (2, "bad terms there", False)], "id long, text string, positive boolean")
    texts = spark.createDataFrame([(5, ""), (6, "good words")], "id long, text string")
    got = {r["id"]: r["risk"] for r in search.tfidf_kernel(texts, seeds).collect()}
    assert got[5] == 0.5 and got[6] > 0.9


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# list\nexample.com\n\nftp://x.y\nexample.com\nhttps://b.org/p\n")
    valid, rejected = readers.url_list(spark, str(tmp_path / "u.txt"))
    assert sorted(r["url"] for r in valid.collect()) == ["https://b.org/p", "https://example.com"] and rejected.first()["reason"] == "scheme"
    (tmp_path / "u.csv").write_text("﻿网址,x\na.com,1\n", encoding="utf-8")
    assert readers.url_list(spark, str(tmp_path / "u.csv"))[0].first()["url"] == "https://a.com"
    (tmp_path / "w.yaml").write_text("- url: https://a.com/\n  note: hi\n- url: https://b.com/\n  enabled: false\n")
    assert sorted(tuple(r) for r in readers.watchlist(spark, str(tmp_path / "w.yaml")).collect()) == [("https://a.com/", "hi", True), ("https://b.com/", "", False)]
    (tmp_path / "s.jsonl").write_text('# model=m1 run\n{"sha256": "x", "nsfw_prob": 0.5}\nbad\n')
    assert readers.score_file(spark, str(tmp_path / "s.jsonl")).first().asDict() == {"model": "m1", "sha256": "x", "nsfw_prob": 0.5, "error": None}
    (tmp_path / "c.jsonl").write_text(json.dumps({"provider": "p", "images": 3}) + "\n{oops\n")
    assert readers.json_lines(spark, str(tmp_path / "c.jsonl"), "provider string, images long", needs=["provider"]).count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "c.jsonl"), "provider string, images long", strict=True).collect()
    (tmp_path / "m.md").write_text("# top\n## One\ntext a\n## Two\ntext b\n")
    assert [r["title"] for r in readers.markdown_chunks(spark, str(tmp_path / "m.md")).orderBy("nth").collect()] == ["One", "Two"]
    lines = sinks.exposition(spark.createDataFrame([("a.b", 3)], "name string, value long"), spark.createDataFrame([("g", 1)], "name string, value long"))
    assert sorted(tuple(r) for r in sinks.parse_exposition(lines).collect()) == [("a_b_total", 3.0), ("g", 1.0)]


def test_image_size():
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    assert readers.image_size(png) == (7, 9) and readers.image_size(b"GIF89a\x03\0\x04\0") == (3, 4) and readers.image_size(b"??") is None and readers.image_size(None) is None


def test_stream_equals_batch(spark, tmp_path):
    """Scores come up to an hour late, in four batches; a key is quiet for so long that it starts anew."""
    from lumasift.plans.streams import ROCKSDB, _settings

    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(6), i, rng.randrange(10001), start + datetime.timedelta(minutes=10 * i)) for i in range(120)]
    rows += [(50, 200, 100, start), (50, 201, 100, start + datetime.timedelta(minutes=10)), (51, 900, 5000, start + datetime.timedelta(days=9))]
    shuffled = sorted(rows, key=lambda r: (r[3] + datetime.timedelta(minutes=rng.randrange(50)), r[1]))
    schema = "site long, seq long, p4 long, ts timestamp"
    for k in range(4):
        spark.createDataFrame(shuffled[31 * k : 31 * k + 31], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with _settings(spark, ROCKSDB):
        processors.sprt(stream, late="1 hour", forget_hours=48).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r["site"]: (r["state"], r["used"]) for r in spark.read.schema("site long, state string, used long").parquet(str(tmp_path / "out")).collect()}
    batch = S.sprt(spark.createDataFrame(rows, schema), "site", "seq", F.col("p4") / 10000.0).collect()
    assert got == {r["site"]: (r["state"], r["used"]) for r in batch if r["state"] != "undecided"} and got[50] == ("clean", 2)


def test_burst_tree_against_containment(spark):
    """Parents are the one burst of the level below that holds a burst; a key has a third of the rows, in several parts."""
    rng = random.Random(8)
    rows = []
    for k in range(6):
        at = 0.0
        for _ in range(400 if k == 0 else 60):
            at += rng.expovariate(rng.choice([0.05, 1.0, 20.0, 400.0]) if rng.random() < 0.3 else 1.0)
            rows.append((None if k == 5 else k, at))
    df = spark.createDataFrame(rows, "k long, t double")
    found = S.bursts(df, "k", "t", levels=4, nested=True, parts=6)
    one = S.bursts(df, "k", "t", levels=4, nested=True, parts=1)
    shape = lambda d: sorted((str(r["k"]), r["level"], r["start"], r["end"], round(r["weight"], 6)) for r in d.collect())
    assert shape(found) == shape(one)
    tree = S.burst_tree(found, "k", 4).collect()
    for r in tree:
        over = [x for x in tree if x["k"] == r["k"] and x["level"] == r["level"] - 1 and x["start"] <= r["start"] and r["end"] <= x["end"]]
        assert [x["start"] for x in over] == ([] if r["level"] == 1 else [r["parent"]])
        assert r["children"] == sum(x["k"] == r["k"] and x["level"] == r["level"] + 1 and x["parent"] == r["start"] for x in tree)
    assert {r["level"] for r in tree} == {1, 2, 3}


def test_next_images_against_a_loop(spark):
    rng = random.Random(12)
    rows = [(s, i, rng.choice([0.02, 0.5, 0.97, rng.random()])) for s in range(9) for i in range(rng.randrange(1, 15))]
    df = spark.createDataFrame(rows, "site long, image long, p double")

    def loop(most):
        found = {}
        for s in range(9):
            total, own = 0.0, []
            for _, i, p in sorted((round(abs(p - 0.5), 9), i, p) for k, i, p in rows if k == s)[:most]:
                x = min(0.99, max(0.01, p))
                total += x * math.log(0.9 / 0.5) + (1 - x) * math.log(0.1 / 0.5)
                own.append(i)
                if total >= math.log(19) or total <= -math.log(19):
                    break
            found[s] = own
        return found

    for most in (1, 5, 20):
        want = loop(most)
        got = S.next_images(df, "site", "image", F.col("p"), most).orderBy("site", "nth").collect()
        assert {s: [r["image"] for r in got if r["site"] == s] for s in range(9)} == want
        for budget in (0, 4, 17, 10_000):
            spent = [(n, s, i) for s, own in want.items() for n, i in enumerate(own)]
            cut = S.next_images(df, "site", "image", F.col("p"), most, budget).collect()
            assert sorted((r["nth"] - 1, r["site"], r["image"]) for r in cut) == sorted(spent)[:budget]


def test_folds_saved_and_loaded(spark, tmp_path):
    rng = random.Random(21)
    rows = [(rng.choice("ab"), rng.random() < 0.8, float(rng.randrange(4000))) for _ in range(700)]
    df = spark.createDataFrame(rows, "provider string, correct boolean, t double")
    once = {r["provider"]: r for r in S.bayes_checkpoint(df, 300.0).collect()}
    for every in (1, 64, 10_000):
        for r in S.folded_checkpoint(df, 300.0, every).collect():
            want = once[r["provider"]]
            assert abs(r["good"] - want["good"]) < 1e-9 and abs(r["bad"] - want["bad"]) < 1e-9 and (r["n"], r["anchor"]) == (want["n"], want["anchor"])
    path = f"file://{tmp_path}/kept"
    S.save_checkpoint(S.bayes_checkpoint(df, 300.0), path, 300.0)
    assert {r["provider"]: r["good"] for r in S.load_checkpoint(spark, path, 300.0).collect()} == {k: r["good"] for k, r in once.items()}
    with pytest.raises(ValueError):
        S.load_checkpoint(spark, path, 60.0)


@pytest.mark.parametrize("block", [5, 16, 1 << 15])
def test_near_prints_in_blocks(spark, block):
    """Every pair once, also with empty blocks, equal prints, nulls and two tables; nothing but the blocks is shuffled."""
    prints = near_prints(9, range(1, 10)) + [(500, 5), (501, 5)]
    df = spark.createDataFrame(prints + [(600, None)], "sha long, h long")
    near = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= 8
    got = H._near(df, None, 8, block)
    assert sorted(tuple(r)[:2] for r in got.collect()) == sorted((a, b) for a, x in prints for b, y in prints if a < b and near(x, y))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") <= 2
    both = H._near(df.filter("sha % 2 = 0"), df, 8, block)
    assert sorted(tuple(r)[:2] for r in both.collect()) == sorted((a, b) for a, x in prints for b, y in prints if a % 2 == 0 and near(x, y))


def test_lossy_pairs_are_those_that_keys_let_meet(spark):
    prints = near_prints(10, range(1, 13))
    df = spark.createDataFrame(prints, "sha long, h long")
    pairs = [(a, b, (x ^ y) & (1 << 64) - 1) for a, x in prints for b, y in prints if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 12]
    banded = sorted((a, b) for a, b, diff in pairs if any(diff >> at & (1 << w) - 1 == 0 for at, w in H.band_layout(8)))
    keyed = sorted((a, b) for a, b, diff in pairs if any(sum(diff >> k & 1 for k in bits) <= 2 for bits in H.table_masks()))
    assert sorted(tuple(r)[:2] for r in H.self_join(df, 12, bands=8, radius=0).collect()) == banded
    assert sorted(tuple(r)[:2] for r in H.multi_table_pairs(df, 12).collect()) == keyed
    assert len(banded) < len(pairs)


def test_grams_of_texts_are_not_shuffled(spark):
    """Texts are sent to their ids' tasks; counts of grams stay there, and repeated ids count together."""
    seeds = spark.createDataFrame([(1, "abcabc", True), (2, "xyzxy", False)], "id long, text string, positive boolean")
    texts = spark.createDataFrame([("1", "abcab"), ("2", "xy"), ("2", "zz"), ("3", "q"), ("4", None), ("5", "")], "id string, text string")
    found = search.tfidf_kernel(texts, seeds)
    got = sorted(tuple(r) for r in found.collect())
    assert [r[0] for r in got] == list("122345") and got[0][1] > 0.5 and got[0][2] == 0.0 and got[1] == got[2] and got[1][2] > 0
    assert all(r[1:] == (0.0, 0.0, 0.5) for r in got[3:])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # ids of texts are strings, those of seeds longs
    exchanges = [line for line in plan.splitlines() if re.search(r"hashpartitioning\(id#\d+,", line)]
    assert exchanges and not any("gram" in line for line in exchanges)


def test_bm25_adds_up_in_blocks(spark):
    """Scores of a query and a document are added up within a cell, and only the best leave it; a repeated query counts once."""
    rng = random.Random(21)
    docs = [(None if k == 9 else k, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 12)))) for k in range(60)] + [(100 + k, "a b c") for k in range(6)]
    asked = [(k, " ".join(rng.choice("abcdefghijz") for _ in range(rng.randrange(1, 4)))) for k in range(12)] + [(0, "a b"), (0, "a b"), (50, "zz")]
    df, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    split = lambda text: [w for w in text.split(" ") if w]
    n, mean = len(docs), sum(len(split(x)) for _, x in docs) / len(docs)
    df_of = {w: sum(w in split(x) for _, x in docs) for w in "abcdefghij"}
    wanted = {}
    for k, x in asked:
        wanted.setdefault(k, set()).update(split(x))
    want = []
    for k, ws in wanted.items():
        rows = []
        for d, x in docs:
            hits = [w for w in ws if w in split(x)]
            score = sum(math.floor(math.log(1 + (n - df_of[w] + 0.5) / (df_of[w] + 0.5)) * split(x).count(w) * 2.5 / (split(x).count(w) + 1.5 * (0.25 + 0.75 * len(split(x)) / mean)) * 1e6 + 0.5) for w in hits)
            rows += [(-score, -1 if d is None else d)] if hits else []
        want += [(k, None if d < 0 else d, -s / 1e6, i + 1) for i, (s, d) in enumerate(sorted(rows)[:5])]
    words = F.filter(F.split("text", " "), lambda w: w != "")
    for blocks in ((4096, 512), (7, 3)):
        found = search.bm25(df, q, words, words, doc_block=blocks[0], query_block=blocks[1])
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
        assert "HashAggregate" not in found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
