import random
from collections import Counter, defaultdict

import pytest

from lumasift.llm import mixing as M


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return full
        left = total - sum(full.values())
        level = left / sum(w[s] for s in open_)
        above = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not above:
            return full | {s: level * w[s] for s in open_}
        full |= {s: cap * sizes[s] for s in above}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_totals(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choices(["a", "b", "é", "c", None], [9, 1, 1, 2, 1])[0]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = M.mix(df, fan_in=16).collect()
    sizes, taken, target = Counter(), Counter(), {}
    of = {i: (len(t.split()), s) for i, t, s in rows}
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    for r in got:
        n, s = of[r["doc_id"]]
        assert r["size"] == n and r["taken"] in (0, n, 2 * n)
        sizes[s] += n
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = filled(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 40
    again = M.mix(df.repartition(3), fan_in=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_repeated_rows_nulls_and_clashes(spark):
    rows = [(1, "a b", "s", 7)] * 10 + [(None, "c", "s", 1), (2, None, "s", 1), (3, " \t\n", None, 1), (4, "x y z", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    assert sum(r["taken"] for r in got if r["doc_id"] == 3) == 0 and {r["size"] for r in got if r["doc_id"] == 2} == {0}
    by = defaultdict(int)
    for r in got:
        by[r["target"]] += r["taken"]
    assert all(abs(t - n) <= 3 for t, n in by.items())
    mixed = M.mixed(df)
    assert mixed.columns == df.columns and sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0 and M.mixed(df).count() == 0


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = M.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_word_count_matches_the_pattern(spark):
    import re

    texts = ["", " ", "a", " a\tb\x0bc\x0cd\re\n", "x x", "é ü", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(M.word_count(M.F.col("text"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="test tables are absent")
def test_sources_of_the_given_table_come_within_a_hundredth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    got = M.query(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert len(target) == 20 and all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def test_long_texts_are_settled_against_all_others(spark):
    """One text is longer than half of its source; one source is a single text, one has two."""
    rng = random.Random(9)
    rows = [(0, "w " * 30_000, "a")] + [(i, "w " * rng.randrange(1, 400), "a") for i in range(1, 150)] + [(500, "w " * 9_000, "b"), (501, "w " * 700, "c"), (502, "w " * 40, "c")]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    of = {r[0]: r[2] for r in rows}
    for s in "abc":
        own = [r for r in got if of[r["doc_id"]] == s]
        least = min(r["size"] for r in own)
        off = abs(sum(r["taken"] for r in own) - own[0]["target"])
        assert off <= (400 if s == "a" else max(r["size"] for r in own)) and least


def test_expectations_stay(spark):
    """Over many sources of alike documents, those that the others can bear either way are taken as often as the target says."""
    sizes = list(range(60, 35, -1))
    rows = [(100 * s + i, "w " * n, f"s{s:03d}") for s in range(300) for i, n in enumerate(sizes)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=0.6).collect()
    share = [sum(r["taken"] for r in got if r["doc_id"] % 100 == i) / n / 300 for i, n in enumerate(sizes)]
    assert all(abs(x - 0.6) < 0.1 for x in share[:18]) and abs(sum(share[:18]) / 18 - 0.6) < 0.03
