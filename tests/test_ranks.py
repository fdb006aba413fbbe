import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumasift.operators import graph as G
from lumasift.operators import ranks as K


@pytest.mark.parametrize("parts", ["3", "17"])
def test_places_of_a_hot_group(spark, parts):
    """One group has a third of the rows, and one value a third of these."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b", None, f"g{k}"]), rng.choice([7, rng.randrange(50), None]), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, v long, k long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = K.numbered(df, ["g"], [F.col("v").desc()]).withColumn("t", K.tile(F.col("i"), F.col("n"), 4)).collect()
        halves = {r["g"]: r["v"] for r in K.discrete_percentile(df, ["g"], "v", 0.5).collect()}
        alone = K.numbered(df, [], [F.col("k").asc()]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    own = defaultdict(list)
    for r in got:
        own[r["g"]].append((r["i"], r["v"], r["n"], r["t"]))
    assert sorted(r["k"] for r in got) == list(range(900))
    for g, placed in own.items():
        placed.sort()
        want = sorted((v for h, v, _ in rows if h == g), key=lambda v: (v is None, -(v or 0)))
        assert [i for i, *_ in placed] == list(range(len(want))) and [v for _, v, *_ in placed] == want and {n for _, _, n, _ in placed} == {len(want)}
        small, more = divmod(len(want), 4)
        assert [t for *_, t in placed] == [k + 1 for k in range(4) for _ in range(small + (k < more))]
        known = sorted(v for v in want if v is not None)
        assert halves.get(g) == (known[-(-len(known) // 2) - 1] if known else None)
    assert [r["k"] for r in sorted(alone, key=lambda r: r["i"])] == list(range(900))


def test_touched_sites_of_a_hot_medium(spark):
    rng = random.Random(5)
    rows = [(s, 0) for s in range(80)] + [(rng.randrange(80), rng.randrange(1, 30)) for _ in range(200)]
    df = spark.createDataFrame(rows, "site long, media long")
    touched = spark.createDataFrame([(3,), (4,), (200,)], "site long")
    every = {tuple(r) for r in G.shared_media(df).filter("a IN (3, 4) OR b IN (3, 4)").collect()}
    assert {tuple(r) for r in G.shared_media_of(df, touched, block=9).collect()} == every and len(every) > 100


def test_shared_media_shuffles_no_pairs(spark):
    """60 sites that all share 40 media meet 70,800 times; what is shuffled is the rows, at most once a block."""
    df = spark.createDataFrame([(s, f"m{m}") for s in range(60) for m in range(40)], "site long, media string")
    for block in (7, 4096):
        edges = G.shared_media(df, block=block)
        assert edges.count() == 60 * 59 // 2 and edges.agg({"shared": "min", "weight": "min"}).first().asDict() == {"min(shared)": 40, "min(weight)": 1.0}
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("hashpartitioning") <= 2


def test_media_changes_count_side_by_side(spark):
    rng = random.Random(4)
    old, new = ({(rng.randrange(30), rng.randrange(60)) for _ in range(150)} for _ in range(2))
    frames = [spark.createDataFrame(sorted(rows) + [(None, 1), (3, None)], "site long, media long") for rows in (old, new)]
    want = {tuple(r) for r in G.edge_changes(*(G.shared_media(df).select("a", "b") for df in frames)).collect()}
    rows = [tuple(r) for r in G.media_changes(*frames, block=9).collect()]
    assert set(rows) == want and len(rows) == len(want) and {r[2] for r in rows} == {"new", "stale"}
