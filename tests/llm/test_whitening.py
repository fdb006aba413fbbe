import math

import numpy as np
import pytest

from lumasift.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n int"


def brute(vectors, wanted=4, scale=256):
    """x, n, S, eigenvalues, components and trace, with numpy over the whole fit list."""
    xs = [[math.floor(scale * float(np.float32(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, xs)))
    a = np.array(fit, dtype=np.float64)
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    a -= np.array([t / n for t in s])
    v = a.T @ a / n
    e, u = np.linalg.eigh(v)
    return xs, n, s, e[::-1][:wanted], u[:, ::-1][:, :wanted], np.trace(v)


def clustered(rng, n, d):
    """Three directions that stand out, then little."""
    return (rng.standard_normal((n, 3)) * [2, 1, 0.5]) @ rng.standard_normal((3, d)) / math.sqrt(d) + 0.001 * rng.standard_normal((n, d))


def rows_of(vectors):
    return [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("kind", ["even", "steep", "narrow", "hot"])
def test_against_numpy(spark, tmp_path, kind):
    rng = np.random.default_rng(len(kind))
    vectors = {"even": lambda: rng.standard_normal((700, 40)) * np.linspace(1, 2, 40), "steep": lambda: rng.standard_normal((700, 40)) * 30 * 0.03 ** np.arange(40), "narrow": lambda: rng.standard_normal((300, 3)), "hot": lambda: np.vstack([clustered(rng, 400, 24), np.tile(clustered(rng, 1, 24), (300, 1))])}[kind]()
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(7)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    xs, n, s, e, u, trace = brute(vectors)
    got = W.query(spark, str(tmp_path)).collect()
    assert len(got) == len(xs) * len(e)
    signs = {}
    a = np.array(xs, dtype=np.float64) - np.array([t / n for t in s])
    z = a @ u / np.sqrt(e)
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, sum((n * x - t) ** 2 for x, t in zip(xs[i], s)))
        assert abs(r["explained"] - e[c] / trace) < 1e-9 * e[c] / trace
        assert r["identity_error"] < 1e-9
        if abs(z[i, c]) > 1e-3:
            signs.setdefault(c, set()).add(np.sign(r["whitened"] / z[i, c]))
        assert abs(abs(r["whitened"]) - abs(z[i, c])) < 1e-7
    assert all(len(v) == 1 for v in signs.values()) and len(signs) == len(e)


def test_range_finder_alone_and_expanded(spark):
    rng = np.random.default_rng(3)
    steep = W.learn(W.quantised(spark.createDataFrame(rows_of(rng.standard_normal((500, 64)) * 2000 * 0.05 ** np.minimum(np.arange(64), 6)), SCHEMA), "vec_id", "embedding"))
    assert not steep.expanded and steep.passes <= 1 + W.PASSES
    even = W.quantised(spark.createDataFrame(rows_of(rng.standard_normal((500, 64))), SCHEMA), "vec_id", "embedding")
    one = W.learn(even)
    assert one.expanded and one.passes == 2 + W.PASSES and one.identity_error < 1e-9
    # another seed and blocks of a few columns: the same components
    whole, W.BLOCK = W.BLOCK, 64 * 5
    try:
        two = W.learn(even, seed=5)
    finally:
        W.BLOCK = whole
    assert np.allclose(one.eigenvalues, two.eigenvalues, rtol=1e-12) and np.allclose(abs((one.components * two.components).sum(axis=0)), 1, atol=1e-10)


def test_nulls_lengths_ties_and_no_variance(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0, 0), (1, [1.0, 2.0], 0, 0), (None, [1.0, -2.0], 0, 0), (2, None, 0, 0), (3, [nan, 1.0], 0, 0), (4, [None, 1.0], 0, 0), (5, [inf, 1.0], 0, 0), (6, [], 0, 0), (7, [1.0], 0, 0), (8, [-0.0, 3e38], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened int, n int")
    out, found = W.whiten(df)
    got = out.collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 1, 8] and found.n == 3
    xs = {(256, 512), (256, -512), (0, (1 << 63) - 1)}
    s = [sum(c) for c in zip(*xs)]
    want = sum((3 * x - t) ** 2 for x, t in zip((256, 512), s))
    assert {r["deviation"] for r in got if r["vec_id"] == 1} in ({want}, {None})
    flat, found = W.whiten(spark.createDataFrame(rows[:2], df.schema))
    assert found.trace == 0 and found.identity_error is None and [r["whitened"] for r in flat.collect()] == [[None, None]] * 2
    none, found = W.whiten(df.filter("vec_id = 99"))
    assert found is None and none.count() == 0 and none.columns == ["vec_id", "deviation", "whitened"]


def test_query_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.query(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
