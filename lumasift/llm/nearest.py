"""Approximate nearest neighbours: stable projections, kd-trees, chi-square stopping.

A seeded Gaussian matrix projects vectors to ``PROJECTED`` dimensions.  For two
vectors at distance d, the squared projected distance is d^2 times a chi-square
variable.  So a search that takes points in order of projected distance may stop
at projected distance p, once p^2 / d_k^2 reaches the ``SURE`` quantile, where
d_k is the k-th smallest true distance so far: a nearer point is still unseen
with a chance of at most 1 - SURE each.

In Spark:

1. Equal vectors become one point with its smallest ids (a top-k per group, cut
   before the shuffle), so a vector that a third of all rows share is one point.
2. Split planes of a kd-tree over the projections are fitted on at most
   ``FIT_ROWS`` points; every point goes to a leaf, and a leaf of more than
   ``BLOCK_ROWS`` points is dealt to several blocks.  The tree has at most
   ``MAX_LEAVES`` leaves, so the broadcast planes are bounded.
3. Each query searches the blocks of its own leaf, which gives a first d_k; then
   those of the ``NEXT_LEAVES`` leaves whose boxes are nearest, which lowers d_k;
   then those of all other leaves whose box is nearer than the stopping distance.
   A box is that of the leaf's own points.  In a block a local kd-tree hands out
   its buckets by projected distance.
4. Each query's best rows of all blocks are merged.

Queries meet a block in batches of ``QUERY_ROWS``; a task holds a batch and a
block, and there are as many tasks as such meetings, up to ``MAX_TASKS``.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; a query with fewer candidates
returns them all; ties go to the smaller id; repeated ids are rows of their
own; a null id takes no part; empty input gives an empty result; extra columns
play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumasift.llm.common import saved, table

PROJECTED, SURE, SEED = 10, 0.97, 4711
FIT_ROWS, BLOCK_ROWS, QUERY_ROWS, MAX_LEAVES = 20_000, 4096, 256, 4096
NEXT_LEAVES, MAX_TASKS = 4, 4096
BUCKET = 256


def chi_square_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function of k/2 at x/2, by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 10.0 * k + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, k) < p else (lo, mid)
    return hi


def projection(dim: int, to: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, to))


def fit_planes(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Split planes of a balanced tree in heap order: (axis, value); leaves is a power of two."""
    planes: list[tuple[int, float]] = []
    parts = [points]
    while len(parts) < leaves:
        halves = []
        for p in parts:
            axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            value = float(np.median(p[:, axis])) if len(p) else 0.0
            planes.append((axis, value))
            halves += [p[p[:, axis] < value], p[p[:, axis] >= value]]
        parts = halves
    return planes


def leaf_of(points: np.ndarray, planes: list[tuple[int, float]], leaves: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    axes = np.array([a for a, _ in planes] or [0])
    values = np.array([v for _, v in planes] or [0.0])
    for _ in range(leaves.bit_length() - 1):
        right = points[np.arange(len(points)), axes[node]] >= values[node]
        node = 2 * node + 1 + right
    return node - (leaves - 1)


class Tree:
    """A kd-tree of one block whose leaves are buckets of points."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []
        self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        p = self.points[rows]
        me = len(self.nodes)
        box = (p.min(0), p.max(0))
        self.nodes.append(())
        axis = int(np.argmax(box[1] - box[0]))
        if len(rows) <= BUCKET or box[0][axis] == box[1][axis]:
            self.nodes[me] = (*box, rows, -1, -1)
        else:
            half = np.argpartition(p[:, axis], len(rows) // 2)
            left, right = self._build(rows[half[: len(rows) // 2]]), self._build(rows[half[len(rows) // 2 :]])
            self.nodes[me] = (*box, None, left, right)
        return me

    def _far(self, node: int, q: np.ndarray) -> float:
        lo, hi = self.nodes[node][:2]
        d = np.maximum(0, np.maximum(lo - q, q - hi))
        return float(d @ d)

    def buckets(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared projected distance of all that is left, rows), nearest first."""
        heap = [(self._far(0, q), 0)]
        while heap:
            far, node = heapq.heappop(heap)
            _, _, rows, left, right = self.nodes[node]
            if rows is not None:
                yield far, rows
            else:
                heapq.heappush(heap, (self._far(left, q), left))
                heapq.heappush(heap, (self._far(right, q), right))


def search(tree: Tree, vectors: np.ndarray, weights: np.ndarray, q_low: np.ndarray, q: np.ndarray, k: int, bound: float, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of at least the k nearest found; ``weights``: rows that a point stands for.

    ``bound``: a squared distance that k rows elsewhere don't exceed.
    """
    rows = np.zeros(0, np.int64)
    dist = np.zeros(0)
    for far, bucket in tree.buckets(q_low):
        if far > quantile * bound:
            break
        low = tree.points[bucket] - q_low
        bucket = bucket[np.einsum("ij,ij->i", low, low) <= quantile * bound]
        diff = vectors[bucket] - q
        d = np.einsum("ij,ij->i", diff, diff)
        rows, dist = np.append(rows, bucket[d <= bound]), np.append(dist, d[d <= bound])
        order = np.argsort(dist, kind="stable")
        enough = np.searchsorted(np.cumsum(weights[rows[order]]), k)
        if enough < len(order):
            bound = min(bound, float(dist[order[enough]]))
            order = order[dist[order] <= bound]
        rows, dist = rows[order], dist[order]
    return rows, dist


def _points(vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """Distinct vectors: point, v, ids (the k + 1 smallest)."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = vectors.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return first.groupBy("v").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids"))


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, sure: float = SURE, block_rows: int = BLOCK_ROWS, projected: int = PROJECTED) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, against all rows."""
    whole = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = whole.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)
    common = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 1
    whole = whole.filter(F.size("v") == dim)
    points = saved(_points(whole, dim, k), "ann-points")
    n_points = points.count()
    leaves = 1
    while leaves < MAX_LEAVES and leaves * block_rows < n_points:
        leaves *= 2
    matrix = projection(dim, projected)
    sample = points.orderBy(F.xxhash64("point")).limit(FIT_ROWS).select("v")
    fit = np.array([r["v"] for r in sample.toLocalIterator()]).reshape(-1, dim) @ matrix
    planes = fit_planes(fit, leaves)
    quantile = chi_square_quantile(sure, projected)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                low = np.stack(df["v"].to_numpy()) @ matrix
                yield df.assign(leaf=leaf_of(low, planes, leaves), low=list(low))

    leafed = saved(points.mapInPandas(place, "v array<double>, point long, ids array<long>, leaf long, low array<double>"), "ann-leafed")
    # one row a leaf
    sides = [f(F.col("low")[k]).alias(f"{name}{k}") for name, f in (("lo", F.min), ("hi", F.max)) for k in range(projected)]
    lows, highs = np.full((leaves, projected), np.inf), np.full((leaves, projected), -np.inf)
    n_blocks = 0
    for r in leafed.groupBy("leaf").agg(F.count("*").alias("n"), *sides).collect():
        lows[r["leaf"]], highs[r["leaf"]] = ([r[f"{name}{k}"] for k in range(projected)] for name in ("lo", "hi"))
        n_blocks += -(-r["n"] // block_rows)
    leafed = leafed.drop("low")
    # a leaf's points are dealt to blocks by hash
    blocks = leafed.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("blocks"))
    indexed = leafed.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks"))).drop("blocks")

    asked = whole.filter(F.pmod(F.col("id"), F.lit(every)) == 0).select(F.col("id").alias("query_id"), "v")
    # queries of one vector are searched once
    queries = saved(asked.groupBy("v").agg(F.min("query_id").alias("q")), "ann-queries")

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                yield df.assign(leaf=leaf_of(np.stack(df["v"].to_numpy()) @ matrix, planes, leaves), bound=np.inf)

    def others(first: int, last: int | None):
        """The leaves within the stopping distance other than its own, from ``first`` to ``last`` by distance."""

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                if not len(df):
                    continue
                low = np.stack(df["v"].to_numpy()) @ matrix
                own = leaf_of(low, planes, leaves)
                for i in range(len(df)):
                    gap = np.maximum(0, np.maximum(lows - low[i], low[i] - highs))
                    far = (gap * gap).sum(1)
                    far[own[i]] = np.inf
                    order = np.argsort(far, kind="stable")[first:last]
                    near = order[far[order] <= quantile * df["bound"].iloc[i]]
                    near = near[np.isfinite(far[near])]
                    if len(near):
                        yield pd.DataFrame({"v": [df["v"].iloc[i]] * len(near), "q": df["q"].iloc[i], "leaf": near, "bound": df["bound"].iloc[i]})

        return apply

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["q", "d", "vec_id"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        vectors = np.stack(right["v"].to_numpy())
        tree = Tree(vectors @ matrix)
        ids = right["ids"].to_numpy()
        weights = np.array([len(x) for x in ids])
        out = []
        for q, v, bound in zip(left["q"], left["v"], left["bound"]):
            rows, d = search(tree, vectors, weights, v @ matrix, v, k + 1, bound, quantile)
            hits = sorted((x, i) for r, x in zip(rows.tolist(), d.tolist()) for i in ids[r].tolist())[: k + 1]
            out += [(q, x, i) for x, i in hits]
        return pd.DataFrame(out, columns=columns)

    def met(sent: DataFrame) -> DataFrame:
        """Queries (v, q, leaf, bound) with the rows that they find in their leaf's blocks."""
        batches = sent.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).alias("batches"))
        dealt = sent.join(batches, "leaf").join(blocks, "leaf")
        dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("q"), F.col("batches"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        there = indexed.join(batches, "leaf").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)))
        keys = ["leaf", "block", "batch"]
        # the rows are few and their work is long, so the number of tasks is given
        left = dealt.select(*keys, "q", "v", "bound").repartition(tasks, *keys)
        right = there.select(*keys, "v", "ids").repartition(tasks, *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q long, d double, vec_id long")

    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))

    def bounded(found: DataFrame) -> DataFrame:
        bounds = found.withColumn("n", rank).filter(F.col("n") == k + 1).select("q", F.col("d").alias("bound"))
        return queries.join(bounds, "q", "left").select("v", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    sent = "v array<double>, q long, leaf long, bound double"
    tasks = max(1, min(MAX_TASKS, n_blocks * max(1, -(-queries.count() // QUERY_ROWS))))
    found = saved(met(queries.mapInPandas(home, sent)), "ann-first")
    if leaves > NEXT_LEAVES + 1:
        found = saved(found.unionByName(met(bounded(found).mapInPandas(others(0, NEXT_LEAVES), sent))), "ann-next")
        found = found.unionByName(met(bounded(found).mapInPandas(others(NEXT_LEAVES, None), sent)))
    else:
        found = found.unionByName(met(bounded(found).mapInPandas(others(0, None), sent)))
    found = found.withColumn("n", rank).filter(F.col("n") <= k + 1).select("q", "d", "vec_id")
    answers = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id"))).alias("hits"))

    # each query that shares the vector leaves out one row: its own
    answered = asked.join(queries, "v").join(answers, "q").select("query_id", "hits")
    own = F.array_position(F.transform("hits", lambda h: h["vec_id"]), F.col("query_id"))
    others_only = F.filter("hits", lambda h, i: i != F.col("own") - 1)
    return (
        answered.withColumn("own", own)
        .select("query_id", F.posexplode(F.slice(others_only, 1, k)).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.sqrt("hit.d").alias("score"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
