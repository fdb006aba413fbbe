"""Site graphs: shared media, related sites, groups, communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumasift.operators.components import connected_components
from lumasift.operators.decision import rank_of
from lumasift.scratch import saved


#: Sites of a block and rows that a block aims at; a task holds two blocks. Sites of the first block that are counted at a time,
#: and meetings that are counted at once.
MEDIA_BLOCK, BLOCK_ROWS, STRIP, MEETINGS = 4_096, 1 << 20, 256, 1 << 21
#: Rows from which there are enough pairs of blocks for many tasks. Blocks of sites that a block of few touched sites takes, and most tasks.
MANY_ROWS, MANY_BLOCKS, WIDE, MOST_TASKS = 50_000, 8, 4, 4_096


def _packed(own: DataFrame, touched: DataFrame | None, block: int) -> tuple[DataFrame, int, int]:
    """Blocks of sites of ``own`` (a, m, side), how many there are, and how many of them hold the touched sites (all, if None).

    A block is a row: its sites, the media of each on each side, and entries (site's place, medium, side) in order of media.
    """
    own = own.filter(F.col("a").isNotNull())
    if own.schema["m"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        placed = own.withColumn("m", F.col("m").cast("long"))
    else:
        names = own.filter(F.col("m").isNotNull()).groupBy("m").agg(F.count("*").alias("n")).filter("n > 1")
        names = saved(names.select("m", F.monotonically_increasing_id().alias("id")), "media-names")
        placed = own.join(names, "m", "left").select("a", F.col("id").alias("m"), "side")
    if touched is None:
        placed = placed.withColumn("lead", F.lit(True))
    else:
        placed = placed.join(touched.select("a", F.lit(True).alias("lead")).distinct(), "a", "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
    sizes = {r["lead"]: r for r in placed.groupBy("lead", "a").agg(F.count("*").alias("n")).groupBy("lead").agg(F.count("*").alias("sites"), F.sum("n").alias("rows")).collect()}

    def blocks_of(lead: bool) -> int:
        if lead not in sizes:
            return 0
        sites, rows = sizes[lead]["sites"], sizes[lead]["rows"]
        return max(-(-sites // block), -(-rows // BLOCK_ROWS), MANY_BLOCKS if rows >= MANY_ROWS else 1)

    first, rest = blocks_of(True), blocks_of(False)
    if rest and first and sizes[True]["rows"] < sizes[False]["rows"]:
        # all rows are sent to each block of touched sites: as few of these as memory allows, tasks come from the other blocks
        first = max(-(-sizes[True]["sites"] // (WIDE * block)), -(-sizes[True]["rows"] // BLOCK_ROWS))
    dealt = F.when(F.col("lead"), F.pmod(F.xxhash64("a"), F.lit(max(first, 1)))).otherwise(F.pmod(F.xxhash64("a"), F.lit(max(rest, 1))) + first).cast("int")
    kind = own.schema["a"].dataType.simpleString()

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        coded = rows.column("a").combine_chunks().dictionary_encode()
        at, side = coded.indices.to_numpy(), rows.column("side").to_numpy()
        n = [np.bincount(at[side == s], minlength=len(coded.dictionary)) for s in (0, 1)]
        known = pc.is_valid(rows.column("m")).to_numpy()
        m = pc.fill_null(rows.column("m"), 0).to_numpy()
        order = np.flatnonzero(known)[np.argsort(m[known], kind="stable")]
        columns = (coded.dictionary, pa.array(n[0]), pa.array(n[1]), pa.array(at[order].astype(np.int32)), pa.array(m[order]), pa.array(side[order]))
        whole = [pa.LargeListArray.from_arrays(pa.array([0, len(c)], pa.int64()), c).cast(pa.list_(c.type)) for c in columns]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *whole], names=["block", "sites", "n0", "n1", "at", "m", "side"])

    schema = f"block int, sites array<{kind}>, n0 array<bigint>, n1 array<bigint>, at array<int>, m array<bigint>, side array<tinyint>"
    packed = placed.withColumn("block", dealt).select("block", "a", "m", F.col("side").cast("tinyint").alias("side")).groupBy("block").applyInArrow(pack, schema)
    return saved(packed, "media-blocks"), first + rest, first


def _met(at: np.ndarray, m: np.ndarray, at2: np.ndarray, m2: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """How often places ``at`` and ``at2`` meet in a medium, as a flat table of ``rows`` by ``columns``; ``m2`` ascends."""
    start = np.searchsorted(m2, m, "left")
    times = np.searchsorted(m2, m, "right") - start
    ends = np.cumsum(times)
    counts = np.zeros(rows * columns, np.int64)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MEETINGS, "right")))
        t, base = times[lo:hi], start[lo:hi] - (ends[lo:hi] - times[lo:hi])
        there = np.repeat(base, t) + np.arange(ends[lo - 1] if lo else 0, ends[hi - 1])
        counts += np.bincount(np.repeat(at[lo:hi].astype(np.int64) * columns, t) + at2[there], minlength=rows * columns)
        lo = hi
    return counts


def _products(packed: DataFrame, blocks: int, first: int, sides: int) -> DataFrame:
    """a, b, shared (and shared of side 1, shared1) and weight (of side 0) of sites that share media on any side.

    Every pair of blocks whose first one is among the ``first`` is a group of
    its own.  Its pairs are counted in a table of their places, a strip of sites
    after the other, so no pair and no meeting is ever shuffled.
    """
    kind = packed.schema["sites"].dataType.elementType.simpleString()
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.least("block", k).cast("long") * blocks + F.greatest("block", k))
    dealt = packed.withColumn("cell", F.explode(F.filter(cells, lambda c: c < F.lit(first * blocks))))

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {r["block"]: r for b in batches for r in _blocks(b)}
        lo, hi = divmod(key[0].as_py(), blocks)
        if lo not in found or hi not in found:  # no site was dealt to a block
            return
        x, y = found[lo], found[hi]
        rows, columns = len(x["sites"]), len(y["sites"])
        split = [[(r["at"][r["side"] == s], r["m"][r["side"] == s]) for s in range(sides)] for r in (x, y)]
        for low in range(0, rows, STRIP):
            high = min(low + STRIP, rows)
            met = []
            for s in range(sides):
                at, m = split[0][s]
                mine = (at >= low) & (at < high)
                met.append(_met(at[mine] - low, m[mine], *split[1][s], high - low, columns))
            where = np.flatnonzero(met[0] if sides == 1 else met[0] | met[1])
            i, j = where // columns + low, where % columns
            if x["block"] == y["block"]:
                once = i < j
                where, i, j = where[once], i[once], j[once]
            shared = met[0][where]
            union = x["n0"][i] + y["n0"][j] - shared
            weight = np.divide(shared, union, out=np.zeros(len(where)), where=union > 0)
            yield pa.RecordBatch.from_arrays([x["sites"].take(pa.array(i)), y["sites"].take(pa.array(j)), pa.array(shared), pa.array(met[-1][where]), pa.array(weight)], names=["a", "b", "shared", "shared1", "weight"])

    # cells are short but cost much, so their number is given
    tasks = max(1, min(MOST_TASKS, first * (2 * blocks - first + 1)))
    made = dealt.repartition(tasks, "cell").groupBy("cell").applyInArrow(count, f"a {kind}, b {kind}, shared bigint, shared1 bigint, weight double")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "shared1", "weight")


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    """Blocks of a batch as arrays."""
    for k in range(batch.num_rows):
        flat = lambda name: batch.column(name).slice(k, 1).flatten()  # noqa: B023, E731
        yield {"block": batch.column("block")[k].as_py(), "sites": flat("sites")} | {name: flat(name).to_numpy() for name in ("n0", "n1", "at", "m", "side")}


def shared_media(rows: DataFrame, site: str = "site", media: str = "media", block: int = MEDIA_BLOCK) -> DataFrame:
    """a < b, shared, weight: Jaccard of the media of two sites that share any.

    Sites are dealt to blocks, and each pair of blocks is a key of its own: what
    is shuffled is the rows, once for each block, and never the pairs.
    """
    own = rows.select(F.col(site).alias("a"), F.col(media).alias("m")).distinct().withColumn("side", F.lit(0))
    packed, blocks, first = _packed(saved(own, "media-own"), None, block)
    return _products(packed, blocks, first, 1).select("a", "b", "shared", "weight")


def shared_media_of(rows: DataFrame, touched: DataFrame, site: str = "site", media: str = "media", block: int = MEDIA_BLOCK) -> DataFrame:
    """As shared_media, only pairs with a touched site (column site): their blocks meet all, others don't meet."""
    own = rows.select(F.col(site).alias("a"), F.col(media).alias("m")).distinct().withColumn("side", F.lit(0))
    packed, blocks, first = _packed(saved(own, "media-own"), touched.select(F.col("site").alias("a")), block)
    return _products(packed, blocks, first, 1).select("a", "b", "shared", "weight")


def media_changes(old: DataFrame, new: DataFrame, site: str = "site", media: str = "media", block: int = MEDIA_BLOCK) -> DataFrame:
    """As edge_changes of the shared media of two tables, whose pairs are counted side by side."""
    own = [rows.select(F.col(site).alias("a"), F.col(media).alias("m")).distinct().withColumn("side", F.lit(side)) for side, rows in enumerate((new, old))]
    packed, blocks, first = _packed(saved(own[0].unionByName(own[1]), "media-own"), None, block)
    pairs = _products(packed, blocks, first, 2).filter((F.col("shared") == 0) | (F.col("shared1") == 0))
    return pairs.select("a", "b", F.when(F.col("shared1") == 0, "new").otherwise("stale").alias("change"))


def twins(rows: DataFrame, *tags: Column, site: str = "site", media: str = "media") -> tuple[DataFrame, DataFrame]:
    """Rows (a, m) of sites, and the sites (node, twin, n, shared, blank, tag0...) with the smallest one of those whose media (and ``tags``, of the column a) are equal."""
    own = saved(rows.select(F.col(site).alias("a"), F.col(media).alias("m")).filter(F.col("a").isNotNull()).distinct(), "twins-own")
    keys = ["set", "blank", *(f"tag{k}" for k in range(len(tags)))]
    sets = own.groupBy("a").agg(F.array_sort(F.collect_set("m")).alias("set"), F.max(F.col("m").isNull()).alias("blank")).withColumns({f"tag{k}": tag for k, tag in enumerate(tags)})
    sets = saved(sets, "twins-sets")
    nodes = sets.groupBy(*keys).agg(F.min("a").alias("twin"), F.count("*").alias("n"))
    return own, saved(sets.join(nodes, keys).select(F.col("a").alias("node"), "twin", "n", F.size("set").alias("shared"), *keys[1:]), "twins")


def pairs_of_twins(own: DataFrame, members: DataFrame, block: int = MEDIA_BLOCK) -> DataFrame:
    """Edges (a, b, shared, weight, pairs) of the nodes of twins()."""
    nodes = members.filter(F.col("node") == F.col("twin"))
    several = saved(nodes.filter("n > 1").select("twin", "n", "shared", "blank"), "twins-several")
    pairs = shared_media(own.join(nodes.select(F.col("twin").alias("a")), "a", "left_semi"), "a", "m", block)
    for x in ("a", "b"):
        pairs = pairs.join(several.select(F.col("twin").alias(x), F.col("n").alias(f"n_{x}")), x, "left").na.fill(1, [f"n_{x}"])
    pairs = pairs.select("a", "b", "shared", "weight", (F.col("n_a") * F.col("n_b")).alias("pairs"))
    k = F.col("shared").cast("long")
    union = k + 2 * F.col("blank").cast("int")
    loops = several.filter("shared > 0").select(F.col("twin").alias("a"), F.col("twin").alias("b"), k.alias("shared"), (k / union).alias("weight"), F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return pairs.unionByName(loops)


def twin_edges(rows: DataFrame, *tags: Column, site: str = "site", media: str = "media", block: int = MEDIA_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Sites whose media (and ``tags``, of the column a) are equal, as one node: members (node, twin) and edges (a, b, shared, weight, pairs).

    A node is named by its smallest site.  Its sites have equal weights to all
    others, so an edge stands for ``pairs`` edges of sites, and a loop for
    those among its own; what is written grows with the square of unlike sites alone.
    """
    own, members = twins(rows, *tags, site=site, media=media)
    return members.select("node", "twin"), pairs_of_twins(own, members, block)


def of_twins(members: DataFrame, found: DataFrame) -> DataFrame:
    """(node, community) of all sites of nodes that have one."""
    return members.join(found.withColumnRenamed("node", "twin"), "twin").select("node", "community")


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (a, b) that are new or stale."""
    fresh = new.join(old, ["a", "b"], "left_anti").select("a", "b", F.lit("new").alias("change"))
    return fresh.unionByName(old.join(new, ["a", "b"], "left_anti").select("a", "b", F.lit("stale").alias("change")))


def related(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, site, via, weight of what each start reaches in at most ``depth`` hops.

    ``edges``: a, b, kind, weight, undirected.  Kinds and weights also count
    edges that lead back to sites seen before, but never to the start.
    """
    both = edges.select("a", "b", "kind", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", "weight"))
    frontier = starts.select(F.col("site").alias("start"), F.col("site").alias("at")).distinct()
    seen = frontier
    touched = None
    for level in range(depth):
        step = frontier.join(both, F.col("at") == F.col("a")).filter(F.col("b") != F.col("start")).select("start", F.col("b").alias("site"), "kind", "weight")
        step = saved(step.groupBy("start", "site", "kind").agg(F.max("weight").alias("weight")), f"related-{level}")
        touched = step if touched is None else touched.unionByName(step)
        frontier = step.select("start", F.col("site").alias("at")).distinct().join(seen, ["start", "at"], "left_anti")
        frontier = saved(frontier, f"frontier-{level}")
        seen = seen.unionByName(frontier)
    return touched.groupBy("start", "site").agg(F.array_sort(F.collect_set("kind")).alias("via"), F.max("weight").alias("weight"))


def gangs(edges: DataFrame, use_mirror: bool = False) -> DataFrame:
    """(node, component) over edges (a, b, kind); mirror edges only on request."""
    return connected_components(edges if use_mirror else edges.filter(F.col("kind") != "mirror_near"))


def fingerprint_edges(members: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of groups (name, sha) whose sets overlap by at least ``least``: an equi-join, as sharing is needed."""
    return shared_media(members, "name", "sha").filter(F.col("weight") >= least)


def merge_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups (name, size, urls, agg4, verdict) merged along edges (a, b); the lead is the largest, then of most urls, then the first by name."""
    labels = connected_components(edges).withColumnRenamed("node", "name")
    placed = groups.join(labels, "name", "left").withColumn("component", F.coalesce("component", "name"))
    return placed.groupBy("component").agg(
        F.count("*").alias("groups"),
        F.sum("size").alias("size"),
        F.max("agg4").alias("agg4"),
        F.max_by("verdict", rank_of(F.col("verdict"))).alias("verdict"),
        F.min(F.struct((-F.col("size")).alias("s"), (-F.col("urls")).alias("u"), "name"))["name"].alias("lead"),
        F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"),
    )


def site_rows(edges: DataFrame) -> DataFrame:
    """source, target, kind, weight of the edges (src, dst, kind, weight) between nodes that are sites."""
    bare = lambda c: F.substring(c, 6, 1 << 30)
    return edges.filter(F.col("src").startswith("site:") & F.col("dst").startswith("site:")).select(bare("src").alias("source"), bare("dst").alias("target"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def merge_reason(same_site: Column, overlap: Column, image_kinds: Column, template: Column, least: float = 0.3) -> Column:
    """Why two groups should merge: the first rule that holds, else null."""
    return F.when(same_site, "same_site").when(overlap >= least, "overlap").when(image_kinds > 0, "shared_image").when(template > 0, "template")


def modularity(edges: DataFrame, parts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of parts (node, community) over edges (a, b, weight)."""
    of = lambda x: parts.select(F.col("node").alias(x), F.col("community").alias(f"c_{x}"))
    placed = edges.join(of("a"), "a").join(of("b"), "b")
    inner = placed.groupBy(F.col("c_a").alias("community")).agg(F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = placed.select(F.explode(F.array(F.struct(F.col("c_a").alias("community"), "weight"), F.struct(F.col("c_b").alias("community"), "weight"))).alias("e")).select("e.*")
    degree = ends.groupBy("community").agg(F.sum("weight").alias("degree"))
    m = edges.agg(F.sum("weight").alias("m"))
    part = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.lit(resolution) * F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return degree.join(inner, "community", "left").crossJoin(F.broadcast(m)).agg(F.sum(part).alias("modularity"), F.count("*").alias("communities"))


# -- communities ----------------------------------------------------------------------------------

#: Edges of a connected component up to which one task computes it; larger ones take distributed rounds.
EXACT_EDGES = 1_000_000
#: Most sweeps and levels, and the gain in modularity below which a sweep is the last.
MAX_SWEEPS, MAX_LEVELS, LEAST_GAIN = 100, 32, 1e-7


def _sweeps(links: dict, loops: dict, two_m: float, resolution: float) -> dict:
    """Community of each node: nodes move in id order to the neighbouring community of strictly best gain, the smallest on ties."""
    degree = {n: sum(near.values()) + 2 * loops.get(n, 0.0) for n, near in links.items()}
    label, weight_of = {n: n for n in links}, dict(degree)
    for _ in range(MAX_SWEEPS):
        moves, gained = 0, 0.0
        for n in sorted(links):
            home, pull = label[n], {}
            for other, w in links[n].items():
                pull[label[other]] = pull.get(label[other], 0.0) + w
            weight_of[home] -= degree[n]
            rate = resolution * degree[n] / two_m
            score = {c: w - rate * weight_of[c] for c, w in pull.items()}
            stay = score.get(home, -rate * weight_of[home])
            top = max((v for c, v in score.items() if c != home), default=stay)
            if top > stay:
                label[n] = min(c for c, v in score.items() if v == top and c != home)
                moves, gained = moves + 1, gained + 2 * (top - stay) / two_m
            weight_of[label[n]] += degree[n]
        if not moves or gained < LEAST_GAIN:
            break
    return label


def communities_of(edges: list[tuple], two_m: float, resolution: float) -> dict:
    """Node -> the smallest node of its community, after as many levels of folded graphs as change anything.

    ``edges``: (a, b, weight), each pair once.  ``two_m``: twice the weight of
    the whole graph, of which these edges may be a part.
    """
    links: dict = {}
    loops: dict = {}
    for a, b, w in edges:
        links.setdefault(a, {}), links.setdefault(b, {})
        if a == b:
            loops[a] = loops.get(a, 0.0) + w
        else:
            links[a][b] = links[a].get(b, 0.0) + w
            links[b][a] = links[b].get(a, 0.0) + w
    home = {n: n for n in links}
    for _ in range(MAX_LEVELS if two_m > 0 else 0):
        label = _sweeps(links, loops, two_m, resolution)
        least: dict = {}
        for n, c in label.items():
            least[c] = min(least.get(c, n), n)
        label = {n: least[c] for n, c in label.items()}
        home = {n: label[c] for n, c in home.items()}
        if len(least) in (1, len(links)):
            break
        folded: dict = {c: {} for c in least.values()}
        inner: dict = {}
        for n, near in links.items():
            for other, w in near.items():
                if label[n] != label[other]:
                    folded[label[n]][label[other]] = folded[label[n]].get(label[other], 0.0) + w
                elif n < other:
                    inner[label[n]] = inner.get(label[n], 0.0) + w
        for n, w in loops.items():
            inner[label[n]] = inner.get(label[n], 0.0) + w
        links, loops = folded, inner
    return home


def local_moves(edges: DataFrame, two_m: float, resolution: float, rounds: int) -> DataFrame:
    """(node, label) of one level in rounds of joins; ``edges``: a, b, weight, each pair once, loops allowed.

    A round sums each node's weight by neighbouring community and takes the best
    one.  Only half of the nodes, by a hash that changes with the round, may
    move, and only to a community of a smaller label on even rounds and of a
    larger one on odd ones, so two nodes don't swap places.  Gains count
    communities as they stood before the round.
    """
    flat = edges.filter(F.col("a") != F.col("b"))
    both = saved(flat.select("a", "b", "weight").unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "moves-both")
    ends = both.select(F.col("a").alias("node"), "weight").unionByName(edges.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node"), (2 * F.col("weight")).alias("weight")))
    state = saved(ends.groupBy("node").agg(F.sum("weight").alias("degree")).withColumn("label", F.col("node")), "moves-0")
    idle = 0
    for k in range(1, rounds + 1):
        totals = state.groupBy("label").agg(F.sum("degree").alias("total"))
        pull = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("pull"))
        home = state.select("node", "degree", F.col("label").alias("home"))
        turn = F.pmod(F.xxhash64(F.col("node"), F.lit(k // 2)), F.lit(2)) == k % 2
        own = F.col("label") == F.col("home")
        score = F.col("pull") - F.lit(resolution / two_m) * F.col("degree") * (F.col("total") - F.when(own, F.col("degree")).otherwise(0.0))
        rated = home.join(pull, "node").join(totals, "label").withColumn("score", score)
        way = (F.col("label") < F.col("home")) if k % 2 == 0 else (F.col("label") > F.col("home"))
        best = rated.groupBy("node").agg(
            F.max(F.when(~own & way, F.col("score"))).alias("top"),
            F.min_by("label", F.when(~own & way, -F.col("score"))).alias("to"),
            F.max(F.when(own, F.col("score"))).alias("stay_linked"),
        )
        alone = home.join(totals, F.col("home") == F.col("label")).select("node", (F.lit(-resolution / two_m) * F.col("degree") * (F.col("total") - F.col("degree"))).alias("stay_alone"))
        stay = F.coalesce("stay_linked", "stay_alone")
        moving = turn & F.coalesce(F.col("top") > stay + F.lit(1e-12), F.lit(False))
        moved = state.join(best, "node", "left").join(alone, "node").select("node", "degree", F.when(moving, F.col("to")).otherwise(F.col("label")).alias("label"), F.when(moving, 2 * (F.col("top") - stay) / F.lit(two_m)).alias("gain"))
        moved = saved(moved, f"moves-{k}")
        gained = moved.agg(F.sum("gain")).first()[0] or 0.0
        state = moved.drop("gain")
        idle = idle + 1 if gained < LEAST_GAIN else 0
        if idle >= 6:  # halves and ways have changed
            break
    return state.select("node", "label")


def louvain(edges: DataFrame, resolution: float = 1.0, exact_edges: int = EXACT_EDGES, rounds: int = 40, two_m: float | None = None) -> DataFrame:
    """(node, community): communities of greatest modularity, named by their smallest node.

    ``edges``: a, b, weight, undirected.  Connected components of at most
    ``exact_edges`` edges are computed by sequential sweeps and levels, many to
    a task.  Larger ones take distributed rounds (local_moves) and are folded,
    level by level, until they are small enough or nothing merges; their
    communities can differ from those of sequential sweeps.  ``two_m``: as in communities_of().
    """
    kind = edges.schema["a"].dataType.simpleString()
    given = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight"))
    now = saved(given.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "louvain-edges")
    if two_m is None:
        two_m = 2 * (now.agg(F.sum("weight")).first()[0] or 0.0)
    folds: list[DataFrame] = []
    done = []

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        found = communities_of(list(zip(pdf["a"], pdf["b"], pdf["weight"])), two_m, resolution)
        return pd.DataFrame(sorted(found.items()), columns=["node", "community"])

    for level in range(MAX_LEVELS):
        placed = now.join(connected_components(now).withColumnRenamed("node", "a"), "a")
        sizes = saved(placed.groupBy("component").agg(F.count("*").alias("n")), "louvain-sizes")
        large = sizes.filter(F.col("n") > exact_edges).select("component")
        some = large.take(1)
        small = placed.join(large, "component", "left_anti") if some else placed
        exact = saved(small.groupBy("component").applyInPandas(apply, f"node {kind}, community {kind}"), "louvain-exact")
        for fold in reversed(folds):
            exact = fold.join(exact.withColumnsRenamed({"node": "label"}), "label").select("node", "community")
        done.append(exact)
        if not some:
            break
        big = saved(placed.join(large, "component", "left_semi").drop("component"), "louvain-large")
        label = local_moves(big, two_m, resolution, rounds)
        least = label.groupBy("label").agg(F.min("node").alias("least"))
        fold = saved(label.join(least, "label").select("node", F.col("least").alias("label")), f"louvain-fold-{level}")
        folds.append(fold)
        before, after = fold.count(), fold.select("label").distinct().count()
        ends = [fold.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}")) for x in ("a", "b")]
        folded = big.join(ends[0], "a").join(ends[1], "b").groupBy(F.least("l_a", "l_b").alias("a"), F.greatest("l_a", "l_b").alias("b")).agg(F.sum("weight").alias("weight"))
        now = saved(folded, f"louvain-{level}")
        if after == before or level + 1 == MAX_LEVELS:
            rest = now.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node"))
            for fold in reversed(folds):
                rest = fold.join(rest.withColumnsRenamed({"node": "label"}), "label").select("node", "community")
            done.append(rest)
            break
    made = done[0]
    for more in done[1:]:
        made = made.unionByName(more)
    return made


def gang_edges(edges: DataFrame, template: float = 1.0, mirror: float = 0.5) -> DataFrame:
    """Weights for community mode: edges (a, b, kind, weight), template and mirror kinds scaled, kinds of a pair summed."""
    factor = F.when(F.col("kind").isin("shared_template", "template"), template).when(F.col("kind") == "mirror_near", mirror).otherwise(1.0)
    pairs = [F.max("pairs").alias("pairs")] if "pairs" in edges.columns else []
    return edges.groupBy("a", "b").agg(F.sum(F.col("weight") * factor).alias("weight"), *pairs)


def gangs_by_community(edges: DataFrame, least: float = 0.0, template: float = 1.0, mirror: float = 0.5, resolution: float = 1.0) -> DataFrame:
    """(node, community) of edges (a, b, kind, weight) whose scaled weight is at least ``least``.

    With a column ``pairs`` an edge stands for so many of this weight, as twin_edges() gives them.
    """
    kept = gang_edges(edges, template, mirror).filter(F.col("weight") >= least)
    if "pairs" in kept.columns:
        kept = kept.withColumn("weight", F.col("weight") * F.col("pairs"))
    return louvain(kept, resolution)


def owner_edges(members: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (a, b) between groups that own linked hosts.

    ``members``: name, host, ord.  A host belongs to the group that named it
    first.  ``links``: a, b (hosts).  Hosts without an owner, and links inside
    a group, give nothing.
    """
    owner = members.groupBy("host").agg(F.min_by("name", F.struct("ord", "name")).alias("name"))
    of = lambda x: owner.select(F.col("host").alias(x), F.col("name").alias(f"of_{x}"))
    met = links.join(of("a"), "a").join(of("b"), "b").filter(F.col("of_a") != F.col("of_b"))
    return met.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()


def union_edges(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """Edges (a, b, kinds) of several kinds, each pair once."""
    made = None
    for kind, edges in kinds:
        part = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(kind).alias("kind"))
        made = part if made is None else made.unionByName(part)
    return made.groupBy("a", "b").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, kind, n: nodes and edges by kind, and totals (kind null)."""
    # counted once before the totals, so a row is not made twice
    part = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).rollup("kind").agg(F.sum("n").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return part(nodes, "node").unionByName(part(edges, "edge"))


def redirect_chain(hops: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """start, last, n: where starts (url) lead along hops (src, dst), one hop a join, no url twice."""
    at = starts.select(F.col("url").alias("start"), F.col("url").alias("last"), F.lit(0).alias("n"), F.array("url").alias("seen"))
    for _ in range(most):
        moved = at.join(hops, F.col("last") == F.col("src"), "left")
        go = F.col("dst").isNotNull() & ~F.array_contains("seen", F.col("dst"))
        at = moved.select("start", F.when(go, F.col("dst")).otherwise(F.col("last")).alias("last"), (F.col("n") + F.when(go, 1).otherwise(0)).alias("n"), F.when(go, F.array_append("seen", F.col("dst"))).otherwise(F.col("seen")).alias("seen"))
    return at.select("start", "last", "n")


def crawl(links: DataFrame, starts: DataFrame, depth: int, most: int) -> DataFrame:
    """start, url, level: breadth first along links (src, dst), each url once, at most ``most`` urls a start.

    One join a level; urls seen before are left out by an anti join.
    """
    level = starts.select(F.col("url").alias("start"), "url", F.lit(0).alias("level")).distinct()
    seen = level
    for k in range(1, depth + 1):
        reached = level.join(links, F.col("url") == F.col("src")).select("start", F.col("dst").alias("url")).distinct()
        level = saved(reached.join(seen.select("start", "url"), ["start", "url"], "left_anti").withColumn("level", F.lit(k)), f"crawl-{k}")
        seen = seen.unionByName(level)
    place = F.row_number().over(Window.partitionBy("start").orderBy("level", "url"))
    return seen.withColumn("place", place).filter(F.col("place") <= most).drop("place")
