"""Merkle manifest of a dataset: superblock reduction, and proofs of all rows.

A row's leaf is the digest of its columns.  The leaves of a source, in order of
their ids, are a tree: every ``fanout`` consecutive nodes become their digest
until one is left, the subroot; subroots in order of their sources are a tree
of the same kind, whose last node is the root of the dataset.

Reduction: a node's bucket is its index divided by fanout^k.  One pass of
``applyInPandas`` collapses k levels of every bucket, bucket roots are the next
level, and so on; a level has 1 / fanout^k of the rows of the one below.  Way
down: a bucket's own levels give the siblings of its nodes (lower proof), the
root of the bucket has its proof already (upper proof), and a node's proof is
both in a row.  Only bucket roots are written, never the proofs of rows.

Indices come from range partitions and counts, so a source with a third of all
rows is many tasks; a pandas call takes some ``CELL_ROWS`` nodes, whole buckets
of any sources.

Defined results: a null column is ``-``, any other value its byte count, a
colon and its text, so that no two rows share an encoding; null ids come first
(and are never tampered with by the query), rows that repeat an id are leaves of
their own in order of their digests; a null source comes first; a source of one
row has that leaf as subroot; empty and very long texts are values like others;
columns that aren't named play no part; an empty table has no proofs and, as
root, the digest of nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumasift.llm.common import saved, table

#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run, and levels that one pass collapses.
FANOUT, LEVELS = 16, 2
#: Nodes that one pandas call takes, about.
CELL_ROWS = 1024


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values: Column) -> Column:
    """Digest of values in a row, each ``-`` if null, else its byte count, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof from below, those of a run from left to right."""
    return F.concat_ws("", F.flatten(F.transform(proof, lambda run: F.array(run["left"], run["right"]))))


# ------------------------------------------------------------------ indices


def _numbered(items: DataFrame, tree: str, order: Sequence[str], label: str) -> DataFrame:
    """``items`` with i (from 0 in its tree, in order) and n (nodes of its tree)."""
    by = [F.col(c).asc_nulls_first() for c in (tree, *order, "nth")]
    ranged = items.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = saved(ranged.drop("nth").withColumn("place", F.monotonically_increasing_id()), f"{label}-ranged")
    # a row for each tree in each range partition
    runs = ranged.groupBy(F.col(tree).alias("of"), F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    whole = Window.partitionBy("of")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("of", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    met = ranged.join(runs, F.col(tree).eqNullSafe(F.col("of")) & (F.shiftright("place", 33) == F.col("part")))
    return met.withColumn("i", F.col("place") + F.col("shift")).drop("of", "part", "place", "shift")


# ------------------------------------------------------------------ buckets


def _height(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _rows_up(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """Nodes of a bucket, and those of the ``levels`` levels above them."""
    rows = [nodes]
    for _ in range(levels):
        rows.append([digest("".join(rows[-1][at : at + fanout])) for at in range(0, len(rows[-1]), fanout)])
    return rows


def _buckets(trees, indices, counts, digests, fanout: int, k: int) -> Iterator[tuple[tuple, int, list[int], list[list[str]]]]:
    """(tree and bucket, nodes of the tree, positions of the bucket's nodes in order, its levels)."""
    width, found = fanout**k, defaultdict(list)
    for at, (tree, i) in enumerate(zip(trees, indices)):
        found[tree, i // width].append((i, at))
    for key, own in found.items():
        own = [at for _, at in sorted(own)]
        n = int(counts[own[0]])
        yield key, n, own, _rows_up([digests[at] for at in own], fanout, min(k, _height(n, fanout)))


def _cell(tree: str, bucket: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.col(tree), bucket.cast("long")), F.lit(cells)).alias("cell")


def _cells(level: DataFrame) -> int:
    return max(1, -(-level.count() // CELL_ROWS))


def _collapsed(level: DataFrame, tree: str, cells: int, fanout: int, k: int) -> DataFrame:
    """Bucket roots of a level (tree, i, n, digest): the level k steps above it."""
    kind = level.schema[tree].dataType

    def collapse(nodes: pd.DataFrame) -> pd.DataFrame:
        trees = [None if pd.isna(t) else t for t in nodes[tree]]
        rows = [(key[0], key[1], -(-n // fanout**k), up[-1][0]) for key, n, _, up in _buckets(trees, nodes["i"].tolist(), nodes["n"].tolist(), nodes["digest"].tolist(), fanout, k)]
        return pd.DataFrame(rows, columns=[tree, "i", "n", "digest"])

    schema = T.StructType([T.StructField(tree, kind), T.StructField("i", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])
    placed = level.select(tree, "i", "n", "digest", _cell(tree, F.floor(F.col("i") / F.lit(fanout**k)), cells))
    return placed.groupBy("cell").applyInPandas(collapse, schema)


def _levels(leaves: DataFrame, tree: str, fanout: int, k: int, label: str) -> list[tuple[DataFrame, int]]:
    """Tables (tree, i, n, digest, ...) from ``leaves`` to the one with a node a tree, each with its number of cells."""
    levels = [(leaves, _cells(leaves))]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        level, cells = levels[-1]
        up = saved(_collapsed(level, tree, cells, fanout, k), f"{label}-{len(levels)}")
        levels.append((up, _cells(up)))
        largest = -(-largest // fanout**k)
    return levels


_PROOF = "left array<string>, right array<string>, subroot string"


def _down(level: DataFrame, cells: int, upper: DataFrame, tree: str, fanout: int, k: int) -> DataFrame:
    """``level`` with left, right and subroot, from those of its bucket roots (``upper``, by tree and i)."""
    kept = [f for f in level.schema.fields if f.name != "subroot"]
    schema = T.StructType(kept + T._parse_datatype_string(_PROOF).fields)
    names = [f.name for f in kept]

    def proofs(nodes: pa.Table, roots: pa.Table) -> pa.Table:
        above = dict(zip(zip(roots["tree"].to_pylist(), roots["i"].to_pylist()), zip(roots["left"].to_pylist(), roots["right"].to_pylist(), roots["subroot"].to_pylist())))
        lefts, rights, subroots = ([None] * len(nodes) for _ in range(3))
        for key, _, own, up in _buckets(*(nodes[c].to_pylist() for c in (tree, "i", "n", "digest")), fanout, k):
            upper_left, upper_right, subroot = above[key]
            sides: list[dict] = []
            for row in up[:-1]:
                starts = [(q, q // fanout * fanout) for q in range(len(row))]
                sides.append({q: ("".join(row[s:q]), "".join(row[q + 1 : s + fanout])) for q, s in starts})
            for p, at in enumerate(own):
                lower = [side[p // fanout**t] for t, side in enumerate(sides)]
                lefts[at] = [a for a, _ in lower] + upper_left
                rights[at] = [b for _, b in lower] + upper_right
                subroots[at] = subroot
        texts = pa.list_(pa.string())
        return pa.Table.from_arrays([*(nodes[c] for c in names), pa.array(lefts, texts), pa.array(rights, texts), pa.array(subroots, pa.string())], names=[*names, "left", "right", "subroot"])

    below = level.select(*names, _cell(tree, F.floor(F.col("i") / F.lit(fanout**k)), cells))
    over = upper.select(F.col(tree).alias("tree"), "i", "left", "right", "subroot", _cell(tree, F.col("i"), cells))
    return below.groupBy("cell").cogroup(over.groupBy("cell")).applyInArrow(proofs, schema)


def _proven(levels: list[tuple[DataFrame, int]], upper: DataFrame, tree: str, fanout: int, k: int, label: str) -> DataFrame:
    """Proofs of the first level's nodes; ``upper`` has those of the last level's."""
    for nth in range(len(levels) - 2, -1, -1):
        upper = _down(*levels[nth], upper, tree, fanout, k)
        if nth:
            upper = saved(upper, f"{label}-proofs-{nth}")
    return upper


# ------------------------------------------------------------------ manifest


@dataclass(frozen=True)
class Manifest:
    root: str
    #: source, subroot
    subroots: DataFrame
    #: Carried columns, source, leaf, subroot and proof: an array of (left, right), from below.
    proofs: DataFrame


def build(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "source", carry: Mapping[str, Column] | None = None, fanout: int = FANOUT, k: int = LEVELS) -> Manifest:
    """The manifest of ``docs``; its proofs carry ``key`` and the columns of ``carry``."""
    carry = {"key": F.col(key)} | dict(carry or {})
    leaves = docs.select(*[c.alias(f"own_{name}") for name, c in carry.items()], F.col(group).cast("string").alias("group"), leaf_of(*[F.col(c) for c in columns]).alias("digest"))
    leaves = saved(leaves, "merkle-leaves")
    nodes = saved(_numbered(leaves, "group", ["own_key", "digest"], "merkle"), "merkle-0")
    levels = _levels(nodes, "group", fanout, k, "merkle")
    # every tree has one node now; these are leaves of one more tree
    subroots = levels[-1][0].select("group", F.col("digest").alias("subroot"), "digest")
    tops = saved(_numbered(subroots.withColumn("tree", F.lit(0)), "tree", ["group"], "merkle-top"), "merkle-top-0")
    top_levels = _levels(tops, "tree", fanout, k, "merkle-top")
    last = top_levels[-1][0].first()
    nothing = F.array().cast("array<string>")
    upper = top_levels[-1][0].withColumns({"left": nothing, "right": nothing, "subroot": F.col("digest")})
    upper = _proven(top_levels, upper, "tree", fanout, k, "merkle-top")
    # the subroot is the source's own node: its proof is above all of that source's proofs
    upper = saved(upper.select("group", F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("n"), "digest", "left", "right", F.col("digest").alias("subroot")), "merkle-subroots")
    if len(levels) == 1:
        found = nodes.join(upper.select(F.col("group").alias("of"), "left", "right", "subroot"), F.col("group").eqNullSafe(F.col("of")))
    else:
        found = _proven(levels, upper, "group", fanout, k, "merkle")
    proofs = found.select(
        F.col("own_key").alias(key),
        *[F.col(f"own_{name}").alias(name) for name in carry if name != "key"],
        F.col("group").alias(group),
        F.col("digest").alias("leaf"),
        "subroot",
        F.arrays_zip("left", "right").alias("proof"),
    )
    return Manifest(last["digest"] if last else digest(""), upper.select(F.col("group").alias(group), "subroot"), proofs)


#: The query tampers with every row whose id's crc32 it divides.
TAMPER = 5


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(picked, leaf_of(*[lowered if c == "text" else F.col(c) for c in COLUMNS]))
    found = build(docs, carry={"tampered": tampered})
    return (
        found.proofs.withColumn("root", F.lit(found.root))
        .withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
        .select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    )


def _oracle(levels: int = 4, fanout: int = FANOUT) -> str:
    """Trees of up to fanout^levels leaves, level by level; a run of a level that a tree doesn't have is its node."""
    text = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda t: "sha256(" + " || ".join(text(t if c == "text" else c) for c in COLUMNS) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "[" + ", ".join(["0"] * 8) + "]"
    parts = [
        f"""steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, {bits}), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
picked AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS mark FROM documents, steps),
leaves AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN mark % {TAMPER} = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS told FROM picked)""",
    ]

    def tree(base: str, label: str, by: str) -> list[str]:
        rows = [f"{label}0 AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY {base}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n, h FROM {label})"]
        for k in range(levels):
            rows.append(
                f"{label}{k + 1} AS (SELECT {by}, i // {fanout} AS i, (max(n) + {fanout - 1}) // {fanout} AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {label}{k} GROUP BY {by}, i // {fanout})"
            )
        return rows

    parts.append("docs AS (SELECT doc_id, coalesce('s' || source, '') AS tree, leaf, told, leaf AS h FROM leaves)")
    rows = tree("doc_id NULLS FIRST, h", "docs", "tree")
    parts += [rows[0].replace("n, h FROM", "n, h, doc_id, told FROM"), *rows[1:]]
    parts.append(f"tops AS (SELECT 0 AS tree, tree AS of, h FROM docs{levels})")
    rows = tree("of", "tops", "tree")
    parts += [rows[0].replace("n, h FROM", "n, h, of FROM"), *rows[1:]]

    def proof(label: str, start: str, more: str, by: str) -> list[str]:
        """Columns before, behind and all siblings, level by level."""
        found = [f"{label}p0 AS (SELECT {more}, i, n, {start} AS told, '' AS seen FROM {label}0)"]
        for k in range(levels):
            side = lambda sign: f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i {sign} a.i), '')"
            found.append(
                f"""{label}s{k} AS (SELECT a.{by}, a.i, {side("<")} AS l, {side(">")} AS r FROM {label}{k} a JOIN {label}{k} b ON a.{by} = b.{by} AND a.i // {fanout} = b.i // {fanout} GROUP BY a.{by}, a.i),
{label}p{k + 1} AS (SELECT p.* REPLACE (p.i // {fanout} AS i, (p.n + {fanout - 1}) // {fanout} AS n, CASE WHEN p.n = 1 THEN p.told ELSE sha256(s.l || p.told || s.r) END AS told, p.seen || s.l || s.r AS seen) FROM {label}p{k} p JOIN {label}s{k} s ON p.{by} = s.{by} AND p.i = s.i)"""
            )
        return found

    parts += proof("docs", "told", "tree, doc_id, h AS leaf", "tree")
    # from a source's subroot up: its own levels of the tree of subroots, for each document
    parts.append(f"inner_proofs AS (SELECT p.doc_id, p.leaf, p.told, p.seen, t.i, t.n, t.h AS subroot, 0 AS tree FROM docsp{levels} p JOIN tops0 t ON p.tree = t.of)")
    above = proof("tops", "told", "doc_id, leaf, subroot, tree", "tree")
    parts += [above[0].replace("tops0", "inner_proofs").replace("'' AS seen", "seen"), *above[1:]]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, told AS folded_root, told = root AS verified
FROM topsp{levels}, (SELECT h AS root FROM tops{levels})"""


ORACLE = _oracle()
