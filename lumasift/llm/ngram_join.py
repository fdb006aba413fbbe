"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

A document is the set of its distinct shingles of ``WORDS`` words, as sorted
64-bit hashes.  Documents link when the Jaccard similarity of their sets is at
least ``PERCENT`` %.  Equal sets are one *node*.  Each node has a parity bitmap
about as wide as its set is large: two bitmaps can't differ in more bits than
the sets differ in elements, so a count of differing bits bounds the overlap
from above.  What the bound leaves is intersected exactly.

Which nodes meet:

1. Common shingles come last.  A count-min row of fixed size, summed over all
   documents and less what a cell of its part holds at the median, gives
   shingles their order: by class of frequency, then by hash.  The median is
   what chance puts in a cell, so a shingle is common only if it stands out,
   however large the input is.
   Linked sets share one of their first n - ceil(0.8 n) + 1 shingles in any
   order, so only these prefixes are indexed.
2. Nodes that share an indexed shingle: up to ``PAIRS_UP_TO`` nodes meet in
   pairs of fitting sizes.  A larger group is a star: each node meets
   ``LEADERS`` leaders only.  A shingle that the counts call hot is dealt to
   several groups by node, and some nodes of each meet in one further group.
3. Bitmaps drop pairs; the others are verified in tasks that hold a cluster of
   them, or a hub and some of its neighbours, skipping pairs that are connected
   already.  Components of the links follow.
4. Stars may have missed links between nodes of one group that are still in
   different components, and so may have dealing, however few nodes a part has.
   The nodes of such groups (all parts of a hot shingle are one) go to blocks of
   few nodes and shingles and of one size band; two blocks of close bands that
   share a group, unless both are of one component, make a tile, which is
   compared in full: by bitmaps first, as matrices, and then exactly, skipping
   connected pairs.

So no link between components is lost, no task holds a whole group, and no
group's pairs are listed.

Defined results: null or wordless text has the empty set and links with
nothing; fewer words than ``WORDS`` make one shingle; of a component without
any id the id is null; rows that repeat are in one component; an empty table
gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumasift.llm.common import flat, saved, table, texts_of
from lumasift.operators.components import connected_components

WORDS, PERCENT = 5, 80
#: Cells of the count-min row, and pieces in which it is summed.
CELL_BITS, PIECES = 21, 64
PAIRS_UP_TO, LEADERS = 24, 4
#: Estimated nodes of a shingle beyond which its group is dealt, and nodes of each part.
HOT, PART = 1 << 16, 1 << 15
#: Documents of a verifying task; shingles and nodes of a block in a tile.
CLUSTER, BLOCK_SHINGLES, BLOCK_NODES = 256, 400_000, 512
FLUSH = 1 << 20
#: Bit of the groups that a hot shingle's nodes are dealt to, whose low bits are the part's number (0: some nodes of each part).
_DEALT, _PARTS = np.uint64(1 << 63), np.uint64(0xFFFF)
#: Least and most bits of a Bloom filter (most: 32 MB); ten a node between them.
_BLOOM_BITS = 20, 28

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9DDFEA08EB382D69  # odd
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where they start."""
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_P_INVERSE, n)[starts] if len(starts) else np.zeros(0, np.uint64)
    return _mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _joined(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(words) - k + 1
    h = np.full(max(n, 0), k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n]
    return _mix(h)


def shingle_sets(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted set of each text (of a large_string array without nulls)."""
    data, starts = flat(texts, 1)
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        lo, hi = int(starts[i]), int(starts[j])
        words, at = [], []
        while lo < hi:  # a very long text goes in parts that end in white space
            end = min(hi, lo + 4 * max_bytes)
            while end < hi and not _SPACE[data[end]]:
                end += 1
            h, s = _word_hashes(data[lo:end])
            words.append(h)
            at.append(s + lo)
            lo = end
        w, s = np.concatenate(words), np.concatenate(at)
        cuts = np.searchsorted(s, starts[i : j + 1])
        runs = _joined(w, WORDS)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= WORDS:
                h = np.sort(runs[a : b - WORDS + 1])
                yield h[np.append(True, h[1:] != h[:-1])]
            else:
                yield _joined(w[a:b], b - a) if b > a else np.zeros(0, np.uint64)
        i = j


def node_of(h: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    total = int(_mix(h + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) + len(h) * 0x2545F4914F6CDD1D
    return (total + (1 << 63)) % (1 << 64) - (1 << 63)


def bitmap_of(h: np.ndarray) -> bytes:
    """Parities of the elements by their low bits; halves of a bitmap xor to the next narrower one."""
    width = max(64, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def overlap_needed(a, b, percent: int = PERCENT):
    """Least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def overlap_bound(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """No less than the intersection of two sets."""
    a, b = int.from_bytes(bits_a, "little"), int.from_bytes(bits_b, "little")
    wide, narrow = 8 * len(bits_a), 8 * len(bits_b)
    while wide > narrow:
        wide //= 2
        a = (a >> wide) ^ (a & ((1 << wide) - 1))
    while narrow > wide:
        narrow //= 2
        b = (b >> narrow) ^ (b & ((1 << narrow) - 1))
    return (n_a + n_b - (a ^ b).bit_count()) // 2


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Exact size for sorted arrays of distinct elements."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    return intersection(a, b) >= overlap_needed(len(a), len(b), percent)


class Union:
    """Components of what a task has linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


# -- step 1: nodes, bitmaps and counts ------------------------------------------------------------


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


_SETS = "doc_id long, text_hash long, n long, node long, bits binary, piece int, counts binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end rows of this task's shingle counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bits", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())])
    counts = np.zeros(1 << CELL_BITS, np.uint32)
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        texts = texts_of(batch.column(1))
        ns, nodes, bits = [], [], []
        for h in shingle_sets(texts):
            ns.append(len(h))
            if not len(h):
                nodes.append(None)
                bits.append(None)
                continue
            node = node_of(h)
            nodes.append(node)
            bits.append(bitmap_of(h))
            if node not in seen:
                seen.add(node)
                held.append((h >> np.uint64(64 - CELL_BITS)).astype(np.int64))
                size += len(h)
                if size >= FLUSH:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
                    held, size = [], 0
        none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), *none], schema=schema)
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
    if seen:
        cut = np.minimum(counts, 65535).astype("<u2").reshape(PIECES, -1)
        nulls = [pa.nulls(PIECES, t) for t in schema.types[:5]]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(PIECES), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], schema=schema)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the count-min row, as classes: twice the binary logarithm."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = np.frombuffer(counts, "<u2").astype(np.int64)
            sums[piece] = sums[piece] + c if piece in sums else c
    for piece, c in sums.items():
        c = np.maximum(0, c - int(np.median(c)))
        classes = np.floor(2 * np.log2(1 + c)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([classes.tobytes()], pa.binary())], names=["piece", "classes"])


# -- step 2: prefixes, groups, pairs --------------------------------------------------------------


def _blobs(bucket: np.ndarray, n_buckets: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row a bucket, its entries packed."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    columns = [c[order] for c in columns]
    for lo in range(0, len(full), 64):
        some = full[lo : lo + 64]
        arrays = [pa.array([c[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *arrays], names=["bucket", *(f"c{k}" for k in range(len(columns)))])


def _loaded(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for k, kind in enumerate(kinds):
            parts[k] += [np.frombuffer(x, kind) for x in batch.column(k + 1).to_pylist()]
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds)]


def _prefixes(classes, n_buckets: int, percent: int, hot: int, part: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = np.frombuffer(classes.value, np.uint8)
        limit = int(np.floor(2 * np.log2(1 + hot)))
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = [len(t) for t, _, _ in held]
            tokens = np.concatenate([t for t, _, _ in held])
            nodes = np.repeat(np.array([x for _, x, _ in held], np.int64), lengths)
            sizes = np.repeat(np.array([x for _, _, x in held], np.int32), lengths)
            group = _mix(tokens) & ~_DEALT
            common = np.flatnonzero((tokens >> np.uint64(56)).astype(np.int64) >= limit)
            if len(common):  # deal a hot shingle's nodes to parts; a part's least node here joins the parts' own group
                estimate = 2.0 ** ((tokens[common] >> np.uint64(56)).astype(np.float64) / 2)
                parts = np.clip(np.ceil(estimate / part), 1, int(_PARTS) - 1).astype(np.uint64)
                ranks = _mix(nodes[common].view(np.uint64))
                root = (group[common] & ~_PARTS) | _DEALT
                dealt = root + np.uint64(1) + ranks % parts
                order = np.lexsort((ranks, dealt))
                first = order[np.append(True, dealt[order][1:] != dealt[order][:-1])]
                group[common] = dealt
                group = np.append(group, root[first])
                nodes, sizes = np.append(nodes, nodes[common][first]), np.append(sizes, sizes[common][first])
            yield from _blobs((_mix(group) % np.uint64(n_buckets)).astype(np.int64), n_buckets, [group, nodes, sizes])

        for batch in batches:
            for h in shingle_sets(texts_of(batch.column(1))):
                n = len(h)
                if not n or (node := node_of(h)) in seen:
                    continue
                seen.add(node)
                order = (cls[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                order.sort()
                held.append((order[: n - -(-percent * n // 100) + 1], node, n))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return apply


def _group_pairs(n_buckets: int, percent: int, pairs_up_to: int, leaders: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sizes = _loaded(batches, ["<u8", "<i8", "<i4"])
        order = np.lexsort((nodes, group))
        group, nodes, sizes = group[order], nodes[order], sizes[order]
        if not len(group):
            return
        fresh = np.append(True, (group[1:] != group[:-1]) | (nodes[1:] != nodes[:-1]))
        group, nodes, sizes = group[fresh], nodes[fresh], sizes[fresh]
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        lengths = np.diff(np.append(begins, len(group)))
        left, right, kinds = [], [], []

        def put(i: np.ndarray, j: np.ndarray) -> None:
            lo, hi = np.minimum(sizes[i], sizes[j]).astype(np.int64), np.maximum(sizes[i], sizes[j]).astype(np.int64)
            fits = 100 * lo >= percent * hi
            left.append(np.minimum(nodes[i], nodes[j])[fits]), right.append(np.maximum(nodes[i], nodes[j])[fits])
            kinds.append(np.zeros(int(fits.sum()), np.int8))

        for m in range(2, pairs_up_to + 1):
            at = begins[lengths == m]
            one, two = np.triu_indices(m, 1)
            for lo in range(0, len(at), max(1, FLUSH // len(one))):
                some = at[lo : lo + max(1, FLUSH // len(one)), None]
                put((some + one).ravel(), (some + two).ravel())
        large = lengths > pairs_up_to
        dealt = group >= _DEALT
        unsure = np.flatnonzero(np.repeat(large, lengths) | dealt)  # a small part's pairs are whole, but not with other parts
        left.append(np.where(dealt, group & ~_PARTS, group)[unsure].view(np.int64)), right.append(nodes[unsure]), kinds.append(np.ones(len(unsure), np.int8))
        if large.any():
            inside = np.flatnonzero(np.repeat(large, lengths))
            mine = np.repeat(np.arange(large.sum()), lengths[large])
            starts = np.append(0, np.cumsum(lengths[large])[:-1])
            for k in range(leaders):
                rank = _mix(nodes[inside].view(np.uint64) + np.uint64(0xA24BAED4963EE407 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
                lead = inside[np.lexsort((rank, mine))[starts]][mine]
                other = lead != inside
                put(inside[other], lead[other])
        a, b, kind = np.concatenate(left), np.concatenate(right), np.concatenate(kinds)
        order = np.lexsort((kind, b, a))
        a, b, kind = a[order], b[order], kind[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) if len(a) else np.zeros(0, bool)
        a, b, kind = a[fresh], b[fresh], kind[fresh]
        yield from _blobs((_mix(a.view(np.uint64) + _mix(b.view(np.uint64))) % np.uint64(n_buckets)).astype(np.int64), n_buckets, [a, b, kind])

    return apply


def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, kind = _loaded(batches, ["<i8", "<i8", "<i1"])
    order = np.lexsort((kind, b, a))
    a, b, kind = a[order], b[order], kind[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) if len(a) else np.zeros(0, bool)
    yield pa.RecordBatch.from_arrays([pa.array(a[fresh], pa.int64()), pa.array(b[fresh], pa.int64()), pa.array(kind[fresh] > 0, pa.bool_())], names=["a", "b", "grouped"])


# -- step 3: bitmaps, then exact intersection -----------------------------------------------------


def _bounded(percent: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, bits_a, n_b, bits_b = (c.to_pylist() for c in batch.columns)
            keep = [overlap_bound(na, xa, nb, xb) >= overlap_needed(na, nb, percent) for na, xa, nb, xb in zip(n_a, bits_a, n_b, bits_b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return apply


def _texts_of_nodes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of at least the ``wanted`` nodes: a Bloom filter of bounded size picks them where they are read."""
    width = min(max(_BLOOM_BITS[0], (10 * wanted.count()).bit_length()), _BLOOM_BITS[1])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.zeros(1 << width, bool)
        for batch in batches:
            for at in _bloom_places(batch.column(0).to_numpy(), width):
                bloom[at] = True
        packed = np.packbits(bloom, bitorder="little").reshape(16, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], names=["piece", "bits"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(x, np.uint8)
                sums[piece] = sums[piece] | x if piece in sums else x
        for piece, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["piece", "bits"])

    # 32 MB in all at most
    pieces = {r["piece"]: r["bits"] for r in wanted.select("node").mapInArrow(bits, "piece int, bits binary").repartition(16, "piece").mapInArrow(united, "piece int, bits binary").toLocalIterator()}
    size = (1 << width) // 8 // 16
    bloom = docs.sparkSession.sparkContext.broadcast(b"".join(pieces.get(k, bytes(size)) for k in range(16)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.frombuffer(bloom.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            texts = texts_of(batch.column(1))
            nodes = np.array([node_of(h) if len(h) else 0 for h in shingle_sets(texts)], np.int64)
            keep = np.ones(len(nodes), bool)
            for at in _bloom_places(nodes, width):
                keep &= (maybe[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            rows = []
            for i in np.flatnonzero(keep).tolist():
                if (node := int(nodes[i])) not in seen:
                    seen.add(node)
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows], pa.int64()), texts.take(pa.array(rows, pa.int64())).cast(pa.string())], names=["node", "text"])

    return _source(docs).mapInArrow(pick, "node long, text string").dropDuplicates(["node"])


def _bloom_places(nodes: np.ndarray, width: int) -> list[np.ndarray]:
    h = _mix(nodes.astype(np.int64).view(np.uint64))
    return [((h >> np.uint64(s)) & np.uint64((1 << width) - 1)).astype(np.int64) for s in (0, 18, 36)]


def _sets_of(texts: list[str]) -> list[np.ndarray]:
    return list(shingle_sets(pa.array(texts, pa.large_string())))


def _verify(percent: int) -> Callable:
    """Pairs of one task that are linked, as stars."""

    def apply(key: tuple, pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(texts["node"].tolist(), _sets_of(texts["text"].tolist())))
        union = Union()
        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
            if union.root(a) != union.root(b) and linked(sets[a], sets[b], percent):
                union.join(a, b)
        rows = [(x, union.root(x)) for x in union.up]
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"]).astype("int64")

    return apply


def _links(docs: DataFrame, pairs: DataFrame, percent: int, cluster: int) -> DataFrame:
    """Stars that connect what verified pairs connect."""
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("node"))
    clusters = saved(connected_components(pairs), "join-clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    n_groups = max(1, -(-clusters.count() // cluster))
    placed = saved(pairs.join(clusters.withColumnRenamed("node", "a"), "a").join(sizes, "component"), "join-placed")
    whole = placed.filter(F.col("members") <= cluster).select("a", "b", F.pmod(F.xxhash64("component"), F.lit(n_groups)).alias("task"))
    # a large cluster: each pair goes with its end of more pairs, some neighbours to a task
    large = placed.filter(F.col("members") > cluster).select("a", "b")
    degree = ends(large).groupBy("node").agg(F.count("*").alias("degree"))
    hubs = (
        large.join(degree.select(F.col("node").alias("a"), F.col("degree").alias("d_a")), "a")
        .join(degree.select(F.col("node").alias("b"), F.col("degree").alias("d_b")), "b")
        .withColumn("hub", F.when(F.col("d_a") >= F.col("d_b"), F.col("a")).otherwise(F.col("b")))
        .withColumn("other", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")))
        .withColumn("part", F.pmod(F.xxhash64("other"), F.ceil(F.greatest("d_a", "d_b") / F.lit(cluster))))
        .select("a", "b", (-F.abs(F.xxhash64("hub", "part") % F.lit(1 << 62)) - 1).alias("task"))
    )
    tasks = saved(whole.unionByName(hubs), "join-tasks")
    members = tasks.select("task", F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = members.join(_texts_of_nodes(docs, members.select("node")), "node").select(F.col("task").alias("job"), "node", "text")
    return saved(tasks.groupBy("task").cogroup(texts.groupBy("job")).applyInPandas(_verify(percent), "a long, b long"), "join-links")


# -- step 4: groups of several components ---------------------------------------------------------


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps as those of ``words`` words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


class _Side:
    """Nodes of one width of bitmap: their places in the tile, sizes and bitmaps."""

    def __init__(self, at: np.ndarray, n: np.ndarray, bits: list[bytes]):
        self.at, self.n = at, n
        self.bits = np.frombuffer(b"".join(bits), "<u8").reshape(len(at), -1)

    @classmethod
    def by_width(cls, at: np.ndarray, n: np.ndarray, bits: list[bytes]) -> list[_Side]:
        widths = np.array([len(x) for x in bits], np.int64)
        return [cls(at[k], n[k], [bits[i] for i in k]) for w in np.unique(widths) for k in [np.flatnonzero(widths == w)]]


def tile_links(ns: np.ndarray, bits: list[bytes], sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (of ``left`` and ``right``, places) that link and connect what ``labels`` and the pairs before leave apart."""
    comp = np.unique(labels, return_inverse=True)[1]
    out = []
    pick = lambda at: _Side.by_width(at, ns[at], [bits[i] for i in at])
    for one in pick(left):
        for two in pick(right):
            words = min(one.bits.shape[1], two.bits.shape[1])
            a_bits, b_bits = _folded(one.bits, words), _folded(two.bits, words)
            for i, n_a, row in zip(one.at.tolist(), one.n.tolist(), a_bits):
                fits = (100 * np.minimum(n_a, two.n) >= percent * np.maximum(n_a, two.n)) & (comp[two.at] != comp[i])
                some = np.flatnonzero(fits)
                if not len(some):
                    continue
                differ = np.bitwise_count(b_bits[some] ^ row).sum(1, dtype=np.int64)
                some = some[(n_a + two.n[some] - differ) // 2 >= overlap_needed(n_a, two.n[some], percent)]
                for j in two.at[some].tolist():
                    if comp[i] != comp[j] and linked(sets[i], sets[j], percent):
                        out.append((i, j))
                        comp[comp == comp[j]] = comp[i]
    return out


def _tile(percent: int) -> Callable:
    """Links between components in a tile of two blocks, or in one block."""

    def apply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["node", "side"])
        own = rows.drop_duplicates("node")
        nodes = own["node"].to_numpy()
        place = dict(zip(nodes.tolist(), range(len(nodes))))
        side = lambda k: np.array([place[x] for x in rows.loc[rows["side"] == k, "node"].tolist()], np.int64)
        left, right = side(0), side(1)
        found = tile_links(own["n"].to_numpy(), own["bits"].tolist(), _sets_of(own["text"].tolist()), own["label"].to_numpy(), left, right if len(right) else left, percent)
        return pd.DataFrame([(int(nodes[i]), int(nodes[j])) for i, j in found], columns=["a", "b"]).astype("int64")

    return apply


def _missed(docs: DataFrame, grouped: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, block_nodes: int) -> DataFrame | None:
    """Links between components that share a group (group, node) and that stars have not met; None if every group is of one component."""
    known = saved(grouped.join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("label")), "join-grouped")
    sizes = known.groupBy("group").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = saved(sizes.filter(F.col("lo") != F.col("hi")).select("group", "size"), "join-mixed")
    if not mixed.take(1):
        return None
    shared = saved(known.join(mixed, "group"), "join-shared")
    main = shared.groupBy("group", "label").agg(F.count("*").alias("size")).groupBy("group").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    # a node is in the blocks of its largest group
    home = shared.groupBy("node").agg(F.max(F.struct("size", "group"))["group"].alias("group"), F.min("label").alias("label"))
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + F.lit(1e-9))
    members = home.join(main, "group").join(nodes.select("node", "n", "bits"), "node").withColumn("band", band).withColumn("major", F.col("label") == F.col("main"))
    members = saved(members, "join-members")
    parts = members.groupBy("group", "band", "major").agg(F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count("*") / F.lit(block_nodes))).alias("parts"))
    placed = members.join(parts, ["group", "band", "major"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = placed.select("node", "label", "n", "bits", "band", F.when(F.col("major"), F.col("main")).alias("pure"), F.xxhash64("group", "band", "major", "part").alias("block"))
    placed = saved(placed, "join-placed")
    blocks = saved(shared.select("group", "node").join(placed.select("node", "block", "band", "pure"), "node").select("group", "block", "band", "pure").distinct(), "join-blocks")
    two = blocks.select("group", *[F.col(c).alias(f"{c}_2") for c in ("block", "band", "pure")])
    # bands of linked sets are at most one apart; two blocks of one component need no tile
    near = (F.abs(F.col("band") - F.col("band_2")) <= 1) & (F.col("block") <= F.col("block_2")) & ~F.coalesce(F.col("pure") == F.col("pure_2"), F.lit(False))
    tiles = saved(blocks.join(two, "group").filter(near).select("block", "block_2").distinct(), "join-tiles")
    one = F.struct("block", F.lit(0).alias("side"))
    other = F.struct(F.col("block_2").alias("block"), F.lit(1).alias("side"))
    sides = tiles.select(F.xxhash64("block", "block_2").alias("tile"), F.explode(F.when(F.col("block") == F.col("block_2"), F.array(one)).otherwise(F.array(one, other))).alias("x")).select("tile", "x.block", "x.side")
    busy = placed.join(sides.select("block").distinct(), "block", "left_semi")
    texts = _texts_of_nodes(docs, busy.select("node"))
    filled = busy.select("node", "label", "n", "bits", "block").join(texts, "node").join(sides, "block").select("tile", "side", "node", "label", "n", "bits", "text")
    return saved(filled.groupBy("tile").applyInPandas(_tile(percent), "a long, b long"), "join-missed")


# -- the join -------------------------------------------------------------------------------------


def classes_of(docs: DataFrame, percent: int = PERCENT, pairs_up_to: int = PAIRS_UP_TO, leaders: int = LEADERS, cluster: int = CLUSTER, hot: int = HOT, part: int = PART, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash, n, node, label.

    Rows of one label are connected by links; rows without words have no label.
    """
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = saved(_source(docs).mapInArrow(_sets, _SETS), "join-sets")
    rows = made.filter(F.col("piece").isNull()).select("doc_id", "text_hash", "n", "node", "bits")
    sums = made.filter(F.col("piece").isNotNull()).select("piece", "counts").repartition(min(PIECES, buckets), "piece").mapInArrow(_sum_counts, "piece int, classes binary")
    pieces = {r["piece"]: r["classes"] for r in sums.toLocalIterator()}  # 2 MB in all, whatever the input
    classes = spark.sparkContext.broadcast(b"".join(pieces.get(k, bytes((1 << CELL_BITS) // PIECES)) for k in range(PIECES)))

    entries = _source(docs).mapInArrow(_prefixes(classes, buckets, percent, hot, part), "bucket int, c0 binary, c1 binary, c2 binary")
    grouped = entries.repartition(buckets, "bucket").mapInArrow(_group_pairs(buckets, percent, pairs_up_to, leaders), "bucket int, c0 binary, c1 binary, c2 binary")
    met = saved(grouped.repartition(buckets, "bucket").mapInArrow(_distinct_pairs, "a long, b long, grouped boolean"), "join-pairs")

    nodes = saved(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("n").alias("n"), F.min("bits").alias("bits")), "join-nodes")
    end = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    candidates = met.filter(~F.col("grouped")).join(end("a"), "a").join(end("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    pairs = saved(candidates.mapInArrow(_bounded(percent), "a long, b long"), "join-bounded")
    links = _links(docs, pairs, percent, cluster)
    labels = saved(connected_components(links), "join-labels")
    missed = _missed(docs, met.filter("grouped").select(F.col("a").alias("group"), F.col("b").alias("node")), labels, nodes, percent, block_nodes)
    if missed is not None:
        labels = saved(connected_components(links.unionByName(missed)), "join-labels")
    return rows.select("doc_id", "text_hash", "n", "node").join(labels, "node", "left").select("doc_id", "text_hash", "n", "node", F.coalesce("component", "node").alias("label"))


def join(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    rows = saved(classes_of(docs, **options), "join-classes")
    # a table of its own, so that a join with a hot label can be broadcast or split
    smallest = saved(rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id")), "join-smallest")
    return rows.join(smallest, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns: of each component the one with the smallest id, and all without words."""
    names = docs.columns
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = classes_of(docs, **options)
    best = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("best")).select(F.col("best.doc_id").alias("__join_id"), F.col("best.text_hash").alias("__join_text"))
    keyed = docs.filter(~wordless).withColumn("__key_id", F.col("doc_id").cast("long")).withColumn("__key_text", F.xxhash64(F.col("text").cast("string")))
    chosen: Column = F.col("__key_id").eqNullSafe(F.col("__join_id")) & (F.col("__key_text") == F.col("__join_text"))
    nth = F.row_number().over(Window.partitionBy("__join_id", "__join_text").orderBy(F.lit(1)))
    kept = keyed.join(best, chosen).withColumn("__join_nth", nth).filter(F.col("__join_nth") == 1).select(*names)
    return kept.unionByName(docs.filter(wordless))


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS t FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach) AS component_id FROM n JOIN r ON n.doc_id = r.node GROUP BY n.doc_id, n.n
"""
