"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` ids.  Full pieces are sequences
of their own.  The others are dealt by hash to blocks of about ``BLOCK`` pieces,
and each block is packed on several islands.  An individual is a list of bins.
Crossover injects whole well-filled bins of one parent in the other, takes out
the bins that hold the same documents again, and best-fits the displaced ones,
longest first.  Mutation takes apart the emptiest bins, some with room and some
at random, and fills new ones: each with the longest document left and those
others that leave least room.  Worth is the number of bins, then the sum of
squared fills, so room gathers in few bins until one is saved.  After each epoch
the elite of every island migrates to the next one.  An island ends an epoch
when its best has as few bins as its ids need, or has not become better for
``PATIENCE`` generations; at the end each block's best island counts.

Blocks keep each task's rows bounded; one partly filled bin a block is the price.

Defined results: null text counts as empty and is one piece that holds the end
id; rows that repeat are packed each, null ids too; pieces of one length go by
their row numbers, so equal input in equal partitions is packed alike; empty
input gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumasift.llm.common import saved, table, texts_of
from lumasift.llm.encode import Encoder, default_path, grouped

CAPACITY, END_ID = 1024, 2
BLOCK, ISLANDS, EPOCHS = 32768, 2, 2
#: Individuals; most generations of an epoch, and how many may go by without a better one.
POPULATION, GENERATIONS, PATIENCE = 4, 6, 2
FULL = 0.985
#: Bins that a mutation takes apart: the emptiest, others with room, any.
SPANS = 6, 20, 10
#: Mutations of a child.
STEPS = 48
#: Most tasks of an epoch; more islands share them.
MAX_TASKS = 20_000
_SEED = 977


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids, and n: only the first may be shorter."""
    head = n % capacity or capacity
    return [0, *range(min(head, n), n + 1, capacity)] if n > capacity else [0, n]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32 bit)."""
    path = tokenizer or default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = texts_of(batch.column(1)).to_pylist()
            for lo, hi in grouped(texts):
                rows = []
                for doc_id, narrow in zip(ids[lo:hi], encoder.encode(texts[lo:hi])):
                    wide = np.frombuffer(narrow, encoder.dtype).astype("<u4").tobytes() + end
                    cuts = cut_points(len(wide) // 4, capacity)
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row = (doc_id, k, a, b - a, zlib.crc32(wide[4 * a : 4 * b]))
                        rows.append((*row, wide[4 * a : 4 * b]) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, schema)


Bins = list[list[int]]


class Packer:
    """One block: sizes in descending order; bins hold positions in them."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity = sizes, capacity
        self.least = -(-sum(sizes) // capacity)
        self.random = random.Random(seed)

    def fill(self, b: list[int]) -> int:
        sizes = self.sizes
        return sum([sizes[i] for i in b])

    def best_fit(self, items: list[int], bins: Bins) -> Bins:
        """Put each item in the bin that it leaves with least room, or a new one."""
        sizes, capacity = self.sizes, self.capacity
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        rooms = 0  # bit r: some bin has room r
        for k, b in enumerate(bins):
            r = capacity - self.fill(b)
            by_room[r].append(k)
            rooms |= 1 << r
        rooms &= ~1
        for item in items:
            s = sizes[item]
            fits = rooms >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                k = by_room[r].pop()
                if not by_room[r]:
                    rooms ^= 1 << r
                bins[k].append(item)
                r -= s
            else:
                k, r = len(bins), capacity - s
                bins.append([item])
            by_room[r].append(k)
            if r:
                rooms |= 1 << r
        return bins

    def fresh(self, noise: float) -> Bins:
        order = range(len(self.sizes))
        if noise:
            draw = self.random.uniform
            order = sorted(order, key=lambda i: -self.sizes[i] * draw(1 - noise, 1 + noise))
        return self.best_fit(list(order), [])

    def worth(self, bins: Bins) -> tuple[int, float]:
        """Fewer bins first, then bins as unevenly filled as can be."""
        return -len(bins), sum([self.fill(b) ** 2 for b in bins])

    def _rebuilt(self, kept: Bins, injected: Bins) -> Bins:
        inside = set()
        for b in injected:
            inside.update(b)
        bins, displaced = [list(b) for b in injected], []
        for b in kept:
            if inside.isdisjoint(b):
                bins.append(list(b))
            else:
                displaced += [i for i in b if i not in inside]
        return self.best_fit(sorted(displaced), bins)

    def cross(self, a: Bins, b: Bins) -> Bins:
        """Whole well-filled bins of b in a."""
        good = [x for x in b if self.fill(x) >= FULL * self.capacity]
        if not good:
            return a
        share = self.random.uniform(0.1, 0.5)
        return self._rebuilt(a, self.random.sample(good, max(1, int(share * len(good)))))

    def refill(self, items: list[int]) -> Bins:
        """Bins of ``items`` (longest first): each the longest one left and, of the others, a set that leaves least room.

        Sums that can be met are bits of a number, from the shortest item on.
        """
        sizes, bins, left = self.sizes, [], items
        while left:
            head, *rest = left
            room = self.capacity - sizes[head]
            mask, sums = (1 << (room + 1)) - 1, [1]
            for i in reversed(rest):
                sums.append((sums[-1] | sums[-1] << sizes[i]) & mask)
            goal = sums[-1].bit_length() - 1
            taken, left = [head], []
            for k, i in enumerate(rest):
                if sizes[i] <= goal and sums[len(rest) - k - 1] >> (goal - sizes[i]) & 1:
                    taken.append(i)
                    goal -= sizes[i]
                else:
                    left.append(i)
            bins.append(taken)
        return bins

    def mutated(self, a: Bins, steps: int) -> Bins:
        """``steps`` mutations one after the other; one that makes more bins, or fills them more evenly, is taken back."""
        bins, fills = list(a), [self.fill(b) for b in a]
        for step in range(steps):
            if len(bins) <= self.least:
                break
            if step % 32 == 0:  # the lists may be a little behind
                roomy = sorted((k for k, f in enumerate(fills) if f < self.capacity), key=fills.__getitem__)
            some = {*roomy[: SPANS[0]], *self.random.sample(roomy, min(len(roomy), SPANS[1])), *self.random.sample(range(len(bins)), min(len(bins), SPANS[2]))}
            out = sorted(k for k in some if k < len(bins))
            made = self.refill(sorted(i for k in out for i in bins[k]))
            new = [self.fill(b) for b in made]
            if (len(made), -sum(f * f for f in new)) > (len(out), -sum(fills[k] * fills[k] for k in out)):
                continue
            for k, b, f in zip(out, made, new):
                bins[k], fills[k] = b, f
            for k in reversed(out[len(made) :]):
                bins[k], fills[k] = bins[-1], fills[-1]
                bins.pop(), fills.pop()
        return bins

    def evolve(self, newcomers: list[Bins], population: int, generations: int, patience: int = PATIENCE) -> Bins:
        pool = [(self.worth(b), b) for b in newcomers]
        k = 0
        while len(pool) < population and not any(len(b) <= self.least for _, b in pool):
            b = self.fresh(0.04 * k)
            pool.append((self.worth(b), b))
            k += 1
        idle = 0
        for _ in range(generations):
            pool.sort(key=lambda x: x[0], reverse=True)
            if len(pool[0][1]) <= self.least or idle >= patience:
                break
            before = pool[0][0]
            one, two = self.random.sample(pool[:population], 2) if len(pool) > 1 else (pool[0], pool[0])
            for child in (self.cross(one[1], two[1]), pool[0][1]):
                child = self.mutated(child, STEPS)
                pool.append((self.worth(child), child))
            pool = sorted(pool, key=lambda x: x[0], reverse=True)[:population]
            idle = 0 if pool[0][0] > before else idle + 1
        return max(pool, key=lambda x: x[0])[1]


def _to_bins(places: bytes) -> Bins:
    where = np.frombuffer(places, "<i4")
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order], prepend=-1))
    return [x.tolist() for x in np.split(order, cuts[1:])] if len(where) else []


def _to_places(bins: Bins, n: int) -> bytes:
    where = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        where[b] = k
    return where.tobytes()


def _epoch(capacity: int, population: int, generations: int, epoch: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                sizes = np.frombuffer(row["sizes"], "<i4").tolist()
                packer = Packer(sizes, capacity, _SEED + 1009 * row["block"] + 31 * row["island"] + epoch)
                guests = [_to_bins(x) for x in (row["own"], row["guest"]) if x is not None]
                bins = min(guests, key=len) if guests and min(map(len, guests)) <= packer.least else packer.evolve(guests, population, generations)
                yield pa.RecordBatch.from_pylist(
                    [{**{k: row[k] for k in ("block", "island", "sizes")}, "own": _to_places(bins, len(sizes)), "bins": len(bins), "done": len(bins) <= packer.least}],
                    schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("own", pa.binary()), ("bins", pa.int64()), ("done", pa.bool_())]),
                )

    return apply


def _sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [(-np.asarray(batch.column(1)[k].values.field("less"))).astype("<i4").tobytes() for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.binary())], names=["block", "sizes"])


def _places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bin and offset of each item, a block at a time: a bin's items lie in the block's order."""
    for batch in batches:
        for block, sizes, own in zip(*(c.to_pylist() for c in batch.columns)):
            where, lengths = np.frombuffer(own, "<i4").astype(np.int64), np.frombuffer(sizes, "<i4").astype(np.int64)
            order = np.argsort(where, kind="stable")
            ends = np.cumsum(lengths[order])
            first = np.append(True, np.diff(where[order]) != 0)
            offsets = np.empty(len(where), np.int64)
            offsets[order] = ends - lengths[order] - np.repeat((ends - lengths[order])[first], np.diff(np.append(np.flatnonzero(first), len(where))))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([where], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64()))], names=["block", "bins", "offsets"])


def pack(cut: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS) -> DataFrame:
    """``cut`` (as pieces() makes it, ids or not) with sequence_id and offset."""
    names = cut.columns
    cut = saved(cut.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    rest = cut.filter(F.col("length") < capacity).select("__row", "length")
    n_blocks = max(1, -(-rest.count() // block))
    blocks = saved(
        rest.groupBy(F.pmod(F.xxhash64("__row"), F.lit(n_blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("less"), "__row"))).alias("items")),
        "blocks",
    )
    state = (
        blocks.mapInArrow(_sizes_of, "block long, sizes binary")
        .withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
        .withColumns({"own": F.lit(None).cast("binary"), "guest": F.lit(None).cast("binary")})
    )
    for epoch in range(epochs):
        spread = state.repartition(min(n_blocks * islands, MAX_TASKS), "block", "island")
        state = saved(spread.mapInArrow(_epoch(capacity, population, generations, epoch), "block long, island int, sizes binary, own binary, bins long, done boolean"), f"epoch-{epoch}")
        if epoch + 1 == epochs or not state.groupBy("block").agg(F.max("done").alias("done")).filter(~F.col("done")).take(1):
            break
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("own").alias("guest"))
        state = state.join(elite, ["block", "island"]).drop("bins", "done")
    best = state.groupBy("block").agg(F.min(F.struct("bins", "island", "sizes", "own")).alias("best")).select("block", "best.sizes", "best.own")
    placed = (
        blocks.select("block", F.col("items.__row").alias("rows"))
        .join(best.mapInArrow(_places_of, "block long, bins array<long>, offsets array<long>"), "block")
        .select("block", F.explode(F.arrays_zip("rows", "bins", "offsets")).alias("x"))
        .select(F.col("x.rows").alias("__row"), (F.shiftleft("block", 24) + F.col("x.bins")).alias("sequence_id"), F.col("x.offsets").alias("offset"))
    )
    shared = cut.filter(F.col("length") < capacity).join(placed, "__row").select(*names, "sequence_id", "offset")
    alone = cut.filter(F.col("length") >= capacity).select(*names, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
