"""Exact dedup by Grace hash deduplication.

1. Each task over the input folds its own rows in an open-addressing table that
   compares complete content, and passes on one row for each text it holds:
   a group of any size sends at most one row a task (and memory budget).
2. Those rows are shuffled by a hash of the content.  A task that gets more
   distinct content than its budget keeps what fits in the table, and writes
   the other rows to spill files by further hash bits; each file is then
   treated likewise, until it fits.  Every pass settles a full table of
   contents, so even equal hashes end.
3. Each document finds its group by the number of its local row, so that no
   task sees the members of a whole group.

Budgets count all that a task holds: contents, ids, rows that lead their group
and rows on their way to a spill file.  Texts are taken from a batch a few at a
time, and members of a group wait in a file.

Defined results: null text counts as empty; of equal texts the row with the
largest id stays (null ids are smallest; of rows that repeat an id the first
met); rows that repeat are members each; very long texts count whole, one larger
than the budget fills a table alone; empty input gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumasift.llm.common import saved, texts_of

#: Bytes that a task holds.
LOCAL_BUDGET = 64 << 20
GRACE_BUDGET = 128 << 20
FAN_OUT_BITS = 4
#: Bytes of rows that wait for a file, members that do so, and texts taken from a batch at once.
SPILL_BYTES, MEMBER_ROWS, AT_ONCE = 8 << 20, 1 << 15, 64
#: Bytes that count for a number, an entry of a table and the like.
_SMALL = 64


class ContentTable:
    """Open addressing with linear probing; entries are compared by complete content."""

    def __init__(self, budget: int):
        self.budget, self.bytes = budget, 0
        self.mask = 1023
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def __len__(self) -> int:
        return len(self.contents)

    def find(self, h: int, content: bytes) -> int:
        """The entry's number, or the bitwise complement of the free slot."""
        slots, i = self.slots, h & self.mask
        while (entry := slots[i]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            i = (i + 1) & self.mask
        return ~i

    def fits(self, content: bytes) -> bool:
        return not self.contents or self.bytes + len(content) + _SMALL <= self.budget

    def add(self, slot: int, h: int, content: bytes) -> int:
        entry = len(self.contents)
        self.slots[slot] = entry
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + _SMALL
        if 2 * entry > self.mask:
            self._grow()
        return entry

    def _grow(self) -> None:
        self.mask = 4 * self.mask + 3
        slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            i = h & self.mask
            while slots[i] >= 0:
                i = (i + 1) & self.mask
            slots[i] = entry
        self.slots = slots


def _bytes_of(value) -> int:
    if isinstance(value, (str, bytes)):
        return _SMALL + len(value)
    if isinstance(value, dict):
        value = list(value.values())
    return _SMALL + sum(map(_bytes_of, value)) if isinstance(value, (list, tuple)) else _SMALL


def _pickled(path: str) -> Iterator[list]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


class _Spill:
    """Rows of one level, in files by further bits of their hash."""

    def __init__(self, folder: str, level: int):
        self.level = level
        self.folder = tempfile.mkdtemp(dir=folder)
        self.held: dict[int, list] = {}
        self.bytes = 0

    def put(self, h: int, content: bytes, row: tuple) -> None:
        bucket = (h >> max(0, 60 - FAN_OUT_BITS * self.level)) & ((1 << FAN_OUT_BITS) - 1)
        self.held.setdefault(bucket, []).append((h, content, row))
        self.bytes += len(content) + _bytes_of(row)
        if self.bytes >= SPILL_BYTES:
            self._write()

    def _write(self) -> None:
        for bucket, rows in self.held.items():
            if rows:
                with open(os.path.join(self.folder, str(bucket)), "ab") as f:
                    pickle.dump(rows, f, protocol=5)
                rows.clear()
        self.bytes = 0

    def parts(self) -> Iterator[Iterable]:
        self._write()
        for bucket in sorted(self.held):
            path = os.path.join(self.folder, str(bucket))
            yield (row for rows in _pickled(path) for row in rows)
            os.unlink(path)


class _Members:
    """Entries and rows in order, in a file beyond ``MEMBER_ROWS``."""

    def __init__(self, folder: str):
        self.path = os.path.join(folder, f"members-{uuid.uuid4().hex}")
        self.held: list[tuple[int, tuple]] = []
        self.filed = False

    def put(self, entry: int, row: tuple) -> None:
        self.held.append((entry, row))
        if len(self.held) >= MEMBER_ROWS:
            with open(self.path, "ab") as f:
                pickle.dump(self.held, f, protocol=5)
            self.held, self.filed = [], True

    def parts(self) -> Iterator[list[tuple[int, tuple]]]:
        if self.filed:
            yield from _pickled(self.path)
            os.unlink(self.path)
        if self.held:
            yield self.held


def _above(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


class Settled:
    """What a pass has settled: contents, of each the leading row (its first value is the id) and its rows' summed weight, and members."""

    def __init__(self, budget: int, folder: str, keep_members: bool):
        self.table = ContentTable(budget)
        self.leads: list[tuple] = []
        self.weights: list[int] = []
        self.members = _Members(folder) if keep_members else None

    def take(self, h: int, content: bytes, row: tuple, weight: int, full: bool) -> bool:
        """Whether the row is settled here; no content is added once the pass is ``full``."""
        entry = self.table.find(h, content)
        if entry < 0:
            if full or not self.table.fits(content):
                return False
            entry = self.table.add(~entry, h, content)
            self.table.bytes += _bytes_of(row)
            self.leads.append(row)
            self.weights.append(weight)
        else:
            self.weights[entry] += weight
            if _above(row[0], self.leads[entry][0]):
                self.leads[entry] = row
        if self.members is not None:
            self.members.put(entry, row)
        return True


def grace(rows: Iterable[tuple[int, bytes, tuple]], budget: int, folder: str, level: int = 0, weight: Callable[[tuple], int] = lambda row: 1, keep_members: bool = True) -> Iterator[Settled]:
    """Settles (hash, content, row) in as many passes as the budget needs."""
    settled = Settled(budget, folder, keep_members)
    spill: _Spill | None = None
    for h, content, row in rows:
        if not settled.take(h, content, row, weight(row), spill is not None):
            spill = spill or _Spill(folder, level)
            spill.put(h, content, row)
    yield settled
    del settled
    if spill is not None:
        for part in spill.parts():
            yield from grace(part, budget, folder, level + 1, weight, keep_members)


def _contents(column: pa.Array) -> Iterator[bytes]:
    for lo in range(0, len(column), AT_ONCE):
        yield from texts_of(column.slice(lo, AT_ONCE)).cast(pa.large_binary()).to_pylist()


def _local(budget: int, emit: Callable) -> Callable:
    """Folds a task's rows (doc_id, text); ``emit(number of the first group, ids, entries, table)`` whenever the budget is used up."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        groups = 0
        table = ContentTable(budget)
        ids, entries, null = array("q"), array("q"), array("b")
        for batch in batches:
            for i, content in zip(batch.column(0).to_pylist(), _contents(batch.column(1))):
                h = xxhash.xxh3_64_intdigest(content)
                entry = table.find(h, content)
                if entries and (not table.fits(content) if entry < 0 else table.bytes + 17 * len(entries) > budget):
                    yield from emit(base + groups, ids, null, entries, table)
                    groups += len(table)
                    table, ids, entries, null = ContentTable(budget), array("q"), array("q"), array("b")
                    entry = table.find(h, content)
                if entry < 0:
                    entry = table.add(~entry, h, content)
                ids.append(i or 0), null.append(i is None), entries.append(entry)
        if entries:
            yield from emit(base + groups, ids, null, entries, table)

    return apply


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", local_budget: int = LOCAL_BUDGET, grace_budget: int = GRACE_BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    local_schema = "doc_id long, part long, leads boolean, n long, text string"

    def emit(first: int, ids: array, null: array, entries: array, table: ContentTable) -> Iterator[pa.RecordBatch]:
        entry, doc_id, no_id = np.frombuffer(entries, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(null, np.int8) > 0
        order = np.lexsort((-np.arange(len(entry)), doc_id, ~no_id, entry))
        leads = np.zeros(len(entry), bool)
        leads[order[np.append(entry[order][1:] != entry[order][:-1], True)]] = True
        sizes = np.bincount(entry, minlength=len(table))
        lo = 0
        while lo < len(entry):  # batches of few rows and few bytes of text
            hi, held = lo, 0
            while hi < min(len(entry), lo + 4096) and held < SPILL_BYTES:
                held += len(table.contents[entry[hi]]) if leads[hi] else 0
                hi += 1
            e, lead = entry[lo:hi], leads[lo:hi]
            texts = [table.contents[k] if x else None for k, x in zip(e.tolist(), lead.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id[lo:hi], mask=no_id[lo:hi]), pa.array(first + e), pa.array(lead), pa.array(sizes[e], mask=~lead), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "part", "leads", "n", "text"],
            )
            lo = hi

    local = saved(docs.mapInArrow(_local(local_budget, emit), local_schema), "exact-local")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for content, *row in zip(_contents(batch.column(3)), *(batch.column(k).to_pylist() for k in range(3))):
                    yield xxhash.xxh3_64_intdigest(content), content, tuple(row)

        with tempfile.TemporaryDirectory() as folder:
            for done in grace(rows(), grace_budget, folder, weight=lambda row: row[2]):
                shas = [hashlib.sha256(c).hexdigest() for c in done.table.contents]
                for part in done.members.parts():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row[1] for _, row in part], pa.int64()),
                            pa.array([done.leads[e][0] for e, _ in part], pa.int64()),
                            pa.array([done.weights[e] for e, _ in part], pa.int64()),
                            pa.array([done.leads[e][1] == row[1] for e, row in part], pa.bool_()),
                            pa.array([shas[e] for e, _ in part], pa.string()),
                        ],
                        names=["part", "keep_id", "group_size", "wins", "text_sha256"],
                    )

    parts = (
        local.filter("leads")
        .select("doc_id", "part", "n", "text")
        .repartition(F.xxhash64("text"))
        .mapInArrow(settle, "part long, keep_id long, group_size long, wins boolean, text_sha256 string")
    )
    return (
        local.select("doc_id", "part", "leads")
        .join(parts, "part")
        .select("doc_id", "keep_id", "group_size", (F.col("leads") & F.col("wins")).alias("kept"), "text_sha256")
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", local_budget: int = LOCAL_BUDGET, grace_budget: int = GRACE_BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one shuffle, no join."""
    schema: T.StructType = docs.schema
    arrow = to_arrow_schema(schema)
    id_at, text_at = schema.fieldNames().index(id_col), schema.fieldNames().index(text_col)

    def fold(budget: int) -> Callable:
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    for lo in range(0, batch.num_rows, AT_ONCE):
                        some = batch.slice(lo, AT_ONCE)
                        for content, row in zip(_contents(some.column(text_at)), zip(*(c.to_pylist() for c in some.columns))):
                            yield xxhash.xxh3_64_intdigest(content), content, (row[id_at], *row)

            with tempfile.TemporaryDirectory() as folder:
                for done in grace(rows(), budget, folder, keep_members=False):
                    lo = 0
                    while lo < len(done.leads):
                        hi, held = lo, 0
                        while hi < min(len(done.leads), lo + 2048) and held < SPILL_BYTES:
                            held += len(done.table.contents[hi])
                            hi += 1
                        columns = zip(*(row[1:] for row in done.leads[lo:hi]))
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow.types)], schema=arrow)
                        lo = hi

        return apply

    local = docs.mapInArrow(fold(local_budget), schema)
    return local.repartition(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).mapInArrow(fold(grace_budget), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
