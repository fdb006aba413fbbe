"""Token-id files with a minimal perfect hash index for keyed access.

One file is one shard, at most about ``SHARD_BYTES`` of ids:

    b"LSTOKEN1" | payload | index | footer (JSON) | its length (u32) | b"LSTOKEN1"

The payload is raw little-endian ids, one document after the other, two bytes
an id if the vocabulary allows it and else four.  The index is a minimal
perfect hash over the shard's keys: levels of bit arrays where a key sets a bit
that no other key of its level hits, the others going on to the next level; a
key's slot is the rank of its bit.  A slot has the key's fingerprint, offset
and length, so access by key takes a few reads, whatever the shard's size; and
a wrong key is told by its fingerprint (but for one in 2^32).  Keys in document
order lead to their slots as well, for reading on.

Files are written under another name and then renamed, so a task that is run
again leaves whole files only.

Defined results: documents lie in ascending id order, null ids first, equal ids
in the order of a hash of the text; rows that repeat an id get occurrence
numbers in their shard, and both make the key; null text counts as empty (the
end id alone); an empty table writes no shard; extra columns play no part.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumasift.llm.common import fresh_path, saved, table, texts_of
from lumasift.llm.encode import Encoder, default_path, grouped

MAGIC = b"LSTOKEN1"
END_ID = 0
SHARD_BYTES = 32 << 20
#: Shards that a task reads back, unless that makes more tasks than ``MAX_TASKS``; documents of one batch of them.
SHARDS_PER_TASK, MAX_TASKS, READ_ROWS = 4, 50_000, 1 << 16
#: Bits for each key of a level.
SPARSE = 1.6
_NULL = np.int64(-(1 << 63))


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(ids: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    """One number for an id and its occurrence."""
    return _mixed(ids.astype(np.int64).view(np.uint64), 101) + _mixed(occurrences.astype(np.uint64), 102)


class PerfectHash:
    """Slots 0 .. n-1 of n distinct keys."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, parts = [], []
        left = keys
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys repeat")
            m = -(-max(64, int(SPARSE * len(left))) // 64) * 64
            at = (_mixed(left, len(levels)) % np.uint64(m)).astype(np.int64)
            once = np.bincount(at, minlength=m) == 1
            parts.append(np.packbits(once, bitorder="little").view(np.uint64))
            levels.append(m)
            left = left[~once[at]]
        return cls(levels, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that hit no bit."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        base = 0
        for k, m in enumerate(self.levels):
            at = (_mixed(keys[todo], k) % np.uint64(m)).astype(np.int64) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.before[word] + below)[hit]
            todo = todo[~hit]
            base += m
        return out


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_shard(uri: str, ids: list[int | None], payloads: list[bytes], width: int) -> int:
    """Writes documents that are in order; the number of ids."""
    raw = np.array([_NULL if i is None else i for i in ids], np.int64)
    null = np.array([i is None for i in ids])
    occurrence = np.zeros(len(ids), np.uint64)
    same = np.flatnonzero((raw[1:] == raw[:-1]) & (null[1:] == null[:-1])) + 1
    for k in same:
        occurrence[k] = occurrence[k - 1] + 1
    occurrence += null.astype(np.uint64) << np.uint64(62)
    keys = keys_of(raw, occurrence)
    hashed = PerfectHash.build(keys)
    slots = hashed.slots(keys)
    lengths = np.array([len(p) // width for p in payloads], np.uint64)
    by_slot = {"fingerprint": np.zeros(len(ids), "<u4"), "offset": np.zeros(len(ids), "<u8"), "length": np.zeros(len(ids), "<u8")}
    by_slot["fingerprint"][slots] = (_mixed(keys, 900) >> np.uint64(32)).astype("<u4")
    by_slot["offset"][slots] = np.cumsum(lengths) - lengths
    by_slot["length"][slots] = lengths
    arrays = {"bits": hashed.bits.astype("<u8"), **by_slot, "doc_id": raw.astype("<i8"), "occurrence": occurrence.astype("<u8")}
    fs, path = _store(uri)
    draft = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(MAGIC)
        for p in payloads:
            f.write(p)
        at = len(MAGIC) + sum(map(len, payloads))
        places = {}
        for name, a in arrays.items():
            f.write(a.tobytes())
            places[name] = [at, len(a), a.dtype.str]
            at += a.nbytes
        footer = json.dumps({"width": width, "levels": hashed.levels, "arrays": places, "tokens": int(lengths.sum())}).encode()
        f.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
    fs.move(draft, path)
    return int(lengths.sum())


class Shard:
    """Keyed access to one file."""

    def __init__(self, uri: str):
        fs, path = _store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n = int.from_bytes(tail[:4], "little")
        self.footer = json.loads(self.file.read_at(n, size - 12 - n))
        self.width, self.tokens = self.footer["width"], self.footer["tokens"]
        self.hash = PerfectHash(self.footer["levels"], self._array("bits"))
        self.fingerprint, self.offset, self.length = (self._array(x) for x in ("fingerprint", "offset", "length"))

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _array(self, name: str) -> np.ndarray:
        at, n, kind = self.footer["arrays"][name]
        dtype = np.dtype(kind)
        return np.frombuffer(self.file.read_at(n * dtype.itemsize, at), dtype)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids (the least number for null) and occurrences, in document order."""
        return self._array("doc_id"), self._array("occurrence")

    def find(self, ids: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
        """Slots; -1 for keys that the shard doesn't have."""
        keys = keys_of(ids, occurrences)
        slots = self.hash.slots(keys)
        wrong = self.fingerprint[np.maximum(slots, 0)] != (_mixed(keys, 900) >> np.uint64(32)).astype(np.uint32) if len(self.fingerprint) else np.ones(len(slots), bool)
        return np.where(wrong, -1, slots)

    def ids(self, slot: int) -> np.ndarray:
        n = int(self.length[slot])
        raw = self.file.read_at(n * self.width, len(MAGIC) + int(self.offset[slot]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        null = doc_id is None
        slot = self.find(np.array([_NULL if null else doc_id], np.int64), np.array([occurrence + (null << 62)], np.uint64))[0]
        return None if slot < 0 else self.ids(int(slot))


def write(docs: DataFrame, folder: str, end_id: int = END_ID, tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of ``docs`` in ``folder`` (a URI that all executors share).

    Returns their list: part, nth, path, first_id, docs, tokens.  Parts are
    ranges of ids in order; a part of more than ``shard_bytes`` has several shards.
    """
    path = tokenizer or default_path()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        part = TaskContext.get().partitionId()
        fs, at = _store(folder)
        fs.create_dir(at, recursive=True)
        ids: list = []
        payloads: list[bytes] = []
        held, nth = 0, 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:05d}-{nth:05d}.ids"
            tokens = write_shard(uri, ids, payloads, encoder.dtype.itemsize)
            row = {"part": part, "nth": nth, "path": uri, "first_id": ids[0], "docs": len(ids), "tokens": tokens}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = texts_of(batch.column(1)).to_pylist()
            for lo, hi in grouped(texts):
                for doc_id, payload in zip(doc_ids[lo:hi], encoder.encode(texts[lo:hi])):
                    if ids and held + len(payload) > shard_bytes:
                        yield close()
                        ids, payloads, held, nth = [], [], 0, nth + 1
                    ids.append(doc_id)
                    payloads.append(payload + end)
                    held += len(payloads[-1])
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return saved(ordered.mapInArrow(apply, "part int, nth int, path string, first_id long, docs long, tokens long"), "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """Each document in the files, by its key: doc_id, start, n_tokens, ids_crc32, path."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    # one row a range of ids, not a document or a shard
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("tokens").over(before(Window.partitionBy("part").orderBy("nth"))), F.lit(0))
    placed = shards.withColumn("inside", inside).join(parts, "part").select("path", (F.col("part_start") + F.col("inside")).alias("base"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with Shard(path) as shard:
                    ids, occurrences = shard.keys()
                    slots = shard.find(ids, occurrences)
                    if (slots < 0).any():
                        raise ValueError(f"{path}: the index lacks a key")
                    null = (occurrences >> np.uint64(62)) > 0
                    for lo in range(0, len(ids), READ_ROWS):
                        some = slots[lo : lo + READ_ROWS]
                        crcs = [zlib.crc32(shard.ids(s).tobytes()) for s in some.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[lo : lo + READ_ROWS], pa.int64(), mask=null[lo : lo + READ_ROWS]), pa.array(shard.offset[some].astype(np.int64) + base), pa.array(shard.length[some].astype(np.int64)), pa.array(crcs, pa.int64()), pa.array([path] * len(some), pa.string())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "path"],
                        )

    # the list of shards is short, so its size says nothing of the work: the number of tasks is given
    tasks = max(1, min(MAX_TASKS, -(-shards.count() // SHARDS_PER_TASK)))
    return placed.repartition(tasks, "path").mapInArrow(apply, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read(write(docs, fresh_path(spark, "token-files"))).drop("path")
