"""Helpers that the operators share: scratch tables, split keys, Arrow text access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumasift.scratch import fresh_path, saved, shared_dir

__all__ = ["fresh_path", "saved", "shared_dir"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True where the fold is 1; a null id has no fold and counts as not held out."""
    return F.coalesce(fold_of(doc_id) == 1, F.lit(False))


def texts_of(column: pa.Array) -> pa.Array:
    """A string array without nulls (null counts as empty)."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def letters_only(column: pa.Array) -> pa.Array:
    """Lower-case letters of any script; each run of anything else becomes one blank."""
    low = pc.utf8_lower(texts_of(column))
    return pc.replace_substring_regex(low, pattern=r"[^\p{L}]+", replacement=" ")


def flat(column: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, each after ``pad`` blanks, and where each starts.

    ``pad`` more blanks follow the last text, so that no gram of ``pad + 1``
    bytes that starts in one text reaches letters of another.
    """
    blank = pa.scalar(" " * pad, pa.large_string())
    padded = pc.binary_join_element_wise(blank, column, pa.scalar("", pa.large_string()))
    if isinstance(padded, pa.ChunkedArray):
        padded = padded.combine_chunks()
    padded = pa.concat_arrays([padded, pa.array([" " * pad], pa.large_string())])
    _, offsets, data = padded.buffers()
    n = len(padded)
    starts = np.frombuffer(offsets, dtype=np.int64, count=n + 1)
    data = np.frombuffer(data, dtype=np.uint8, count=int(starts[-1])) if starts[-1] else np.zeros(0, np.uint8)
    return data, starts[:-1]


def windows(starts: np.ndarray, max_docs: int, max_bytes: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, first byte, end byte): few texts, or part of a very long one."""
    n = len(starts) - 1
    i = 0
    while i < n:
        j = min(n, i + max_docs)
        j = max(i + 1, min(j, int(np.searchsorted(starts, starts[i] + max_bytes, side="right")) - 1))
        lo, hi = int(starts[i]), int(starts[j])
        for at in range(lo, hi, max_bytes):
            yield i, j, at, min(hi, at + max_bytes)
        i = j


def gram_hashes(data: np.ndarray, lo: int, hi: int, n: int, bits: int) -> np.ndarray:
    """A ``bits``-bit hash of the n bytes from each position in [lo, hi)."""
    h = np.zeros(hi - lo, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        part = data[lo + k : hi + k]
        h[: len(part)] += part
    h += np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return (h >> np.uint32(32 - bits)).astype(np.int64)
