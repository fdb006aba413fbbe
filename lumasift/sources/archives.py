"""Archives of pictures and manifests (zip) as a data source: ``spark.read.format("picture_archive").load(folder)``.

A row is a member: archive, member, size, width, height, data.  A partition is
some members of one archive.  Comparisons of archive, member, size, width and
height are pushed down: size comes from the archive's directory, width and
height from a member's head, so what they rule out is never unpacked whole.

The folder has to be one that the driver and all executors can open as files (a
shared mount); archives in stores that only Spark reads go through
``readers.manifests`` and the binaryFile source.
"""

from __future__ import annotations

import io
import os
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lumasift.sources.readers import image_size

SCHEMA = "archive string, member string, size long, width int, height int, data binary"
#: Members of a partition, bytes of a member's head, and members of a batch.
MEMBERS, HEAD, AT_ONCE = 500, 4096, 64
#: Lets a source take filters.
PUSHDOWN = {"spark.sql.python.filterPushdown.enabled": "true"}

_HOLDS = {
    EqualTo: lambda x, f: x == f.value,
    In: lambda x, f: x in f.value,
    GreaterThan: lambda x, f: x > f.value,
    GreaterThanOrEqual: lambda x, f: x >= f.value,
    LessThan: lambda x, f: x < f.value,
    LessThanOrEqual: lambda x, f: x <= f.value,
}


class Members(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.filters = folder.removeprefix("file://"), []

    def _keeps(self, name: str, value: object) -> bool:
        """Whether all filters on a column hold; null meets none."""
        own = [f for f in self.filters if f.attribute[0] == name]
        return all(value is not None and _HOLDS[type(f)](value, f) for f in own)

    def partitions(self) -> list[Members]:
        found = []
        for name in sorted(os.listdir(self.folder)):
            if name.lower().endswith(".zip") and self._keeps("archive", name):
                try:
                    with zipfile.ZipFile(os.path.join(self.folder, name)) as z:
                        n = len(z.infolist())
                except zipfile.BadZipFile:
                    continue
                found += [Members(name, at, min(n, at + MEMBERS)) for at in range(0, n, MEMBERS)]
        return found

    def _row(self, z: zipfile.ZipFile, info: zipfile.ZipInfo, archive: str) -> tuple | None:
        if info.is_dir() or not self._keeps("member", info.filename) or not self._keeps("size", info.file_size):
            return None
        with z.open(info) as member:
            head = member.read(HEAD)
            width, height = image_size(head) or (None, None)
            if not self._keeps("width", width) or not self._keeps("height", height):
                return None
            return archive, info.filename, info.file_size, width, height, head + member.read()

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        with zipfile.ZipFile(os.path.join(self.folder, partition.archive)) as z:
            rows = []
            for info in z.infolist()[partition.start : partition.stop]:
                try:
                    row = self._row(z, info, partition.archive)
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
                    continue  # a broken or locked member
                rows += [row] if row else []
                if len(rows) == AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


class _PushedReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = type(f) in _HOLDS and len(f.attribute) == 1 and f.attribute[0] in ("archive", "member", "size", "width", "height")
            if known:
                self.filters.append(f)
            else:
                yield f


class PictureArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "picture_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class PushedArchive(PictureArchive):
    """The same name, where the session allows a source to take filters."""

    def reader(self, schema) -> DataSourceReader:
        return _PushedReader(self.options["path"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the folder's archives; filters are pushed down where PUSHDOWN is set, when this is called and when it runs."""
    pushed = all(spark.conf.get(k, "false") == v for k, v in PUSHDOWN.items())
    spark.dataSource.register(PushedArchive if pushed else PictureArchive)
    return spark.read.format("picture_archive").load(folder)


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray picture as PNG."""
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    h, w = gray.shape
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = gray
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def write_archives(members: DataFrame, folder: str) -> int:
    """Writes members (archive, member, data) as zips below ``folder``: one call an archive; their number."""
    at = folder.removeprefix("file://")
    os.makedirs(at, exist_ok=True)

    def write(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name, data in sorted(zip(rows["member"].to_pylist(), rows["data"].to_pylist())):
                z.writestr(zipfile.ZipInfo(name), data)
        # a task that runs again replaces what it wrote
        draft = os.path.join(at, f".{key[0].as_py()}.{os.getpid()}")
        with open(draft, "wb") as f:
            f.write(held.getvalue())
        os.replace(draft, os.path.join(at, key[0].as_py()))
        return pa.table({"archive": pa.array([key[0].as_py()])})

    return members.select("archive", "member", "data").groupBy("archive").applyInArrow(write, "archive string").count()
