"""A keyed table with updates and deletes, as versions of rows in Parquet.

A commit is a folder of rows, each a new version of its key or a tombstone, and
a numbered entry of the log that lists the folders which count.  Readers take
the last entry, so they meet all of a commit or nothing of it, and what they
began to read stays where it is until vacuum().  A number is claimed by creating
a file that must not exist, so of two writers one has to try again.  compact()
writes the rows of now as one folder and logs that alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION, GONE = "__version", "__gone"


class Conflict(RuntimeError):
    """Another writer took the commit's number, or a key that had to be new exists."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType | str):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        jvm = spark.sparkContext._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._of(f"{self.path}/_log"))

    # -- log ----------------------------------------------------------------------------------

    def _entries(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._of(f"{self.path}/_log"))]
        return sorted(int(n[:20]) for n in names if n.endswith(".json"))

    def _entry(self, version: int) -> list[str]:
        if not version:
            return []
        found = self.spark.read.option("wholetext", True).text(f"{self.path}/_log/{version:020d}.json").first()[0]
        return json.loads(found)

    def version(self) -> int:
        """The last commit; 0 before the first."""
        return max(self._entries(), default=0)

    def _log(self, version: int, folders: list[str]) -> None:
        claim, draft = (self._of(f"{self.path}/_log/{version:020d}.{end}") for end in ("claim", uuid.uuid4().hex))
        try:
            self._fs.create(claim, False).close()
        except Exception as taken:
            raise Conflict(f"commit {version} of {self.path} is taken") from taken
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not self._fs.rename(draft, self._of(f"{self.path}/_log/{version:020d}.json")):
            raise Conflict(f"commit {version} of {self.path} can't be logged")

    def _commit(self, rows: DataFrame, based_on: int) -> int:
        """Rows with GONE as the version after ``based_on``."""
        if based_on != self.version():
            raise Conflict(f"{self.path} has moved on from commit {based_on}")
        version, folder = based_on + 1, uuid.uuid4().hex
        names = [f.name for f in self.schema]
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(version).cast("long").alias(VERSION), GONE).select(*names, VERSION, GONE).write.parquet(f"{self.path}/{folder}")
        self._log(version, [*self._entry(based_on), folder])
        return version

    # -- reading ------------------------------------------------------------------------------

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as of a commit (default: the last)."""
        wide = T.StructType([*self.schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(GONE, T.BooleanType())])
        folders = self._entry(self.version() if version is None else version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        every = self.spark.read.schema(wide).parquet(*[f"{self.path}/{f}" for f in folders])
        rest = [f.name for f in self.schema if f.name not in self.keys]
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, GONE), VERSION).alias("last"))
        return last.filter(~F.col(f"last.{GONE}")).select(*[F.col(f.name) if f.name in self.keys else F.col(f"last.{f.name}").alias(f.name) for f in self.schema])

    def get(self, **key: object) -> DataFrame:
        """The row of a key, or none; the filter reaches the files."""
        if set(key) != set(self.keys):
            raise ValueError(f"a key is {self.keys}")
        return self.list(**key)

    def list(self, order: Sequence[str] = (), limit: int | None = None, offset: int = 0, **equal: object) -> DataFrame:
        """Rows whose columns equal what is given (None: null), in order of columns (``-name``: falling)."""
        found = self.rows()
        for name, value in equal.items():
            found = found.filter(F.col(name).eqNullSafe(F.lit(value)))
        if order:
            found = found.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order])
        found = found.offset(offset) if offset else found
        return found if limit is None else found.limit(limit)

    # -- writing ------------------------------------------------------------------------------

    def insert(self, rows: DataFrame) -> int:
        """New keys only: one that is there already, or comes twice, is a Conflict and nothing is written."""
        at = self.version()
        twice = rows.groupBy(*self.keys).count().filter("count > 1").select(*self.keys)
        there = rows.select(*self.keys).join(self.rows(at).select(*[F.col(k).alias(f"__{k}") for k in self.keys]), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_semi")
        if clash := twice.unionByName(there).take(1):
            raise Conflict(f"key {tuple(clash[0])} exists")
        return self._commit(rows.withColumn(GONE, F.lit(False)), at)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows take the place of those of their keys; of several of a key the last by ``order`` counts."""
        if order:
            rest = [c for c in rows.columns if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*self.keys, *[F.col(f"last.{c}").alias(c) for c in rest])
        elif rows.groupBy(*self.keys).count().filter("count > 1").take(1):
            raise Conflict("a key comes twice, and no order is given")
        return self._commit(rows.withColumn(GONE, F.lit(False)), self.version())

    def update(self, values: Mapping[str, Column], where: Column) -> int:
        """Columns that aren't keys of the rows that meet a condition."""
        if set(values) & set(self.keys):
            raise ValueError("keys can't be updated")
        at = self.version()
        return self._commit(self.rows(at).filter(where).withColumns(dict(values)).withColumn(GONE, F.lit(False)), at)

    def delete(self, where: Column) -> int:
        at = self.version()
        return self._commit(self.rows(at).filter(where).withColumn(GONE, F.lit(True)), at)

    def compact(self) -> int:
        """The rows of now as one folder; older commits can still be read until vacuum()."""
        at, folder = self.version(), uuid.uuid4().hex
        self.rows(at).withColumns({VERSION: F.lit(at + 1).cast("long"), GONE: F.lit(False)}).write.parquet(f"{self.path}/{folder}")
        self._log(at + 1, [folder])
        return at + 1

    def vacuum(self, keep: int = 1) -> None:
        """Drops all but the last ``keep`` entries, and folders that none of these lists."""
        kept = self._entries()[-max(1, keep) :]
        wanted = {f for v in kept for f in self._entry(v)}
        for v in self._entries():
            if v not in kept:
                self._fs.delete(self._of(f"{self.path}/_log/{v:020d}.json"), False)
        for status in self._fs.listStatus(self._of(self.path)):
            name = status.getPath().getName()
            if name != "_log" and name not in wanted:
                self._fs.delete(status.getPath(), True)
