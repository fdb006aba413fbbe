"""Sinks: lists, reports, keyed tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumasift.functions.text import metric_name

#: Rows of a table in a report.
REPORT_ROWS = 1000


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header; with ``columns`` these only, in order, empty where ``df`` lacks one, and the header behind a byte order mark."""
    if columns is None:
        df.write.mode("overwrite").csv(path, header=True)
        return
    made = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])
    made.withColumnRenamed(columns[0], "\ufeff" + columns[0]).write.mode("overwrite").csv(path, header=True)


def write_archive(df: DataFrame, path: str) -> None:
    """JSON lines as an archive's new content: a folder of its own, which a pointer file names once it is whole.

    The pointer is replaced in one step, so read_archive() meets the old content
    or the new one; the old folder stays for readers that are at it, and goes with
    the write after the next.
    """
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = jvm.Path(path)
    fs = top.getFileSystem(conf)
    fs.mkdirs(top)
    kept = [p.split("/")[-1] for p in (_archived(spark, path),) if p]
    folder = uuid.uuid4().hex
    df.write.json(f"{path}/{folder}")
    draft = jvm.Path(f"{path}/CURRENT.{folder}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    rename = getattr(jvm, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), conf).rename(draft, jvm.Path(f"{path}/CURRENT"), over)
    for status in fs.listStatus(top):
        if status.isDirectory() and status.getPath().getName() not in (folder, *kept):
            fs.delete(status.getPath(), True)


def _archived(spark: SparkSession, path: str) -> str | None:
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    pointer = of(f"{path}/CURRENT")
    if not pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return f"{path}/{spark.read.option('wholetext', True).text(str(pointer.toString())).first()[0].strip()}"


def read_archive(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What write_archive() wrote last."""
    folder = _archived(spark, path)
    if folder is None:
        raise FileNotFoundError(path)
    return (spark.read.schema(schema) if schema else spark.read).json(folder)


def markdown_report(title: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Lines (nth, line) of a report with a table for each small, ordered DataFrame.

    A report is for people to read: tables of more than ``REPORT_ROWS`` rows are an error.
    """
    lines = [f"# {title}"]
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        rows = df.limit(REPORT_ROWS + 1).collect()
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"{name} has more than {REPORT_ROWS} rows")
        row = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
        lines += [f"## {name}", row(df.columns), row(["---"] * len(df.columns)), *map(row, rows)]
    return spark.createDataFrame(list(enumerate(lines)), "nth long, line string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_leads(urls: DataFrame, path: str) -> None:
    """One url a line."""
    urls.select(F.col("url").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_costs(by_model: DataFrame, by_run: DataFrame, path: str) -> None:
    """Cost rows by model and by run (calls, images), and their totals (key null), as one Parquet table."""
    parts = [by_model.withColumnRenamed("model", "key").withColumn("by", F.lit("model")), by_run.withColumnRenamed("run_id", "key").withColumn("by", F.lit("run_id"))]
    rows = parts[0].unionByName(parts[1])
    sums = [c for c in rows.columns if c not in ("key", "by")]
    totals = rows.groupBy("by").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("key", F.lit(None).cast("string"))
    rows.unionByName(totals).write.mode("overwrite").parquet(path)


def exposition(counters: DataFrame, gauges: DataFrame) -> DataFrame:
    """Lines (name, value) of counters and gauges in the text format for scrapers."""
    line = lambda df, suffix: df.select(F.concat(metric_name(F.col("name")), F.lit(suffix + " "), F.col("value").cast("string")).alias("line"))
    return line(counters, "_total").unionByName(line(gauges, ""))


def parse_exposition(lines: DataFrame) -> DataFrame:
    """The inverse: (name, value) of each line that isn't a comment."""
    rows = lines.filter(~F.col("line").startswith("#"))
    return rows.select(F.regexp_extract("line", r"^([a-zA-Z_:][a-zA-Z0-9_:]*)", 1).alias("name"), F.regexp_extract("line", r"\s(\S+)$", 1).try_cast("double").alias("value"))


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row written of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def upsert(spark: SparkSession, path: str, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a keyed table of versions.

    Each batch replaces its own folder, so a batch that is run again changes
    nothing; read_upserted() shows the latest version of each key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], order: str) -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"), keys, order)
