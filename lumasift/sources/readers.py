"""Readers of url lists, JSON lines, score files, watchlists and Markdown corpora."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumasift.functions import url as U
from lumasift.operators.grouping import first_seen

#: Headers that name the url column of a CSV list.
URL_HEADERS = ("url", "网址", "链接")


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos): lines of a text file without blanks and comments, the first of equal ones."""
    raw = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("pos"))
    return first_seen(raw.filter((F.col("line") != "") & ~F.col("line").startswith("#")), "line", "pos")


def csv_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos) of the column whose header is a known name; a byte order mark is dropped."""
    rows = spark.read.csv(path, header=True)
    named = {c.replace("﻿", "").strip().lower(): c for c in rows.columns}
    found = next((named[h] for h in URL_HEADERS if h in named), None)
    if found is None:
        raise ValueError(f"{path} has no column named one of {', '.join(URL_HEADERS)}")
    lines = rows.select(F.trim(F.col(f"`{found}`")).alias("line"), F.monotonically_increasing_id().alias("pos")).filter(F.col("line") != "")
    return first_seen(lines, "line", "pos")


def yaml_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos) of a YAML list of texts, alone or below ``urls:``; other shapes are an error.

    Plain scalars, one ``- item`` a line, quoted or not; comments are left out.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("pos", "line"))
    bare = rows.select("pos", F.regexp_replace("line", r"\s+#.*$|^#.*$", "").alias("line")).filter(F.trim("line") != "")
    item = F.regexp_extract("line", r"^\s*-\s+(.*?)\s*$", 1)
    clean = F.regexp_replace(item, r"^([\"'])(.*)\1$", "$2")
    known = bare.withColumn("item", clean).withColumn("kind", F.when(F.col("line").rlike(r"^\s*-\s+"), "item").when(F.col("line").rlike(r"^urls:\s*$"), "head").otherwise("other"))
    odd = known.filter(F.col("kind") == "other").select("line").take(1)
    if odd:
        raise ValueError(f"{path} is no list of urls: {odd[0]['line']}")
    return first_seen(known.filter(F.col("kind") == "item").select(F.col("item").alias("line"), F.col("pos").cast("long").alias("pos")), "line", "pos")


def url_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid urls (url, pos), the first of equal ones, and rejected lines (line, reason), of a text, CSV or YAML file by its name."""
    name = path.lower()
    lines = csv_list(spark, path) if name.endswith(".csv") else yaml_list(spark, path) if name.endswith((".yaml", ".yml")) else text_list(spark, path)
    made = lines.withColumn("x", U.normalised(F.col("line")))
    valid = first_seen(made.filter(F.col("x.reason").isNull()).select(F.col("x.url").alias("url"), "pos"), "url", "pos")
    return valid, made.filter(F.col("x.reason").isNotNull()).select("line", F.col("x.reason").alias("reason"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header, by position; a byte order mark in the header doesn't matter."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """(url, note, enabled): a plain list, or ``- url:`` items with note and enabled lines below them; each file for itself."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("pos", "line"))
    clean = lines.withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    item = F.regexp_extract("line", r"^(?:-\s*)?(?:url:\s*)?[\"']?(https?://[^\s\"']+)", 1)
    # a watchlist is a short file that a person keeps
    of = F.last(F.when(item != "", F.col("pos")), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    field = lambda name: F.max(F.nullif(F.regexp_extract("line", rf"^{name}:\s*[\"']?(.*?)[\"']?$", 1), F.lit("")))
    return clean.withColumn("item", of).filter(F.col("item").isNotNull()).groupBy("file", "item").agg(F.max(F.nullif(item, F.lit(""))).alias("url"), F.coalesce(field("note"), F.lit("")).alias("note"), (F.coalesce(F.lower(field("enabled")), F.lit("true")) != "false").alias("enabled")).select("url", "note", "enabled")


def keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos): lower-cased words of a keyword file without comments, the first of equal ones."""
    words = text_list(spark, path).select(F.lower("line").alias("word"), "pos")
    return first_seen(words, "word", "pos")


def template_file(spark: SparkSession, path: str, needs: Sequence[str] = ()) -> DataFrame:
    """(file, text, slots): whole templates and the ``{slots}`` that they have; one that lacks a needed slot is an error."""
    made = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"), F.array_distinct(F.regexp_extract_all("value", F.lit(r"\{([a-z_]+)\}"), F.lit(1))).alias("slots"))
    for name in needs:
        if made.filter(~F.array_contains("slots", name)).take(1):
            raise ValueError(f"a template of {path} lacks {{{name}}}")
    return made


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False, needs: Sequence[str] = ()) -> DataFrame:
    """Rows of a JSON lines file; bad lines are an error with their number if ``strict``, else they are left out, like rows that lack what they need."""
    good, bad = json_lines_counted(spark, path, schema, needs)
    if strict:
        first = bad.orderBy("file", "nth").select("file", "nth").head(1)
        if first:
            raise ValueError(f"{first[0]['file']}, line {first[0]['nth']}: no sound record")
    return good


def json_lines_counted(spark: SparkSession, path: str, schema: T.StructType | str, needs: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and (file, nth, line) of lines that can't be read or lack what they need.

    Files are read by line, and in one piece only to number lines that are wrong.
    """
    parsed = lambda line: F.from_json(line, schema, {"mode": "PERMISSIVE"})

    def sound(x: Column, line: Column) -> Column:
        whole = F.schema_of_variant(F.try_parse_json(line)).isNotNull()
        for name in needs:
            whole = whole & x[name].isNotNull()
        return F.coalesce(whole & x.isNotNull(), F.lit(False))

    lines = spark.read.text(path).filter(F.trim("value") != "")
    good = lines.withColumn("x", parsed(F.col("value"))).filter(sound(F.col("x"), F.col("value"))).select("x.*")
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("nth", "line"))
    bad = whole.filter(F.trim("line") != "").withColumn("x", parsed(F.col("line"))).filter(~sound(F.col("x"), F.col("line"))).select("file", (F.col("nth") + 1).alias("nth"), "line")
    return good, bad


def score_file(spark: SparkSession, path: str) -> DataFrame:
    """(model, sha256, nsfw_prob, error) of JSON lines behind a ``# model=`` line, each file with its own model."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    model = lines.filter(F.col("value").startswith("#")).groupBy("file").agg(F.max(F.nullif(F.regexp_extract("value", r"model=(\S+)", 1), F.lit(""))).alias("model"))
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("file", F.from_json("value", "sha256 string, nsfw_prob double, error string").alias("x"))
    return rows.filter(F.col("x.sha256").isNotNull()).join(model, "file", "left").select("model", "x.*")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(file, report): the report of each manifest.json, in a folder or in a zip (at its root, or in its only folder).

    A manifest is the report itself or holds it below ``report``; broken files and zips are left out.
    """

    def of(name: str, data: bytes) -> str | None:
        if not name.lower().endswith(".zip"):
            return data.decode("utf-8", "replace")
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = [n for n in z.namelist() if n == "manifest.json"] or [n for n in z.namelist() if n.count("/") == 1 and n.endswith("/manifest.json")]
                return z.read(names[0]).decode("utf-8") if len(names) == 1 else None
        except (zipfile.BadZipFile, RuntimeError, OSError, UnicodeDecodeError):
            return None

    def apply(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([of(name, batch.column(1)[k].as_py())], pa.string())], names=["file", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").filter(F.col("path").rlike(r"(?i)(/manifest\.json|\.zip)$"))
    text = files.mapInArrow(apply, "file string, text string")
    report = F.coalesce(F.get_json_object("text", "$.report"), F.when(F.get_json_object("text", "$.site_url").isNotNull(), F.col("text")))
    return text.select("file", report.alias("report")).filter(F.col("report").isNotNull())


def markdown_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, title, text, snippet) of the ``##`` sections of Markdown files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"(?m)^## +").alias("parts"))
    chunks = files.select("file", F.posexplode("parts").alias("nth", "part")).filter(F.col("nth") > 0)
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    title, text = bare(F.substring_index("part", "\n", 1)), bare(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    return chunks.select("file", "nth", title.alias("title"), text.alias("text"), F.left(F.regexp_replace(text, r"\s+", " "), F.lit(80)).alias("snippet"))


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, GIF, JPEG or WebP file; None if it is none of these."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8 " and data[23:26] == b"\x9d\x01\x2a" and len(data) >= 30:
        return int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and len(data) >= 25 and data[20] == 0x2F:
        packed = int.from_bytes(data[21:25], "little")
        return (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1
    if data[4:8] == b"ftyp" and (at := data.find(b"ispe")) > 0 and len(data) >= at + 16:
        return int.from_bytes(data[at + 8 : at + 12], "big"), int.from_bytes(data[at + 12 : at + 16], "big")
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if kind in (0xC0, 0xC1, 0xC2, 0xC3):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def image_sizes(files: DataFrame) -> DataFrame:
    """path, width, height of rows of the binaryFile source; null where no size is found."""

    def apply(batches):
        for batch in batches:
            found = [image_size(x) or (None, None) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int32())], names=["path", "width", "height"])

    return files.select("path", "content").mapInArrow(apply, "path string, width int, height int")
