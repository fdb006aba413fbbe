"""Queries that write a table's rows as files of some kind and read them back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumasift.functions import text as T
from lumasift.plans.sql_views import with_views
from lumasift.scratch import fresh_path
from lumasift.sources import archives as Z
from lumasift.sources import readers, sinks
from lumasift.sources import views as V


def csv_url_list(spark, sf):
    """Urls of a CSV list with a named column, twice each, among other columns."""
    urls = V.table(spark, sf, "pages").select(F.col("page_id").alias("编号"), F.col("url").alias("网址"), F.lit("a, b").alias("note"))
    path = fresh_path(spark, "urls") + ".csv"
    urls.unionByName(urls).write.csv(path, header=True)
    return readers.url_list(spark, path)[0].select("url")


def yaml_url_list(spark, sf):
    """Urls of a YAML list, quoted or not, with comments."""
    url = F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat(F.lit('"'), "url", F.lit('"'))).otherwise(F.col("url"))
    path = fresh_path(spark, "urls") + ".yaml"
    V.table(spark, sf, "pages").select(F.concat(F.lit("  - "), url, F.when(F.pmod("page_id", F.lit(3)) == 0, "   # seen").otherwise("")).alias("value")).write.text(path)
    return readers.url_list(spark, path)[0].select("url")


def watchlist_items(spark, sf):
    """Watched urls with notes, some of them switched off."""
    path = fresh_path(spark, "watch")
    off = F.when(F.pmod("page_id", F.lit(3)) == 0, "\n  enabled: False").otherwise("")
    V.table(spark, sf, "pages").select(F.concat(F.lit("- url: "), "url", F.lit("\n  note: 'n"), F.col("page_id").cast("string"), F.lit("'"), off, F.lit("\n# next")).alias("value")).write.text(path)
    return readers.watchlist(spark, path)


def keyword_words(spark, sf):
    """Words of a keyword file: comments and blanks go, the first of equal ones stays."""
    path = fresh_path(spark, "words")
    words = V.table(spark, sf, "part").select(F.upper("p_name").alias("value"))
    words.unionByName(words).unionByName(words.limit(1).select(F.lit("# none").alias("value"))).write.text(path)
    return readers.keyword_file(spark, path).select("word")


def template_slots(spark, sf):
    """Whole templates with the slots that they need."""
    path = fresh_path(spark, "templates")
    V.table(spark, sf, "nation").select(F.concat(F.lit("{site}: "), "n_name", F.when(F.pmod("n_nationkey", F.lit(2)) == 0, " {reason}").otherwise("")).alias("value"), "n_nationkey").repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = readers.template_file(spark, path, ["site"])
    return found.select(F.regexp_replace("text", r"\s+$", "").alias("text"), F.size("slots").alias("slots"))


def strict_json(spark, sf):
    """JSON lines written in two appends and read without leave to be broken."""
    path = fresh_path(spark, "strict")
    rows = V.cost_rows(spark, sf).select("provider", "images", "cost_cents")
    for k in (0, 1):
        sinks.write_json(rows.filter(F.pmod("images", F.lit(2)) == k), path)
    read = readers.json_lines(spark, path, "provider string, images long, cost_cents long", strict=True, needs=["provider"])
    return read.groupBy("provider").agg(F.count("*").alias("rows"), F.sum("images").alias("images"), F.sum("cost_cents").alias("cents"))


def score_files(spark, sf):
    """Scores of several models, a head line with the model in each file."""
    path = fresh_path(spark, "scores")
    rows = V.image_score(spark, sf).select(F.col("model").alias("of"), F.pmod("seq", F.lit(4)).alias("part"), F.to_json(F.struct(F.sha2(F.col("seq").cast("string"), 256).alias("sha256"), (F.col("p4") / 8192.0).alias("nsfw_prob"))).alias("value"))
    heads = rows.select("of", "part").distinct().withColumn("value", F.concat(F.lit("# model="), "of", F.lit(" v2")))
    rows.unionByName(heads).repartition(8, "of", "part").write.partitionBy("of", "part").text(path)
    read = readers.score_file(spark, path)
    return read.groupBy("model").agg(F.count("*").alias("rows"), F.count_distinct("sha256").alias("images"), F.sum("nsfw_prob").alias("total"))


def _files(spark, sf):
    """path, content of PNG pictures of many sizes, and of texts."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [b"no picture" if i % 9 == 0 else Z.png(np.zeros((1 + i % 31, 1 + i % 53), np.uint8)) for i in ids]
            yield pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in ids], "content": made})

    return V.table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id")).mapInArrow(draw, "path string, content binary")


def image_sizes(spark, sf):
    """Widths and heights from the heads of files; -1 where there is no picture."""
    found = readers.image_sizes(_files(spark, sf))
    return found.select("path", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("width", "height")])


def manifest_reports(spark, sf):
    """Reports of the manifests in archives, at their root or below ``report``."""
    folder = fresh_path(spark, "manifests")
    sites = V.table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("site")).agg(F.count("*").alias("n"))
    report = F.struct(F.concat(F.lit("https://s"), F.col("site").cast("string")).alias("site_url"), F.col("n").alias("n"))
    text = F.when(F.col("site") % 2 == 0, F.to_json(report)).otherwise(F.to_json(F.struct(report.alias("report"))))
    Z.write_archives(sites.select(F.concat(F.lit("s"), F.col("site").cast("string"), F.lit(".zip")).alias("archive"), F.when(F.col("site") % 3 == 0, "run/manifest.json").otherwise("manifest.json").alias("member"), text.cast("binary").alias("data")), folder)
    found = readers.manifests(spark, folder)
    return found.select(F.get_json_object("report", "$.site_url").alias("site_url"), F.get_json_object("report", "$.n").cast("long").alias("n"))


def markdown_sections(spark, sf):
    """Sections of Markdown files, with the beginning of each."""
    path = fresh_path(spark, "markdown")
    V.table(spark, sf, "benchmark").select(F.concat(F.lit("## item "), F.col("item_id").cast("string"), F.lit("\n\n"), "text", F.lit("\n")).alias("value")).write.text(path)
    return readers.markdown_chunks(spark, path).select("title", F.sha2("text", 256).alias("text_sha256"), "snippet")


def iso_times(spark, sf):
    """Times in six ISO forms, as microseconds of UTC."""
    ts = F.col("ts").cast("timestamp")
    form = lambda pattern: F.date_format(ts, pattern)
    east = F.concat(F.date_format(ts + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00"))
    forms = [form("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.concat(form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), east, F.regexp_replace(east, ":(?=00$)", ""), form("yyyyMMdd'T'HHmmss"), form("yyyy-MM-dd")]
    kind = F.pmod("event_id", F.lit(6))
    text = F.coalesce(*[F.when(kind == k, x) for k, x in enumerate(forms)])
    e = V.table(spark, sf, "events").select("event_id", text.alias("text"))
    return e.select("event_id", F.unix_micros(T.iso_utc(F.col("text"))).alias("micros"), T.iso_utc(F.concat("text", F.lit("x"))).isNull().alias("odd"))


_SECTIONS = r"""
SELECT 'item ' || item_id AS title, sha256(trim(text)) AS text_sha256, left(regexp_replace(trim(text), '\s+', ' ', 'g'), 80) AS snippet FROM benchmark
"""
_TIMES = """
SELECT event_id, epoch_us(CASE event_id % 6 WHEN 4 THEN date_trunc('second', ts) WHEN 5 THEN date_trunc('day', ts) ELSE ts END) AS micros, true AS odd FROM events
"""

QUERIES = {
    "csv_url_list": (csv_url_list, "SELECT DISTINCT url FROM pages"),
    "yaml_url_list": (yaml_url_list, "SELECT DISTINCT url FROM pages"),
    "watchlist_items": (watchlist_items, "SELECT url, 'n' || page_id AS note, page_id % 3 <> 0 AS enabled FROM pages"),
    "keyword_words": (keyword_words, "SELECT DISTINCT lower(p_name) AS word FROM part"),
    "template_slots": (template_slots, "SELECT '{site}: ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' {reason}' ELSE '' END AS text, CAST(1 + (n_nationkey % 2 = 0)::INTEGER AS INTEGER) AS slots FROM nation"),
    "strict_json": (strict_json, with_views("SELECT provider, count(*) AS rows, CAST(sum(images) AS BIGINT) AS images, CAST(sum(cost_cents) AS BIGINT) AS cents FROM cost_rows GROUP BY provider", "COST_ROWS")),
    "score_files": (score_files, with_views("SELECT model, count(*) AS rows, count(*) AS images, sum(p4)::DOUBLE / 8192.0::DOUBLE AS total FROM image_score GROUP BY model", "IMAGE_SCORE")),
    "image_sizes": (image_sizes, "SELECT 'f' || vec_id AS path, CASE WHEN vec_id % 9 <> 0 THEN CAST(1 + vec_id % 53 AS INTEGER) ELSE -1 END AS width, CASE WHEN vec_id % 9 <> 0 THEN CAST(1 + vec_id % 31 AS INTEGER) ELSE -1 END AS height FROM embeddings"),
    "manifest_reports": (manifest_reports, "SELECT 'https://s' || (user_id % 40) AS site_url, count(*) AS n FROM events GROUP BY 1"),
    "markdown_sections": (markdown_sections, _SECTIONS),
    "iso_times": (iso_times, _TIMES),
}
