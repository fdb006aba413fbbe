"""Queries on pictures made from embeddings, and on files that queries write and read back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumasift.operators import redteam as A
from lumasift.operators import vision as P
from lumasift.plans.decision import q6
from lumasift.plans.sql_views import with_views
from lumasift.scratch import fresh_path, saved
from lumasift.sources import readers, sinks
from lumasift.sources import views as V


def _pictures(spark, sf):
    """32 x 32 pictures: outer products of an embedding's halves in three tints."""
    emb = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    level = lambda x, k: F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(128 + 30 * k) + x * 400 * (k + 1)))).cast("int").bitwiseOR(F.lit(256)))
    cells = F.flatten(F.transform(F.slice("v", 1, 32), lambda a: F.transform(F.slice("v", 33, 32), lambda b: F.concat(*[F.right(level(a * b * 20, k), F.lit(2)) for k in (2, 1, 0)]))))
    return emb.select("id", F.lit(32).alias("width"), F.lit(32).alias("height"), F.unhex(F.array_join(cells, "")).alias("rgb"))


def skin_scores(spark, sf):
    """Skin heuristic of each picture; tests compare it with a loop over pixels."""
    s = P.skin_scores(_pictures(spark, sf))
    return s.select("id", *[q6(F.col(c)).alias(c) for c in ("skin_ratio", "max_blob", "edge_density", "prob")], "small")


def shape_hashes(spark, sf):
    """Ring hashes, and the best tile against the next picture."""
    h = P.shape_hashes(_pictures(spark, sf))
    nxt = h.select((F.col("id") - 1).alias("id"), F.col("tiles").alias("other"))
    return h.join(nxt, "id", "left").select("id", "ring", "dft_ring", P.tile_any_match(F.col("tiles"), F.col("other")).alias("tile_distance"))


def likeness(spark, sf):
    """Structural similarity of each picture and the next."""
    # saved, as both sides of the join would draw every picture
    p = saved(_pictures(spark, sf), "pictures")
    pairs = p.withColumnRenamed("rgb", "rgb_a").join(p.select((F.col("id") - 1).alias("id"), F.col("rgb").alias("rgb_b")), "id")
    return P.likeness(pairs).select("id", q6(F.col("ssim")).alias("ssim"))


def picture_variants(spark, sf):
    return P.variants(_pictures(spark, sf)).select("id", "tag", "width", "height", "sha256")


def noise_consensus(spark, sf):
    """Majorities of noisy copies, with their certificates."""
    return P.noise_consensus(_pictures(spark, sf), 12.0, copies=24).select("id", "label", "votes", q6(F.col("radius")).alias("radius"))


def _waves(spark, sf, side: int = 64):
    """Pictures of ``side`` pixels whose 64 lowest frequencies are an embedding's numbers, in three tints."""
    wave = np.cos((2 * np.arange(side)[None, :] + 1) * np.arange(8)[:, None] * np.pi / (2 * side))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                c = np.stack([np.resize(np.nan_to_num(np.array(v, float)), 64) for v in part.column(1).to_pylist()]).reshape(-1, 8, 8)
                gray = 128 + 90 * np.tanh(wave.T @ c @ wave)
                rgb = np.clip(np.floor(gray[..., None] * np.array([1.0, 0.9, 0.8]) + 0.5), 0, 255).astype(np.uint8)
                size = pa.array([side] * len(rgb), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), size, size, pa.array([x.tobytes() for x in rgb])], names=["id", "width", "height", "rgb"])

    emb = V.table(spark, sf, "embeddings").filter(F.size("embedding") > 0).select("vec_id", "embedding")
    # pictures cost far more than their rows: one part a core at least
    return emb.repartition(spark.sparkContext.defaultParallelism, "vec_id").mapInArrow(draw, "id long, width int, height int, rgb binary")


def _attacked(spark, sf):
    return saved(A.attacked_hashes(_waves(spark, sf)), "attacked")


def picture_redteam(spark, sf):
    """Recall of every hash kind under every attack at every strength, over all pictures."""
    return A.recall(_attacked(spark, sf)).select("family", "strength", "kind", "n", "hits", q6(F.col("recall")).alias("recall"))


def picture_redteam_weakest(spark, sf):
    """Recall of a family, its lowest, and the first strength that gets a picture past a kind."""
    w = A.weakest(A.recall(_attacked(spark, sf)))
    return w.select("family", "kind", q6(F.col("recall")).alias("recall"), q6(F.col("worst")).alias("worst"), "least")


def picture_redteam_search(spark, sf):
    """Attacked pictures that a search among all originals ties to their own: exact, and by equal bands alone."""
    hashes = _attacked(spark, sf)
    exact, lossy = A.search_recall(hashes), A.search_recall(hashes, bands=8, radius=0)
    return exact.join(lossy.select("family", "strength", F.col("found").alias("banded")), ["family", "strength"])


def list_round_trip(spark, sf):
    """Urls of pages written as a list and read back, with a comment, blanks and repeats."""
    urls = V.table(spark, sf, "pages").select("url")
    path = fresh_path(spark, "urls")
    extra = spark.createDataFrame([("# a list",), ("",), ("ftp://x.y",)], "url string")
    sinks.write_leads(urls.unionByName(extra).unionByName(urls), path)
    valid, rejected = readers.url_list(spark, path)
    return valid.select("url", F.lit("").alias("reason")).unionByName(rejected.select(F.col("line").alias("url"), "reason"))


def json_round_trip(spark, sf):
    """Cost rows written as JSON lines among broken ones: what is read, and how many lines are not."""
    path = fresh_path(spark, "costs")
    rows = V.cost_rows(spark, sf).select("provider", "model", "images", "cost_cents")
    lines = rows.select(F.to_json(F.struct("provider", "model", "images", "cost_cents")).alias("value"))
    lines.unionByName(spark.createDataFrame([("{oops",), ('{"provider": "x"}',)], "value string")).write.text(path)
    good, bad = readers.json_lines_counted(spark, path, "provider string, model string, images long, cost_cents long", ["provider", "images"])
    return good.groupBy("provider").agg(F.count("*").alias("rows"), F.sum("images").alias("images")).crossJoin(bad.agg(F.count("*").alias("bad")))


def csv_round_trip(spark, sf):
    """Entries through the CSV sink, with fixed columns and a byte order mark."""
    path = fresh_path(spark, "csv")
    sinks.write_csv(V.entries(spark, sf).select("id", "status", "agg4"), path, ["id", "status", "verdict", "agg4"])
    return readers.csv_rows(spark, path, "id long, status string, verdict string, agg4 long").select("id", "status", "agg4", F.col("verdict").isNull().alias("empty"))


def cost_sink(spark, sf):
    """The cost table of both groupings, with its totals."""
    rows = V.cost_rows(spark, sf)
    path = fresh_path(spark, "cost-sink")
    part = lambda c: rows.groupBy(F.coalesce(c, F.lit("-")).alias(c)).agg(F.count("*").alias("calls"), F.sum("images").alias("images"))
    sinks.write_costs(part("model"), part("run_id"), path)
    return spark.read.parquet(path)


def exposition_parsed(spark, sf):
    """Counters and gauges through the scraper format and back."""
    e = V.table(spark, sf, "events")
    counts = e.groupBy(F.concat(F.lit("event."), F.col("event_type")).alias("name")).agg(F.count("*").alias("value"))
    gauges = e.groupBy(F.concat(F.lit("top-"), F.col("event_type")).alias("name")).agg(F.max("user_id").alias("value"))
    return sinks.parse_exposition(sinks.exposition(counts, gauges))


def run_report(spark, sf):
    """Lines of a Markdown report of statuses and costs."""
    statuses = V.entries(spark, sf).groupBy("status").agg(F.count("*").alias("n"))
    costs = V.cost_rows(spark, sf).groupBy("provider").agg(F.count("*").alias("calls"), F.sum("images").alias("images"))
    return sinks.markdown_report("Run", {"Statuses": statuses.orderBy("status"), "Costs": costs.orderBy("provider")})


_REPORT = """
, s AS (SELECT status, count(*) AS n FROM entries GROUP BY status), c AS (SELECT provider, count(*) AS calls, CAST(sum(images) AS BIGINT) AS images FROM cost_rows GROUP BY provider),
l AS (SELECT 0 AS a, 0 AS b, '# Run' AS line UNION ALL SELECT 1, 0, '## Statuses' UNION ALL SELECT 1, 1, '| status | n |' UNION ALL SELECT 1, 2, '| --- | --- |' UNION ALL SELECT 1, 2 + row_number() OVER (ORDER BY status), '| ' || status || ' | ' || n || ' |' FROM s
  UNION ALL SELECT 2, 0, '## Costs' UNION ALL SELECT 2, 1, '| provider | calls | images |' UNION ALL SELECT 2, 2, '| --- | --- | --- |' UNION ALL SELECT 2, 2 + row_number() OVER (ORDER BY provider), '| ' || provider || ' | ' || calls || ' | ' || images || ' |' FROM c)
SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS BIGINT) AS nth, line FROM l
"""


QUERIES = {
    "skin_scores": (skin_scores, None),
    "shape_hashes": (shape_hashes, None),
    "likeness": (likeness, None),
    "picture_variants": (picture_variants, None),
    "noise_consensus": (noise_consensus, None),
    "picture_redteam": (picture_redteam, None),
    "picture_redteam_weakest": (picture_redteam_weakest, None),
    "picture_redteam_search": (picture_redteam_search, None),
    "list_round_trip": (list_round_trip, "SELECT DISTINCT url, '' AS reason FROM pages UNION ALL SELECT 'ftp://x.y', 'scheme'"),
    "json_round_trip": (json_round_trip, with_views("SELECT provider, count(*) AS rows, CAST(sum(images) AS BIGINT) AS images, CAST(2 AS BIGINT) AS bad FROM cost_rows GROUP BY provider", "COST_ROWS")),
    "csv_round_trip": (csv_round_trip, with_views("SELECT id, status, agg4, true AS empty FROM entries", "ENTRIES")),
    "cost_sink": (cost_sink, with_views("SELECT key, \"by\", calls, images FROM (SELECT model AS key, 'model' AS \"by\", count(*) AS calls, CAST(sum(images) AS BIGINT) AS images FROM cost_rows GROUP BY 1 UNION ALL SELECT coalesce(run_id, '-'), 'run_id', count(*), CAST(sum(images) AS BIGINT) FROM cost_rows GROUP BY 1 UNION ALL SELECT NULL, 'model', count(*), CAST(sum(images) AS BIGINT) FROM cost_rows UNION ALL SELECT NULL, 'run_id', count(*), CAST(sum(images) AS BIGINT) FROM cost_rows)", "COST_ROWS")),
    "exposition_parsed": (exposition_parsed, "SELECT 'event_' || event_type || '_total' AS name, count(*)::DOUBLE AS value FROM events GROUP BY event_type UNION ALL SELECT 'top_' || event_type, max(user_id)::DOUBLE FROM events GROUP BY event_type"),
    "run_report": (run_report, with_views("", "ENTRIES", "COST_ROWS").strip() + _REPORT),
}
