"""A kept graph: nodes with meta, memberships of media, and edges, as keyed tables that can be added to.

Writes are idempotent: a node, membership or edge that comes again changes
nothing but its times and weight.  Which sites show a medium is a table of
memberships, not a list in the medium's node, so a medium that very many sites
share is no large row; a node's meta has their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumasift.sources.keyed import KeyedTable


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.nodes = KeyedTable(spark, f"{path}/nodes", ["id"], "id string, kind string, sites bigint, first string, last string")
        self.members = KeyedTable(spark, f"{path}/members", ["id", "site"], "id string, site string, first string, last string")
        self.edges = KeyedTable(spark, f"{path}/edges", ["src", "dst", "kind"], "src string, dst string, kind string, weight double, created_at string")

    def add_media(self, seen: DataFrame) -> None:
        """``seen``: kind, key, site, at (text in order of time); rows without key or site take no part."""
        sound = seen.filter((F.coalesce("key", F.lit("")) != "") & (F.coalesce("site", F.lit("")) != ""))
        rows = sound.groupBy(F.concat_ws(":", "kind", "key").alias("id"), F.concat(F.lit("site:"), "site").alias("site")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
        old = self.members.rows().withColumnsRenamed({"first": "old_first", "last": "old_last"})
        both = rows.join(old, ["id", "site"], "left").select("id", "site", F.least("first", "old_first").alias("first"), F.greatest("last", "old_last").alias("last"))
        self.members.upsert(both)
        every = self.members.rows()
        # only nodes that the rows touch are counted anew
        media = every.join(rows.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("sites"), F.min("first").alias("first"), F.max("last").alias("last"))
        sites = every.join(rows.select("site").distinct(), "site", "left_semi").groupBy(F.col("site").alias("id")).agg(F.lit(0).cast("long").alias("sites"), F.min("first").alias("first"), F.max("last").alias("last"))
        self.nodes.upsert(media.unionByName(sites).withColumn("kind", F.substring_index("id", ":", 1)))

    def add_edges(self, edges: DataFrame) -> None:
        """``edges``: src, dst, kind, weight, created_at; of equal ones the largest weight counts, and the first time, also of earlier calls."""
        rows = edges.groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"), F.min("created_at").alias("created_at"))
        old = self.edges.rows().withColumnsRenamed({"weight": "old_weight", "created_at": "old_at"})
        self.edges.upsert(rows.join(old, ["src", "dst", "kind"], "left").select("src", "dst", "kind", F.greatest("weight", "old_weight").alias("weight"), F.least("created_at", "old_at").alias("created_at")))

    def remove_site(self, site: str) -> None:
        """A site, its memberships and its edges; media that it shared stay, with one site less."""
        name = f"site:{site}"
        held = self.members.rows().filter(F.col("site") == name).select("id")
        left = self.nodes.rows().join(held, "id", "left_semi").withColumn("sites", F.col("sites") - 1)
        self.nodes.upsert(left)
        self.members.delete(F.col("site") == name)
        self.nodes.delete(F.col("id") == name)
        self.edges.delete((F.col("src") == name) | (F.col("dst") == name))

    def export(self) -> DataFrame:
        """part (0: nodes, 1: edges) and line (JSON), in order of part and ends when sorted by part and line's key columns a, b, kind."""
        meta = F.when(F.col("kind") == "site", F.struct("first", "last", F.lit(None).cast("long").alias("sites"))).otherwise(F.struct("first", "last", "sites"))
        nodes = self.nodes.rows().select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), "kind", F.to_json(F.struct("id", "kind", meta.alias("meta"))).alias("line"))
        edges = self.edges.rows().select(F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), "kind", F.to_json(F.struct("src", "dst", "kind", "weight", "created_at")).alias("line"))
        return nodes.unionByName(edges)
