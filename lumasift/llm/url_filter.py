"""URL filter: a broadcast trie over reversed host labels and path pieces.

The longest fitting rule decides: more host labels first, then the longer
path.  A rule fits its host and every subdomain, if the url's path starts with
the rule's path.  Blocks and allowances are entries of the same trie.

Rules of at most ``MAX_TRIE_BYTES`` in all make one trie, which each worker
builds once from a broadcast.  More rules are a table: each distinct url asks
for its host suffixes with the beginnings of its path, in the lengths that rules
have, by an equi-join, and the best answer counts.

Defined results: a null url, or one without ``://``, has an empty host and
path and fits no rule; a url that no rule fits gets the default verdict; of two
equal rules the last one given holds; rows that repeat are judged each; an empty
table gives no rows.  Extra columns pass through untouched; an output name that
the input has already is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumasift.llm.common import saved

#: Bytes of rule text that are broadcast; more rules are joined.
MAX_TRIE_BYTES = 4 << 20

_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    m = _URL.match(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class Trie:
    """Nodes are dicts.  Host labels lead from the top domain inwards, then whole
    path segments; a rule ends at a node as the beginning of the next segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(("host", label), {})
            node = node.setdefault("paths", {})
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            node.setdefault("ends", {})[rest] = rule
            node.setdefault("lengths", set()).add(len(rest))

    def find(self, host: str, path: str) -> Rule | None:
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            found = self._below(node.get("paths"), path) or found
        return found

    @staticmethod
    def _below(node: dict | None, path: str) -> Rule | None:
        found, pieces = None, path.split("/")
        for i, piece in enumerate(pieces):
            if node is None:
                break
            # one look-up for each length that ends have here
            fits = [n for n in node.get("lengths", ()) if n <= len(piece) and piece[:n] in node["ends"]]
            if fits:
                found = node["ends"][piece[: max(fits)]]
            if i + 1 < len(pieces):
                node = node.get(("segment", piece))
        return found


#: The trie that this worker built last, with the token of its broadcast.
_built: dict[str, Trie] = {}


def _trie(token: str, rules: Iterable[Rule]) -> Trie:
    if token not in _built:
        _built.clear()
        _built[token] = Trie(rules)
    return _built[token]


NAMES = ("host", "path", "rule", "verdict")


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url_col: str = "url", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Up to ``max_trie_bytes`` of rules it is narrow: one pass over the rows, no
    shuffle, so a hot host costs nothing extra.  Beyond that see judge_by_join().
    """
    spark = pages.sparkSession
    if sum(len(r.host) + len(r.path) for r in rules) > max_trie_bytes:
        table = spark.createDataFrame([(*r, k) for k, r in enumerate(rules)], "host string, path string, verdict string, nth long")
        return judge_by_join(pages, table, default, url_col)
    shared, token = spark.sparkContext.broadcast(list(rules)), uuid.uuid4().hex
    base = pages.drop(*[n for n in NAMES if n != url_col])
    kept = [f for f in base.schema.fields if f.name not in NAMES]
    schema = T.StructType(kept + [T.StructField(n, T.StringType()) for n in NAMES])
    own = [f.name for f in kept]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, tuple] = {}
        for batch in batches:
            trie = _trie(token, shared.value)
            rows = []
            for url in batch.column(batch.schema.get_field_index(url_col)).to_pylist():
                key = split_url(url)
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    best = trie.find(*key)
                    seen[key] = (best.host + best.path, best.verdict) if best else (None, default)
                rows.append((*key, *seen[key]))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in own]
            found = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(list(c), pa.string()) for c in found], names=own + list(NAMES))

    return base.mapInArrow(apply, schema)


def host_of(url: Column) -> Column:
    """As split_url() has it."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """As judge(), with rules (host, path, verdict, nth) as a table of any size; of equal rules the greatest nth holds.

    Only distinct pairs of host and path are judged.  Each asks once for each
    host suffix and each length of path that its rules could have, so no url
    meets all rules of a host.  Both joins are on equal keys, and the tables
    joined are written, so that hot keys can be split or broadcast.
    """
    last = rules.groupBy("host", "path").agg(F.max_by("verdict", "nth").alias("verdict"))
    last = saved(last, "url-rules")
    lengths = F.broadcast(last.agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths")))  # one row
    base = pages.drop(*[n for n in NAMES if n != url_col])
    placed = base.withColumns({"__host": F.coalesce(host_of(F.col(url_col)), F.lit("")), "__path": F.coalesce(path_of(F.col(url_col)), F.lit(""))})
    asked = placed.select("__host", "__path").distinct().crossJoin(lengths)
    labels = F.split("__host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct((F.size(labels) - k).alias("labels"), F.concat_ws(".", F.slice(labels, k, F.size(labels))).alias("host")))
    beginning = F.transform(F.filter("lengths", lambda n: n <= F.length("__path")), lambda n: F.substr("__path", F.lit(1), n))
    keys = asked.select("__host", "__path", F.explode(suffix).alias("s"), "lengths").select("__host", "__path", "s", F.explode(beginning).alias("path"))
    met = keys.select("__host", "__path", F.col("s.labels").alias("labels"), F.col("s.host").alias("host"), "path").join(last, ["host", "path"])
    best = met.groupBy("__host", "__path").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct("labels", F.length("path"))).alias("best"))
    best = saved(best, "url-verdicts")
    own = [F.col(n) for n in base.columns if n not in NAMES]
    return placed.join(best, ["__host", "__path"], "left").select(*own, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of query op10.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT page_id, host, path,
         CASE
           WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
           WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
           WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
           WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
         END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
