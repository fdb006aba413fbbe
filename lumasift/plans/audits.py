"""Queries on append-only logs: verification, checkpoints, canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumasift.operators import audit as A
from lumasift.operators import records as R
from lumasift.plans.sql_views import with_views
from lumasift.scratch import saved
from lumasift.sources import views as V

_KEY = b"reviewers"


def _record(note: Column | None = None) -> Column:
    return F.struct(F.col("entry_id").alias("entry_id"), F.col("event_type").alias("event"), F.col("seq").alias("seq"), F.col("actor").alias("actor"), (F.col("note") if note is None else note).alias("note"))


def _made_log(spark, sf) -> DataFrame:
    """(nth, line): the ledger as a log.

    Of every 64 events the last 4 are degraded, the first 3 of all come from
    before the tree; every 7th is followed by a signed checkpoint.  Then a third of the
    segments loses its peace: an event's note is altered near the end; in a fifth
    a leaf is taken out, and in a seventh a blank line stands.
    """
    e = V.ledger(spark, sf).select("seq", "entry_id", "event_type", "actor", "note")
    first = e.select((F.col("seq") - 1).alias("seq"), F.col("seq").alias("own"), "entry_id", "event_type", "actor", "note").limit(0)
    numbered = R.append(first, e.withColumn("own", F.col("seq")).drop("seq"), "own").select(F.col("seq").alias("j"), F.col("own").alias("seq"), "entry_id", "event_type", "actor", "note")
    part, place = F.floor((F.col("j") - 1) / 64), F.pmod(F.col("j") - 1, F.lit(64))
    leaf = A.leaf_hash(F.to_json(_record()))
    e = saved(numbered.withColumns({"tree": part, "p": place, "h": leaf}), "log-events")
    treed = (F.col("p") < 60) & (F.col("j") > 3)
    # as written: counts and roots of all leaves
    start = F.when(F.col("tree") == 0, F.lit(3)).otherwise(F.lit(0))
    sealed = e.filter(treed & (F.pmod("j", F.lit(7)) == 0)).select("j", "tree", (F.col("p") + 1 - start).alias("count"))
    sealed = A.prefix_roots(e.filter(treed).select("tree", (F.col("p") - start).alias("i"), "h"), sealed)
    altered = (F.col("p") == 50) & (F.pmod("tree", F.lit(3)) == 1)
    taken = (F.col("p") == 20) & (F.pmod("tree", F.lit(5)) == 2)
    body = _record(note=F.when(altered, F.concat("note", F.lit("!"))).otherwise(F.col("note")))
    own = body.withField("merkle_leaf", F.when(treed & ~taken, F.col("h")))
    events = e.select((F.col("j") * 4 + 1).alias("at"), F.to_json(own).alias("line"))
    marks = e.filter("p = 60").select((F.col("j") * 4).alias("at"), F.to_json(F.struct(F.lit(A.DEGRADED).alias("event"), F.lit("disk").alias("reason"))).alias("line"))
    seals = sealed.select((F.col("j") * 4 + 2).alias("at"), A.checkpoint_line(F.col("root"), F.col("count"), F.col("height"), _KEY).alias("line"))
    blanks = e.filter((F.col("p") == 10) & (F.pmod("tree", F.lit(7)) == 3)).select((F.col("j") * 4 + 3).alias("at"), F.lit(" ").alias("line"))
    lines = events.unionByName(marks).unionByName(seals).unionByName(blanks)
    return R.append(lines.select(F.col("at").alias("seq"), "line", "at").limit(0), lines, "at").select(F.col("seq").alias("nth"), "line")


_LOG = """
e AS (SELECT *, row_number() OVER (ORDER BY seq) AS j FROM ledger),
q AS (SELECT *, (j - 1) // 64 AS tree, (j - 1) % 64 AS p, (j - 1) % 64 < 60 AND j > 3 AS treed,
  (j - 1) % 64 = 50 AND (j - 1) // 64 % 3 = 1 AS altered, (j - 1) % 64 = 20 AND (j - 1) // 64 % 5 = 2 AS taken FROM e),
c AS (SELECT *, sha256('{"actor":' || to_json(actor) || ',"entry_id":' || entry_id || ',"event":' || to_json(event_type) || ',"note":' || to_json(note) || ',"seq":' || seq || '}') AS h,
  sha256('{"actor":' || to_json(actor) || ',"entry_id":' || entry_id || ',"event":' || to_json(event_type) || ',"note":' || to_json(CASE WHEN altered THEN note || '!' ELSE note END) || ',"seq":' || seq || '}') AS replayed FROM q),
l AS (SELECT *, row_number() OVER (ORDER BY spot) AS nth FROM (
  SELECT j * 4 + 1 AS spot, CASE WHEN NOT treed OR taken THEN 'plain' ELSE 'leaf' END AS kind, j FROM c
  UNION ALL SELECT j * 4, 'degraded', j FROM c WHERE p = 60
  UNION ALL SELECT j * 4 + 2, 'checkpoint', j FROM c WHERE treed AND j % 7 = 0
  UNION ALL SELECT j * 4 + 3, 'blank', j FROM c WHERE p = 10 AND tree % 7 = 3)),
s AS (SELECT j, tree FROM c WHERE treed AND j % 7 = 0),
n AS (SELECT s.j, 'w' AS side, list(c.h ORDER BY c.j) AS row FROM s JOIN c ON c.tree = s.tree AND c.j <= s.j AND c.treed GROUP BY s.j
  UNION ALL SELECT s.j, 'r', list(c.replayed ORDER BY c.j) FROM s JOIN c ON c.tree = s.tree AND c.j <= s.j AND c.treed AND NOT c.taken GROUP BY s.j),
up AS (SELECT j, side, row, len(row) AS leaves, 0 AS level FROM n
  UNION ALL SELECT j, side, list_transform(range(1, len(row) + 1, 2), lambda i: sha256(unhex(row[i] || coalesce(row[i + 1], row[i])))), leaves, level + 1 FROM up WHERE len(row) > 1),
roots AS (SELECT r.j, r.row[1] AS root, r.leaves AS count, r.level AS height, r.row[1] = w.row[1] AND r.leaves = w.leaves AND r.level = w.level AS holds,
    concat_ws(';', CASE WHEN r.row[1] <> w.row[1] THEN 'root' END, CASE WHEN r.leaves <> w.leaves THEN 'count' END, CASE WHEN r.level <> w.level THEN 'height' END) AS wrong
  FROM up r JOIN up w ON r.j = w.j AND r.side = 'r' AND w.side = 'w' WHERE len(r.row) = 1 AND len(w.row) = 1),
v AS (SELECT l.nth, l.kind, c.j, c.tree AS segment, c.treed, roots.count, roots.holds,
  CASE WHEN l.kind = 'blank' THEN 'blank' WHEN l.kind = 'leaf' AND altered THEN 'leaf' WHEN l.kind = 'plain' AND taken AND treed THEN 'leafless' WHEN l.kind = 'checkpoint' AND NOT holds THEN 'checkpoint:' || wrong END AS reason
  FROM l JOIN c USING (j) LEFT JOIN roots ON roots.j = l.j AND l.kind = 'checkpoint')
"""


def audit_verification(spark, sf):
    """The report on a log of the ledger in which known lines are broken."""
    return A.verify_log(_made_log(spark, sf), _KEY).report()


_REPORT = """
, g AS (SELECT count(*) AS leaves FROM l JOIN c USING (j) WHERE l.kind = 'leaf' AND c.tree = (SELECT max(tree) FROM c)),
f AS (SELECT coalesce(max_by(count, nth), 0) AS covered FROM v WHERE kind = 'checkpoint' AND holds AND segment = (SELECT max(tree) FROM c))
SELECT count(*) AS total_lines, count(*) FILTER (kind = 'leaf' AND reason IS NULL) AS verified_events, count(*) FILTER (kind = 'checkpoint') AS checkpoints_total,
  count(*) FILTER (kind = 'checkpoint' AND holds) AS checkpoints_passed, count(*) FILTER (kind = 'checkpoint') AS signatures_verified, 0::BIGINT AS signatures_unverified,
  count(*) FILTER (kind = 'plain' AND j <= 3) AS legacy_lines, count(*) FILTER (kind = 'degraded') AS degraded_markers, count(*) FILTER (kind = 'plain' AND NOT treed AND j > 3) AS degraded_events,
  max(segment) + 1 AS segments, count(reason) AS failures_total, max(leaves - covered)::BIGINT AS unsealed, max(leaves - covered) = 0 AS sealed, CASE WHEN count(reason) > 0 THEN 2 ELSE 0 END AS exit_code, false AS scan_truncated
FROM v, g, f
"""


def audit_checkpoints(spark, sf):
    """Every checkpoint's replayed root, count and height, and whether it holds."""
    found = A.verify_log(_made_log(spark, sf), _KEY).checkpoints
    return found.select("nth", "segment", "count", "root", "height", F.col("reason").isNull().alias("holds"))


_CHECKPOINTS = """
SELECT v.nth, v.segment, roots.count, roots.root, roots.height, roots.holds FROM v JOIN roots USING (j) WHERE v.kind = 'checkpoint'
"""


def audit_failures(spark, sf):
    """The first lines that are wrong."""
    return A.verify_log(_made_log(spark, sf), _KEY).failures()


_FAILURES = "SELECT nth, reason FROM v WHERE reason IS NOT NULL ORDER BY nth LIMIT 50"


def audit_degraded(spark, sf):
    """Ranges of lines without leaves."""
    return A.verify_log(_made_log(spark, sf), _KEY).degraded


_DEGRADED = """
SELECT nth AS start, coalesce((SELECT min(b.nth) FROM v b WHERE b.kind IN ('leaf', 'degraded') AND b.nth > v.nth) - 1, (SELECT max(nth) FROM v)) AS "end", 'disk' AS reason FROM v WHERE kind = 'degraded'
"""


def canonical_leaves(spark, sf):
    """Hashes of records with numbers, flags, nothing and records within, as canonical JSON."""
    e = V.ledger(spark, sf)
    inner = F.struct(F.col("turn").alias("z"), F.array(F.col("turn") / 4, F.lit(None).cast("double")).alias("b"), (F.col("turn") > 1).alias("a"))
    record = F.struct(inner.alias("place"), F.col("note").alias("note"), F.col("entry_id").alias("entry"), F.lit("tab\there \x01\x1f").alias("control"), F.lit(None).cast("string").alias("nothing"))
    return e.select("seq", A.leaf_hash(F.to_json(record, {"ignoreNullFields": "false"})).alias("leaf"))


_CANONICAL = r"""
SELECT seq, sha256('{"control":"tab\there \u0001\u001f","entry":' || entry_id || ',"note":' || to_json(note) || ',"nothing":null,"place":{"a":' || (turn > 1) || ',"b":[' || (turn / 4)::DOUBLE || ',null],"z":' || turn || '}}') AS leaf FROM ledger
"""



def _on_log(body: str) -> str:
    return with_views("," + _LOG + body, "LEDGER").replace("WITH ledger", "WITH RECURSIVE ledger", 1)


QUERIES = {
    "audit_verification": (audit_verification, _on_log(_REPORT)),
    "audit_checkpoints": (audit_checkpoints, _on_log(_CHECKPOINTS)),
    "audit_failures": (audit_failures, _on_log(_FAILURES)),
    "audit_degraded": (audit_degraded, _on_log(_DEGRADED)),
    "canonical_leaves": (canonical_leaves, with_views(_CANONICAL, "LEDGER")),
}
