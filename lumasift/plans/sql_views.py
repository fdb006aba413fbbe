"""The same logical tables in DuckDB SQL, as bodies of common table expressions."""

IMAGE_SCORE = """
SELECT user_id AS site, user_id || '-' || (k // 4) AS path, event_type AS model,
       CAST(floor(least(1.0::DOUBLE, f * (1 + user_id % 5) / 3.0::DOUBLE) * 10000 + 0.5) AS BIGINT) AS p4,
       (event_id * 37) % 400 AS width, (event_id * 53) % 400 AS height, event_id AS seq, ts
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k,
             ((CAST(floor(value * 100 + 0.5) AS BIGINT) * 31) % 100) / 100.0::DOUBLE AS f FROM events)
"""

ENTRIES = """
SELECT o_orderkey AS id, o_custkey AS site,
       CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'approved'
            WHEN o_orderkey % 2 = 0 THEN 'submitted' ELSE 'rejected' END AS status,
       CASE WHEN o_totalprice >= 330000 THEN 'nsfw' WHEN o_totalprice >= 170000 THEN 'suspect' ELSE 'clean' END AS verdict,
       CAST(floor(o_totalprice / 50) AS BIGINT) AS agg4, o_orderdate AS created_at,
       CASE WHEN o_orderkey % 11 = 0 THEN '[组:g' || (o_orderkey % 7) || ']' END AS note
FROM orders
"""

COST_ROWS = """
SELECT CASE WHEN l_orderkey % 53 <> 0 THEN 'run-' || (l_orderkey % 50) END AS run_id, l_returnflag AS provider,
       l_returnflag || l_linestatus AS model, CAST(l_quantity AS BIGINT) AS images,
       CASE WHEN l_linenumber <> 7 THEN CAST(floor(l_extendedprice / 10) AS BIGINT) END AS cost_cents,
       CAST(l_shipdate AS DATE) AS day
FROM lineitem
"""

MEDIA = "SELECT DISTINCT user_id AS site, CAST(floor(value * 100 + 0.5) AS BIGINT) AS media FROM events"

FINGERPRINTS = """
SELECT vec_id * 3 + copy AS sha, label + CAST(copy AS INTEGER) AS site, CAST(vec_id % 12 AS INTEGER) AS family,
       CAST(list_aggregate(list_transform(embedding, lambda x, i: CASE WHEN (x > 0) <> ((copy >= 1 AND i > len(embedding) - vec_id % 12) <> (copy = 2 AND i <= 4)) THEN '1' ELSE '0' END), 'string_agg', '') AS BIT) AS h
FROM embeddings, range(0, 3) c(copy)
"""

LEDGER = """
SELECT conv_id * 1000 + turn AS seq, conv_id AS entry_id,
       CASE turn % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'approved' WHEN 2 THEN 'annotated' ELSE 'rejected' END AS event_type,
       turn, role AS actor, text AS note
FROM conversations
"""

LABELLED = """
SELECT l.doc_id, CAST(toxic AS BIGINT) AS label, CAST(((n_chars * 7919) % 1000) * 10 AS BIGINT) AS p4,
       CASE WHEN quality = 1 THEN 'human' ELSE 'other' END AS source_kind
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""


def with_views(body: str, *views: str, **named: str) -> str:
    """``body`` behind the named common table expressions (views by their lower-case names)."""
    parts = {v.lower(): globals()[v] for v in views} | named
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in parts.items()) + " " + body
