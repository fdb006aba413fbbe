"""Queries on urls, pages and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumasift.functions import text as T
from lumasift.functions import url as U
from lumasift.operators import search
from lumasift.operators.audit import prefix_roots
from lumasift.operators.ranks import numbered
from lumasift.plans.decision import q6, sql6
from lumasift.scratch import saved
from lumasift.sources.views import table

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_HOSTED = f"SELECT page_id, url, html, {_HOST} AS host, string_split({_HOST}, '.') AS labels FROM pages"
_KEYED = """
SELECT *, CASE WHEN len(labels) = 1 THEN host
  WHEN len(labels) >= 3 AND list_contains(['com.cn','net.cn','org.cn','gov.cn','edu.cn','ac.cn','com.hk','com.tw','com.sg','co.jp','co.uk','com.au'], labels[-2] || '.' || labels[-1])
    THEN labels[-3] || '.' || labels[-2] || '.' || labels[-1]
  WHEN regexp_full_match(labels[-1], '[a-z]{2,}') THEN labels[-2] || '.' || labels[-1] ELSE host END AS key
FROM hosted
"""


def _keyed(body: str) -> str:
    return f"WITH hosted AS ({_HOSTED}), keyed AS ({_KEYED}) {body}"


def canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.canonical_key(F.col("url")).alias("key"), U.canonical_name(F.col("url")).alias("name"))


def alias_labels(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.alias_label(F.col("url")).alias("label"))


_ALIAS = """
SELECT page_id, CASE WHEN label = '' THEN '主站' ELSE label END AS label
FROM (SELECT page_id, concat_ws('/', CASE WHEN www THEN 'www 前缀' END, CASE WHEN rest <> '' THEN '子域 ' || rest END,
        CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) NOT IN ('', '/') THEN '带路径' END) AS label
      FROM (SELECT *, cut = 'www' OR starts_with(cut, 'www.') AS www, CASE WHEN cut = 'www' THEN '' WHEN starts_with(cut, 'www.') THEN substr(cut, 5) ELSE cut END AS rest
            FROM (SELECT *, CASE WHEN host <> key THEN substr(host, 1, length(host) - length(key) - 1) ELSE '' END AS cut FROM keyed)))
"""


def url_risk(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", U.url_features(F.col("url")).alias("f"))
    return pages.select("page_id", *[F.col(f"f.{k}").alias(k) for k in U.FEATURE_WEIGHTS], U.url_risk(F.col("f")).alias("risk"))


_RISK = f"""
SELECT *, least(100, 20 * punycode_host::INT + 10 * idn_non_ascii::INT + 12 * suspicious_tld::INT + 8 * subdomain_depth::INT + 6 * hyphen_ratio::INT + 5 * nonstd_port::INT
  + 15 * ip_host::INT + 5 * long_obfuscated_path::INT + 10 * high_entropy_query::INT + 4 * plain_http::INT + 15 * deceptive_prefix::INT) / 100.0::DOUBLE AS risk
FROM (SELECT page_id, contains(host, 'xn--') AS punycode_host, regexp_matches(host, '[^\\x00-\\x7F]') AS idn_non_ascii,
        list_contains(['xyz','top','info','su','ru','cc','tk','ml','ga','cf','gq','biz','click','link','loan'], labels[-1]) AS suspicious_tld, len(labels) > 3 AS subdomain_depth,
        (length(host) - length(replace(host, '-', '')))::DOUBLE / length(host) > 0.3 AS hyphen_ratio, false AS nonstd_port, regexp_full_match(host, '[0-9.]+') AS ip_host,
        length(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) > 120 AS long_obfuscated_path, regexp_matches(regexp_extract(url, '\\?([^#]*)', 1), '[0-9A-Za-z+/_-]{{32,}}') AS high_entropy_query,
        starts_with(url, 'http://') AS plain_http, len(list_filter(labels, lambda x: starts_with(x, 'www-'))) > 0 AS deceptive_prefix FROM hosted)
"""


def bulk_intake(spark, sf):
    """Urls of the pages without scheme or fragment, normalised, the first of equal ones kept."""
    raw = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^https?://|#.*$", "").alias("line"))
    made = raw.select("page_id", U.normalised(F.col("line")).alias("x")).select("page_id", "x.url", "x.reason")
    first = F.row_number().over(Window.partitionBy("url").orderBy("page_id"))
    return made.filter(F.col("reason").isNull()).withColumn("nth", first).filter(F.col("nth") == 1).select("page_id", "url")


def excluded_domains(spark, sf):
    name = U.host(F.col("url"))
    return table(spark, sf, "pages").filter(~U.within_domains(name, ["example.net", "cheap-pills.example.com"])).select("page_id", name.alias("host"))


def page_links(spark, sf):
    """Links of each page that stay on its host, without fragments."""
    pages = table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"), F.explode(T.hrefs(F.col("html"))).alias("href"))
    full = F.when(F.col("href").startswith("/"), F.concat(F.lit("http://"), F.col("host"), F.col("href"))).otherwise(F.col("href"))
    links = pages.withColumn("link", F.regexp_replace(full, "#.*$", ""))
    return links.filter(F.col("link").rlike("^https?://") & (U.host(F.col("link")) == F.col("host"))).groupBy("page_id", "link").agg(F.count("*").alias("n"))


_LINKS = f"""
SELECT page_id, link, count(*) AS n
FROM (SELECT page_id, host, regexp_replace(CASE WHEN starts_with(href, '/') THEN 'http://' || host || href ELSE href END, '#.*$', '') AS link
      FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']*)["'']', 1)) AS href FROM hosted))
WHERE regexp_matches(link, '^https?://') AND {_HOST.replace('url', 'link')} = host GROUP BY page_id, link
"""


def redirect_targets(spark, sf):
    html = F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat(F.lit('<meta http-equiv="refresh" content="0; url=/to/'), F.col("page_id").cast("string"), F.lit('">'))).when(F.pmod("page_id", F.lit(3)) == 1, F.concat(F.lit("location.href = '/js/"), F.col("page_id").cast("string"), F.lit("'"))).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", T.refresh_target(html).alias("target"))


#: Demonstration lexicons; a user gives their own.
FIRST, SECOND, THIRD = ("the", "and", "of"), ("que", "der"), ("ti", "on")


def text_risk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    r = docs.select("doc_id", T.text_risk(F.col("title"), F.col("body"), FIRST, SECOND, THIRD).alias("r"))
    return r.select("doc_id", "r.u1", "r.u2", "r.u3", q6(F.col("r.density")).alias("density"), "r.blobs", "r.in_title", q6(F.col("r.risk")).alias("risk"))


def _times(word: str, text: str = "text") -> str:
    return f"((length({text}) - length(replace({text}, '{word}', ''))) // {len(word)})"


_TEXT_RISK = f"""
SELECT doc_id, u1, u2, u3, {sql6('density')} AS density, blobs, in_title,
  {sql6('''greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(0.35::DOUBLE, 0.10::DOUBLE * u1) + CASE WHEN density < 5 THEN 0.03::DOUBLE * density ELSE 0.15::DOUBLE END + least(0.24::DOUBLE, 0.08::DOUBLE * u2)
     + least(0.15::DOUBLE, 0.05::DOUBLE * u3) + least(0.12::DOUBLE, 0.06::DOUBLE * blobs) + CASE WHEN in_title THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END))''')} AS risk
FROM (SELECT doc_id, {' + '.join(f"({_times(w)} > 0)::BIGINT" for w in FIRST)} AS u1, {' + '.join(f"({_times(w)} > 0)::BIGINT" for w in SECOND)} AS u2,
        {' + '.join(f"({_times(w)} > 0)::BIGINT" for w in THIRD)} AS u3, CASE WHEN length(text) > 0 THEN ({' + '.join(_times(w) for w in FIRST)})::DOUBLE / length(text) * 1000 ELSE 0.0 END AS density,
        len(regexp_extract_all(text, '[A-Za-z0-9+/]{{40,}}={{0,2}}')) + len(regexp_extract_all(text, '[0-9a-fA-F]{{32,}}')) AS blobs,
        {' OR '.join(f"{_times(w, 'title')} > 0" for w in FIRST)} AS in_title
      FROM (SELECT doc_id, string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[1] || ' ' || text AS text FROM documents))
"""


def char_ngrams(spark, sf):
    return T.char_ngrams(table(spark, sf, "benchmark"), "item_id", F.col("text"))


_NGRAMS = """
SELECT item_id, gram, count(*) AS c FROM (
  SELECT item_id, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS gram FROM benchmark
  UNION ALL SELECT item_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM benchmark) GROUP BY item_id, gram
"""


def bm25_topk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(docs, asked, T.words(F.col("text")), T.words(F.col("text")))


_BM25 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS terms FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM benchmark),
p AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, dl, term),
s AS (SELECT count(*) AS n, sum(len(terms))::DOUBLE / count(*) AS avgdl FROM d),
i AS (SELECT term, ln(1.0::DOUBLE + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, avgdl FROM p, s GROUP BY term, n, avgdl),
r AS (SELECT query_id, doc_id, sum(CAST(floor(idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * 1e6 + 0.5) AS BIGINT)) AS micro
      FROM p JOIN i USING (term) JOIN q USING (term) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, micro / 1e6 AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY micro DESC, doc_id) AS INTEGER) AS place FROM r) WHERE place <= 5
"""


def tfidf_cosine(spark, sf):
    """All turns of conversations against two classes of benchmark texts."""
    seeds = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", (F.pmod("item_id", F.lit(2)) == 0).alias("positive"))
    texts = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    found = search.tfidf_kernel(texts, seeds)
    return found.select("id", *[F.floor(F.col(c) * 1e5 + 0.5).cast("long").alias(c) for c in ("cos_pos", "cos_neg", "risk")])


def _gram_counts(source: str) -> str:
    return f"""SELECT id, gram, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS gram FROM {source}
  UNION ALL SELECT id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM {source}) GROUP BY ALL"""


_TFIDF = f"""
WITH b AS (SELECT item_id AS id, text FROM benchmark), t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), g AS ({_gram_counts('b')}), h AS ({_gram_counts('t')}),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE id % 2 = 0) AS np, count(*) FILTER (WHERE id % 2 = 1) AS nn FROM b),
df AS (SELECT gram, count(*) AS df FROM g GROUP BY gram), tf AS (SELECT id, gram, c::DOUBLE / sum(c) OVER (PARTITION BY id) AS tf FROM g), uf AS (SELECT id, gram, c::DOUBLE / sum(c) OVER (PARTITION BY id) AS tf FROM h),
cen AS (SELECT gram, coalesce(sum(tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1)) FILTER (WHERE id % 2 = 0), 0) / any_value(np) AS pos, coalesce(sum(tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1)) FILTER (WHERE id % 2 = 1), 0) / any_value(nn) AS neg FROM tf JOIN df USING (gram), n GROUP BY gram),
nrm AS (SELECT sqrt(sum(pos * pos)) AS lp, sqrt(sum(neg * neg)) AS ln FROM cen),
v AS (SELECT id, tf * (ln((n + 2)::DOUBLE / (coalesce(df, 0) + 2)) + 1) AS v, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM uf LEFT JOIN df USING (gram) LEFT JOIN cen USING (gram), n),
r AS (SELECT id, sum(v * pos) / (sqrt(sum(v * v)) * any_value(lp)) AS cp, sum(v * neg) / (sqrt(sum(v * v)) * any_value(ln)) AS cn FROM v, nrm GROUP BY id)
SELECT id, CAST(floor(cp * 1e5 + 0.5) AS BIGINT) AS cos_pos, CAST(floor(cn * 1e5 + 0.5) AS BIGINT) AS cos_neg, CAST(floor(greatest(0.0, least(1.0, 0.5 + 2 * (cp - cn))) * 1e5 + 0.5) AS BIGINT) AS risk FROM r
"""


def site_fingerprint(spark, sf):
    """Per host 16 hex digits over its sorted page urls."""
    pages = table(spark, sf, "pages").select(U.host(F.col("url")).alias("host"), "url")
    return pages.groupBy("host").agg(F.left(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set("url"))), 256), F.lit(16)).alias("fingerprint"))


def _site_items(spark, sf):
    """host, item: each host's page urls (u:) and hashes of its pictures' addresses (i:), each once."""
    pages = table(spark, sf, "pages").select(U.host(F.col("url")).alias("host"), "url", "html")
    urls = pages.select("host", F.concat(F.lit("u:"), "url").alias("item"))
    images = pages.select("host", F.explode(T.image_sources(F.col("html"))).alias("src")).select("host", F.concat(F.lit("i:"), F.sha2("src", 256)).alias("item"))
    return urls.unionByName(images).distinct()


def site_fingerprint_images(spark, sf):
    """Per host 16 hex digits over its sorted page urls and picture hashes."""
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("item").startswith(k), F.col("item"))))
    sets = _site_items(spark, sf).groupBy("host").agg(of("u:").alias("urls"), of("i:").alias("images"))
    images = F.when(F.size("images") > 0, F.concat(F.lit("\nimages:\n"), F.array_join("images", "\n"))).otherwise("")
    return sets.select("host", F.left(F.sha2(F.concat(F.lit("pages:\n"), F.array_join("urls", "\n"), images), 256), F.lit(16)).alias("fingerprint"))


def site_tree(spark, sf):
    """Per host the root of a hash tree over its sorted urls and picture hashes: no host's items are ever together."""
    items = _site_items(spark, sf)
    placed = saved(numbered(items, ["host"], [F.col("item").asc()], "site-items").select(F.col("host").alias("tree"), "i", "n", F.sha2("item", 256).alias("h")), "site-leaves")
    sizes = placed.filter("i = 0").select("tree", F.col("n").alias("count"))
    return prefix_roots(placed, sizes).select(F.col("tree").alias("host"), F.col("count").alias("items"), "root")


_ITEMS = f"""
WITH RECURSIVE hosted AS ({_HOSTED}), x AS (SELECT host, 'u:' || url AS item FROM hosted
  UNION SELECT host, 'i:' || sha256(src) FROM (SELECT host, unnest(regexp_extract_all(html, '(?is)<img\\s[^>]*src=["'']([^"'']*)["'']', 1)) AS src FROM hosted))
"""
_WITH_IMAGES = _ITEMS + """
, g AS (SELECT host, string_agg(item, chr(10) ORDER BY item) FILTER (item LIKE 'u:%') AS u, string_agg(item, chr(10) ORDER BY item) FILTER (item LIKE 'i:%') AS i FROM x GROUP BY host)
SELECT host, substr(sha256('pages:' || chr(10) || u || CASE WHEN i IS NULL THEN '' ELSE chr(10) || 'images:' || chr(10) || i END), 1, 16) AS fingerprint FROM g
"""
_SITE_TREE = _ITEMS + """
, up AS (SELECT host, list(sha256(item) ORDER BY item) AS row, count(*) AS items FROM x GROUP BY host
  UNION ALL SELECT host, list_transform(range(1, len(row) + 1, 2), lambda k: sha256(unhex(row[k] || coalesce(row[k + 1], row[k])))), items FROM up WHERE len(row) > 1)
SELECT host, items, row[1] AS root FROM up WHERE len(row) = 1
"""


def template_simhash(spark, sf):
    """64 votes of the hashes of a url's shape tokens, as hex."""
    shape = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[0-9]+", "0")
    tokens = F.filter(F.split(shape, r"[/?&=.#]+"), lambda t: t != "")
    pages = table(spark, sf, "pages").select("page_id", tokens.alias("tokens"))
    bits = F.transform("tokens", lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 16), 16, -10).cast("long"))
    vote = lambda i: F.aggregate("hashes", F.lit(0), lambda a, h: a + F.when(F.getbit(h, i) == 1, 1).otherwise(-1))
    nibble = lambda k: F.lower(F.conv(F.concat_ws("", *[F.when(vote(F.lit(63 - 4 * k - j)) > 0, "1").otherwise("0") for j in range(4)]), 2, 16))
    hashed = pages.select("page_id", bits.alias("hashes"))
    return hashed.select("page_id", F.when(F.size("hashes") == 0, "").otherwise(F.concat_ws("", *[nibble(k) for k in range(16)])).alias("simhash"))


_SIMHASH = """
WITH t AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[0-9]+', '0', 'g'), '[/?&=.#]+'), lambda t: t <> '') AS tokens FROM pages),
h AS (SELECT page_id, unnest(tokens) AS t FROM t),
b AS (SELECT page_id, i, sum(CASE WHEN (instr('0123456789abcdef', substr(sha256(t), CAST(i // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(3 - i % 4 AS INTEGER) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS bit FROM h, range(64) r(i) GROUP BY page_id, i),
x AS (SELECT page_id, i // 4 AS k, sum(CASE WHEN bit THEN 1 << CAST(3 - i % 4 AS INTEGER) ELSE 0 END) AS d FROM b GROUP BY page_id, k),
s AS (SELECT page_id, string_agg(substr('0123456789abcdef', CAST(d + 1 AS BIGINT), 1), '' ORDER BY k) AS simhash FROM x GROUP BY page_id)
SELECT p.page_id, coalesce(simhash, '') AS simhash FROM pages p LEFT JOIN s ON p.page_id = s.page_id
"""


def query_expansion(spark, sf):
    """Keywords put into templates (or behind them), the first of equal results kept."""
    kw = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("kw"))
    tm = table(spark, sf, "region").select(F.col("r_regionkey").alias("t"), F.when(F.pmod("r_regionkey", F.lit(2)) == 0, F.concat(F.lit("{kw} in "), F.lower("r_name"))).otherwise(F.lower("r_name")).alias("tm"))
    # two short lists that a user types
    made = kw.crossJoin(F.broadcast(tm)).withColumn("query", F.when(F.contains("tm", F.lit("{kw}")), F.replace("tm", F.lit("{kw}"), F.col("kw"))).otherwise(F.concat_ws(" ", "kw", "tm")))
    first = F.row_number().over(Window.partitionBy("query").orderBy("t", "k"))
    return made.withColumn("nth", first).filter(F.col("nth") == 1).select("k", "t", "query")


def group_markers(spark, sf):
    from lumasift.sources.views import entries

    return entries(spark, sf).select("id", T.marker_group(F.col("note")).alias("group_name"))


def visible_text(spark, sf):
    """Title and body text of each page without markup."""
    from lumasift.operators.html import visible_text as extract

    return extract(table(spark, sf, "pages").select("page_id", "html"))


def image_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(T.image_sources(F.col("html"))).cast("long").alias("images"), F.size(T.hrefs(F.col("html"))).cast("long").alias("links"))


def address_keys(spark, sf):
    """Keys of addresses of version 6 made from page ids: padded, and with their first zero group left out."""
    g = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.pmod(F.col("page_id") * (i + 3), F.lit(5)) < 2, F.lit(0)).otherwise(F.pmod(F.col("page_id") * 7919 * (i + 1) + i, F.lit(65536))).cast("long"))
    pages = table(spark, sf, "pages").select("page_id", g.alias("g"))
    long = F.array_join(F.transform("g", lambda x: F.format_string("%04X", x)), ":")
    zero = F.array_position(F.col("g"), F.lit(0).cast("long")).cast("int")
    bare = F.transform("g", lambda x: F.lower(F.hex(x)))
    short = F.when(zero > 0, F.concat(F.array_join(F.slice(bare, F.lit(1), zero - 1), ":"), F.lit("::"), F.array_join(F.slice(bare, zero + 1, F.lit(8)), ":"))).otherwise(F.array_join(bare, ":"))
    key = lambda text: U.canonical_key(F.concat(F.lit("http://["), text, F.lit("]:8080/x")))
    return pages.select("page_id", key(long).alias("key"), key(short).alias("key_short"))


_ADDRESSES = f"""
WITH g AS (SELECT page_id, list_transform(range(8), lambda i: CASE WHEN page_id * (i + 3) % 5 < 2 THEN 0 ELSE (page_id * 7919 * (i + 1) + i) % 65536 END) AS g FROM pages),
m AS (SELECT page_id, list_transform(g, lambda x: format('{{:x}}', x)) AS t, list_aggregate(list_transform(g, lambda x: CASE WHEN x = 0 THEN 'z' ELSE 'x' END), 'string_agg', '') AS marks FROM g),
r AS (SELECT *, CASE {' '.join(f"WHEN contains(marks, '{'z' * n}') THEN {n}" for n in range(8, 1, -1))} ELSE 0 END AS n FROM m),
k AS (SELECT page_id, CASE WHEN n = 0 THEN array_to_string(t, ':') ELSE array_to_string(t[: instr(marks, repeat('z', n)) - 1], ':') || '::' || array_to_string(t[instr(marks, repeat('z', n)) + n :], ':') END AS key FROM r)
SELECT page_id, key, key AS key_short FROM k
"""

def plain_keys(spark, sf):
    """Keys and names that case groups fall back to, of pages and of what stands behind their scheme."""
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_replace("url", "^[a-z]+://", "").alias("bare"))
    return p.select("page_id", U.plain_key(F.col("url")).alias("key"), U.plain_name(F.col("url")).alias("name"), U.plain_name(F.col("bare")).alias("bare_name"))


_PLAIN = f"""
WITH hosted AS ({_HOSTED}), k AS (SELECT page_id, url, CASE WHEN regexp_full_match(host, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') OR len(labels) = 1 THEN host
  WHEN len(labels) >= 3 AND list_contains(['com.cn','net.cn','org.cn','gov.cn','edu.cn','ac.cn'], labels[-2] || '.' || labels[-1]) THEN labels[-3] || '.' || labels[-2] || '.' || labels[-1]
  ELSE labels[-2] || '.' || labels[-1] END AS key FROM hosted)
SELECT page_id, key, CASE WHEN key <> '' THEN key ELSE left(trim(url), 60) END AS name, left(regexp_replace(url, '^[a-z]+://', ''), 60) AS bare_name FROM k
"""

QUERIES = {
    "site_fingerprint_images": (site_fingerprint_images, _WITH_IMAGES),
    "site_tree": (site_tree, _SITE_TREE),
    "plain_keys": (plain_keys, _PLAIN),
    "address_keys": (address_keys, _ADDRESSES),
    "canonical_urls": (canonical_urls, _keyed("SELECT page_id, host, key, coalesce(nullif(key, ''), substr(url, 1, 80)) AS name FROM keyed")),
    "alias_labels": (alias_labels, _keyed(_ALIAS)),
    "url_risk": (url_risk, _keyed(_RISK)),
    "bulk_intake": (bulk_intake, "SELECT min(page_id) AS page_id, 'https://' || line AS url FROM (SELECT page_id, regexp_replace(url, '^https?://|#.*$', '', 'g') AS line FROM pages) GROUP BY line"),
    "excluded_domains": (excluded_domains, _keyed("SELECT page_id, host FROM hosted WHERE NOT (host = 'example.net' OR ends_with(host, '.example.net') OR host = 'cheap-pills.example.com' OR ends_with(host, '.cheap-pills.example.com'))")),
    "page_links": (page_links, _keyed(_LINKS)),
    "redirect_targets": (redirect_targets, "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/to/' || page_id WHEN page_id % 3 = 1 THEN '/js/' || page_id END AS target FROM pages"),
    "image_links": (image_links, """SELECT page_id, len(regexp_extract_all(html, '(?is)<img\\s[^>]*src=["'']([^"'']*)["'']')) AS images, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']*)["'']')) AS links FROM pages"""),
    "text_risk": (text_risk, _TEXT_RISK),
    "char_ngrams": (char_ngrams, _NGRAMS),
    "bm25_topk": (bm25_topk, _BM25),
    "tfidf_cosine": (tfidf_cosine, _TFIDF),
    "site_fingerprint": (site_fingerprint, _keyed("SELECT host, substr(sha256(string_agg(DISTINCT url, chr(10) ORDER BY url)), 1, 16) AS fingerprint FROM hosted GROUP BY host")),
    "template_simhash": (template_simhash, _SIMHASH),
    "query_expansion": (query_expansion, """
        SELECT k, t, query FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY t, k) AS nth FROM (
          SELECT n_nationkey AS k, r_regionkey AS t, CASE WHEN r_regionkey % 2 = 0 THEN lower(n_name) || ' in ' || lower(r_name) ELSE lower(n_name) || ' ' || lower(r_name) END AS query
          FROM nation, region)) WHERE nth = 1"""),
    "group_markers": (group_markers, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'g' || (o_orderkey % 7) ELSE '' END AS group_name FROM orders"),
    "visible_text": (visible_text, None),
}
