"""Filters, catalogues, appended and verified records, short texts about entries."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumasift.operators.audit import leaf_hash
from lumasift.operators.ranks import numbered
from lumasift.scratch import saved

#: Hyperbole, what replaces it, words of promise, and marks of a formal text.
NEUTRAL = {"大量": "多张", "极其": "明显", "遍布": "多处", "全部": "相关", "所有": "相关", "泛滥成灾": "较多", "数不胜数": "较多", "铺天盖地": "多处", "触目惊心": "明显"}
HYPERBOLE = ("大量", "极其", "遍布", "全部", "所有", "泛滥成灾", "数不胜数")
PROMISES = ("绝对", "百分之百", "必然")
FORMAL = ("经核实", "涉嫌", "含有", "违反", "人工核实")
CLOSING = "以上情况本人已人工核实。"
#: Least and most characters of a description, of a reason, and of a list of sites.
LEAST_CHARS, MOST_CHARS, REASON_CHARS, SITES_CHARS = 30, 240, 39, 200
#: Laws that a category of reports rests on.
LAWS = {
    "色情类": ("网络安全法", "未成年人保护法", "互联网信息服务管理办法", "出版管理条例"),
    "低俗类": ("网络安全法", "互联网信息服务管理办法", "未成年人保护法"),
    "侵权类": ("出版管理条例", "网络安全法", "互联网信息服务管理办法"),
    **{c: ("网络安全法", "互联网信息服务管理办法") for c in ("赌博类", "谣言类", "政治类", "暴恐类", "诈骗类", "其他类")},
}


def any_of(text: Column, words: Sequence[str]) -> Column:
    return functools.reduce(operator.or_, [text.contains(w) for w in words])


# -- filters and catalogues -----------------------------------------------------------------------


def filter_entries(entries: DataFrame, status: str | None = None, q: str = "", url: str = "site_url") -> DataFrame:
    """Entries of a status whose url contains ``q``, whatever the case; empty conditions don't count."""
    if status:
        entries = entries.filter(F.col("status") == status)
    word = (q or "").strip().lower()
    return entries.filter(F.lower(F.coalesce(F.col(url), F.lit(""))).contains(word)) if word else entries


def fresh(rows: DataFrame, at: str, now: Column, hours: float) -> DataFrame:
    """``rows`` with live: whether they are younger than some hours."""
    return rows.withColumn("live", F.unix_timestamp(now) - F.unix_timestamp(at) < hours * 3600)


def session_stats(groups: DataFrame, events: DataFrame) -> DataFrame:
    """groups, pending, reported, scans: one row (``groups``: reported, boolean)."""
    one = groups.agg(F.count("*").alias("groups"), F.count(F.when(F.col("reported"), 1)).alias("reported"))
    return one.crossJoin(events.agg(F.count("*").alias("scans"))).select("groups", (F.col("groups") - F.col("reported")).alias("pending"), "reported", "scans")


def search_models(models: DataFrame, words: str, prefer: Sequence[str] = ()) -> DataFrame:
    """Models (name, vision) whose name has all words, those with preferred parts first, then vision models, then by name."""
    for w in words.lower().split():
        models = models.filter(F.lower("name").contains(w))
    rank = F.size(F.filter(F.array(*map(F.lit, prefer)), lambda p: F.contains(F.lower(F.col("name")), p))) if prefer else F.lit(0)
    ranked = numbered(models.withColumn("rank", rank), [], [F.desc("rank"), F.desc("vision"), F.asc("name")], "models")
    return ranked.withColumn("place", (F.col("i") + 1).cast("int")).drop("i", "n")


def is_vision(name: Column) -> Column:
    """Whether a model's name says that it sees."""
    return F.lower(name).rlike(r"(vision|(^|[-_.\d])vl?([-_.\d]|$)|vlm|omni|ocr|4v)")


def keyword_stats(lines: DataFrame) -> DataFrame:
    """One row: words kept (distinct, no comments) and lines dropped of a keyword file (line)."""
    word = F.trim("line")
    keeps = (word != "") & ~word.startswith("#")
    return lines.agg(F.count_distinct(F.when(keeps, word)).alias("kept"), (F.count("*") - F.count_distinct(F.when(keeps, word))).alias("dropped"))


# -- appended records -----------------------------------------------------------------------------


def canonical_leaf(row: Column) -> Column:
    """SHA-256 of a record (struct or map, of any values) as canonical JSON: keys in order, no blanks, nulls kept."""
    return leaf_hash(F.to_json(row, {"ignoreNullFields": "false"}))


def append(ledger: DataFrame, events: DataFrame, order: str) -> DataFrame:
    """``ledger`` (seq, ...) with ``events`` behind it, numbered on without a gap in their order.

    Positions come from counts of range partitions, so no task sorts all events.
    """
    names = [c for c in ledger.columns if c != "seq"]
    ranged = saved(events.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), "append-ranged")
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    # one row a part
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = ledger.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__last"))
    numbered = ranged.withColumn("__nth", nth).join(sizes.select("__part", before.alias("__before")), "__part").crossJoin(F.broadcast(last))
    fresh_rows = numbered.select((F.col("__last") + F.col("__before") + F.col("__nth")).cast("long").alias("seq"), *names)
    return ledger.select("seq", *names).unionByName(fresh_rows)


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables (i, h) of all levels from ``leaves`` (i from 0, hex h) to the root; an odd level repeats its last node."""
    levels = [saved(leaves.select("i", "h"), "proof-0")]
    n = levels[0].count()
    while n > 1:
        even = F.pmod("i", F.lit(2)) == 0
        left, right = F.max(F.when(even, F.col("h"))), F.max(F.when(~even, F.col("h")))
        up = levels[-1].groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.sha2(F.unhex(F.concat(left, F.coalesce(right, left))), 256).alias("h"))
        levels.append(saved(up, f"proof-{len(levels)}"))
        n = -(-n // 2)
    return levels


def merkle_proofs(levels: Sequence[DataFrame], wanted: DataFrame) -> DataFrame:
    """(i, leaf, proof) of the ``wanted`` leaves (i): siblings from below, each with the side that it stands on."""
    found = wanted.join(levels[0].withColumnRenamed("h", "leaf"), "i").select("i", "leaf", F.col("i").alias("at"), F.array().cast("array<struct<side:string,h:string>>").alias("proof"))
    for level in levels[:-1]:
        other = F.when(F.pmod("at", F.lit(2)) == 0, F.col("at") + 1).otherwise(F.col("at") - 1)
        sides = level.select(F.col("i").alias("other"), F.col("h").alias("sibling"))
        own = level.select(F.col("i").alias("at"), F.col("h").alias("own"))
        met = found.withColumn("other", other).join(sides, "other", "left").join(own, "at")
        step = F.struct(F.when(F.pmod("at", F.lit(2)) == 0, "right").otherwise("left").alias("side"), F.coalesce("sibling", "own").alias("h"))
        found = met.select("i", "leaf", F.floor(F.col("at") / 2).alias("at"), F.array_append("proof", step).alias("proof"))
    return found.select("i", "leaf", "proof")


def proven_root(leaf: Column, proof: Column) -> Column:
    """The root that a proof leads to."""
    join = lambda a, b: F.sha2(F.unhex(F.concat(a, b)), 256)
    return F.aggregate(proof, leaf, lambda h, p: F.when(p["side"] == "right", join(h, p["h"])).otherwise(join(p["h"], h)))


def four_eyes(approvals: DataFrame, need: int = 2) -> DataFrame:
    """entry_id, reviewers, ok: entries that as many people approved as they need, none of whom added them.

    ``approvals``: entry_id, actor, event_type.
    """
    by = F.collect_set(F.when(F.col("event_type") == "approved", F.col("actor")))
    author = F.collect_set(F.when(F.col("event_type") == "added", F.col("actor")))
    found = approvals.groupBy("entry_id").agg(by.alias("by"), author.alias("author"))
    others = F.array_except("by", "author")
    return found.select("entry_id", F.size(others).alias("reviewers"), (F.size(others) >= need).alias("ok"))


# -- short texts ----------------------------------------------------------------------------------


def style_score(text: Column) -> Column:
    """Struct of four marks (0/1) and their total."""
    safe = F.coalesce(text, F.lit(""))
    marks = {
        "len_ok": F.length(safe).between(LEAST_CHARS, MOST_CHARS),
        "has_facts": safe.rlike(r"\d"),
        "no_hype": ~any_of(safe, list(NEUTRAL)),
        "formality": any_of(safe, FORMAL),
    }
    made = {k: c.cast("int") for k, c in marks.items()}
    return F.struct(*[c.alias(k) for k, c in made.items()], sum(made.values(), F.lit(0)).alias("total"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def polished(text: Column) -> Column:
    """``text`` without hyperbole, cut behind a sentence, with the closing statement; blank text stays."""
    room = MOST_CHARS - len(CLOSING) - 1

    def cut(plain: Column) -> Column:
        window = F.left(plain, F.lit(room))
        sentence = _once(F.regexp_extract(window, r"(?s)^(.*。)", 1), lambda s: F.when(s != "", s).otherwise(window))
        return F.when(F.length(plain) > room, sentence).otherwise(plain)

    def closed(body: Column) -> Column:
        return F.when(F.endswith(body, F.lit(CLOSING)), body).when(body.rlike(r"[。！？；!?…]$"), F.concat(body, F.lit(CLOSING))).otherwise(F.concat(body, F.lit("。" + CLOSING)))

    def neutral(given: Column) -> Column:
        plain = given
        for word in sorted(NEUTRAL, key=len, reverse=True):
            plain = F.replace(plain, F.lit(word), F.lit(NEUTRAL[word]))
        done = lambda p: F.endswith(p, F.lit(CLOSING)) & (F.length(p) <= MOST_CHARS)
        made = _once(F.rtrim(plain), lambda p: F.when(done(p), p).otherwise(_once(cut(p), closed)))
        return F.when(F.trim(given) == "", given).otherwise(made)

    return _once(F.coalesce(text, F.lit("")), neutral)


def fitted_reason(text: Column) -> Column:
    """At most 39 characters, cut at a mark behind the twelfth if there is one."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    window = F.left(flat, F.lit(REASON_CHARS - 1))
    cuts = [F.regexp_extract(window, rf"(?s)^(.{{12,}})[{stop}]", 1) for stop in ("。", "，", ",", "；", ";", " ", "、")]
    return F.when(F.length(flat) <= REASON_CHARS, flat).otherwise(F.coalesce(*[F.when(c != "", c) for c in cuts], window))


def reason(host: Column, pages: Column, images: Column) -> Column:
    """Why an entry is reported, from facts alone."""
    name = F.when(F.coalesce(host, F.lit("")) == "", "该站点").otherwise(F.left(host, F.lit(18)))
    text = (
        F.when((pages > 0) & (images > 0), F.concat(name, F.lit("抽查"), pages.cast("string"), F.lit("页，"), images.cast("string"), F.lit("张图涉色情内容，已人工核实")))
        .when(images > 0, F.concat(name, images.cast("string"), F.lit("张图涉色情内容，经人工核实")))
        .otherwise(F.concat(name, F.lit("涉嫌传播色情内容，已经人工核实")))
    )
    return fitted_reason(text)


def group_name(primary: Column, urls: Column, aliases: Column) -> Column:
    """The main domain, with how many sites belong to it if there are several."""
    n = F.greatest(urls, aliases)
    return F.when(F.coalesce(primary, F.lit("")) == "", "(未命名案件组)").when(n > 1, F.concat(primary, F.lit("(含 "), n.cast("string"), F.lit(" 个关联站点)"))).otherwise(primary)


def sites_text(main: Column, hosts: Column) -> Column:
    """One line of the main site and the other hosts, at most 200 characters."""
    others = F.array_distinct(F.filter(hosts, lambda h: (h != "") & (h != main)))
    text = F.concat(F.lit("主站："), main, F.lit("；镜像/关联："), F.when(F.size(others) > 0, F.array_join(others, "，")).otherwise("无"))
    return F.when(F.length(text) > SITES_CHARS, F.concat(F.left(text, F.lit(SITES_CHARS - 1)), F.lit("等"))).otherwise(text)


def category(agg: Column, hit: Column, nsfw: float = 0.9, review: float = 0.5) -> Column:
    """A report's category: that of the best section found, else by score."""
    return F.when(hit.isin(*LAWS), hit).when(agg >= nsfw, "色情类").when(agg >= review, "低俗类").otherwise("其他类")


def laws_of(kind: Column) -> Column:
    """Laws of a category, as an array; empty for others."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in LAWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), kind), F.array().cast("array<string>"))


def critique(text: Column, numbers: Column, site: Column) -> Column:
    """What is wrong with a draft: numbers that no fact states at two places, hyperbole, length, promises.

    ``numbers``: array of doubles that are facts.  Numbers in the site's url don't count.
    """
    draft = F.coalesce(text, F.lit(""))
    bare = F.when(F.coalesce(site, F.lit("")) != "", F.replace(draft, site, F.lit(" "))).otherwise(draft)
    said = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(\d+\.?\d*)"), F.lit(1)))
    rounded = F.transform(numbers, lambda x: F.round(x, 2))
    wild = F.filter(said, lambda x: ~F.array_contains(rounded, F.round(x.cast("double"), 2)))
    issues = [F.transform(wild, lambda x: F.concat(F.lit("number "), x))]
    issues += [F.when(draft.contains(w), F.array(F.lit(f"hyperbole {w}"))).otherwise(F.array().cast("array<string>")) for w in HYPERBOLE]
    issues.append(F.when(F.length(draft) > MOST_CHARS, F.array(F.lit("length"))).otherwise(F.array().cast("array<string>")))
    issues += [F.when(draft.contains(w), F.array(F.lit(f"promise {w}"))).otherwise(F.array().cast("array<string>")) for w in PROMISES]
    return F.concat(*issues)
