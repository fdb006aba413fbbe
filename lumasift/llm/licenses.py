r"""License scan: an exact set-similarity join of text blocks and license templates, DataFrame functions only.

A text's words are runs of letters, digits and other signs beyond ASCII, A-Z
lower-cased.  A template of m distinct words is found in a block that has at
least ``threshold`` * m of them (containment).  Blocks fit the templates: with a
reach of r words (a power of two that leaves a quarter of room) they are 2r
words long and start every r words, so a passage of r words is whole in one.

Join: words that templates have are ordered by the number of documents that
hold them, over all documents, rarest first.  A block that holds o or more of a
template's m words has one of its m - o + 1 first ones (prefix), has o words of
the order at least (length), and after a common word at place i of the template
and j of the block enough words are left in both (positions).  Blocks and
templates meet on prefix words by an equi-join; what the filters leave is
counted exactly.  Filters only spare work: no block that meets the threshold is
lost.

The order is made in a pass over the texts that counts the templates' words, a
row a word; a second pass writes one narrow row a document with the blocks that
hold a prefix word.  Texts are never shuffled.

Base labels are phrases that stand word by word; they are found beside the join
and stay whatever it says.  Score: 1 with a base place, else the largest
containment found, else 0.

Defined results: null text counts as empty, an empty text has no words, labels
are empty strings then, and places null; a text that has fewer words than a
block is one block; of templates with one label the best counts; rows that
repeat are rows of their own; very long texts are blocks like others; extra
columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumasift.llm.common import saved, table

#: Signs between words; A-Z are words' letters before they are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's distinct words that a block has to hold.
THRESHOLD = 0.85
#: Words of all templates together, at most: they are literals of the plan.
MAX_WORDS = 20_000


class Phrase(NamedTuple):
    words: str
    label: str


class Template(NamedTuple):
    label: str
    text: str


#: The base phrases of query op13.
PHRASES = (
    Phrase("under the mit license", "mit"),
    Phrase("apache license version 2", "apache-2"),
    Phrase("cc by nc", "cc-by-nc"),
)

#: Short notices, and the opening passages of public licenses.
TEMPLATES = (
    Template("mit", "released under the MIT license"),
    Template("mit", "licensed under the MIT license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    Template("apache-2", "licensed under the Apache license, version 2.0"),
    Template("apache-2", "you may not use this file except in compliance with the license. You may obtain a copy of the license at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("gpl-3", "this work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
)


def words_of(text: str) -> list[str]:
    """A template's words; the Column form below says the same of texts."""
    return re.sub(GAP, " ", text).translate(str.maketrans(UPPER, LOWER)).split()


def reach_of(words: Sequence[str]) -> int:
    return 1 << max(3, math.ceil(math.log2(len(words) * 1.25)))


class _Sought(NamedTuple):
    """A template of the join."""

    nth: int
    label: str
    reach: int
    words: frozenset
    least: int


def _sought(templates: Sequence[Template], threshold: float) -> list[_Sought]:
    found = []
    for nth, t in enumerate(templates):
        if words := words_of(t.text):
            own = frozenset(words)
            found.append(_Sought(nth, t.label, reach_of(words), own, max(1, math.ceil(threshold * len(own) - 1e-9))))
    if sum(len(t.words) for t in found) > MAX_WORDS:
        raise ValueError(f"templates of more than {MAX_WORDS} words: scan with several lists")
    return found


# ------------------------------------------------------------------ columns


def spaced(text: Column) -> Column:
    """Words in their letters as given, a blank between two of them."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), GAP, " "))


def lowered(text: Column) -> Column:
    """A-Z in lower case.  lower() does that to ASCII texts, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def _count(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def places(norm: Column, phrase: str) -> Column:
    """(n, first, last): places where the phrase's words stand, and its smallest and largest start in words.

    The text is cut at every first word that the others follow; so places may overlap.
    """
    first, *rest = words_of(phrase)
    behind = "".join(f" {re.escape(w)}" for w in rest)
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    cuts = F.split(padded, f"(?i)(?<= ){re.escape(first)}(?={behind} )")

    def counted(pieces: Column) -> Column:
        following = _count(F.trim(F.element_at(pieces, -1)))
        return F.struct((F.size(pieces) - 1).cast("long").alias("n"), _count(F.trim(pieces[0])).alias("first"), (_count(norm) - following - 1).alias("last"))

    none = F.lit(None).cast("long")
    empty = F.struct(F.lit(0).cast("long").alias("n"), none.alias("first"), none.alias("last"))
    # most texts hold no such place: no cutting there
    return F.when(padded.rlike(f"(?i) {re.escape(first)}{behind} "), F.transform(F.array(cuts), counted)[0]).otherwise(empty)


# ------------------------------------------------------------------ join


def word_order(docs: DataFrame, vocabulary: Sequence[str], text: str = "text") -> list[str]:
    """``vocabulary`` by the number of documents that hold a word, rarest first, over all documents.

    Counts are a row for each word, at most as many as the templates have.
    """
    held = docs.select(F.explode(F.array_intersect(_words(lowered(spaced(F.col(text)))), _strings(sorted(vocabulary)))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _prefix(order: dict[str, int], t: _Sought) -> list[str]:
    return sorted(t.words, key=order.__getitem__)[: len(t.words) - t.least + 1]


_BLOCKS = "array<struct<reach:int,block:int,held:array<string>>>"


def _blocks_of(words: Column, reach: int, ordered: Column, prefix: Column, least: int) -> Column:
    """Blocks of a reach that hold a prefix word: (reach, block, words of the order, rarest first)."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - 1) / reach) - 1).cast("int"))
    every = F.transform(starts, lambda b: F.struct(F.lit(reach).alias("reach"), b.alias("block"), F.array_intersect(ordered, F.slice(words, b * reach + 1, 2 * reach)).alias("held")))
    held = F.filter(every, lambda x: (F.size(x["held"]) >= least) & F.arrays_overlap(x["held"], prefix))
    return F.when(F.arrays_overlap(words, prefix), held).otherwise(F.array().cast(_BLOCKS))


def _blocks(words: Column, order: Sequence[str], sought: Sequence[_Sought], ranks: dict[str, int]) -> Column:
    """Blocks of every reach that templates have."""
    parts = []
    for reach in sorted({t.reach for t in sought}):
        own = [t for t in sought if t.reach == reach]
        prefix, vocabulary = {w for t in own for w in _prefix(ranks, t)}, {w for t in own for w in t.words}
        parts.append(_blocks_of(words, reach, _strings([w for w in order if w in vocabulary]), _strings(sorted(prefix)), min(t.least for t in own)))
    return F.concat(*parts) if parts else F.array().cast(_BLOCKS)


def _template_rows(spark, sought: Sequence[_Sought], ranks: dict[str, int]) -> DataFrame:
    """A row for each prefix word of a template: reach, word, place, nth, label, words in order, least."""
    rows = []
    for t in sought:
        ordered = sorted(t.words, key=ranks.__getitem__)
        for place, w in enumerate(_prefix(ranks, t)):
            rows.append(F.struct(F.lit(t.reach).alias("reach"), F.lit(w).alias("word"), F.lit(place).alias("place"), F.lit(t.nth).alias("nth"), F.lit(t.label).alias("label"), _strings(ordered).alias("sought"), F.lit(t.least).alias("least")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def similar(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, label, reach, block, containment) of every block and template that meet the threshold.

    ``blocks`` has row, reach, block and held, ``templates`` the rows of
    prefix words, which are few by MAX_WORDS.
    """
    asked = blocks.select("row", "reach", "block", "held", F.posexplode("held").alias("at", "word"))
    left = F.least(F.size("sought") - F.col("place"), F.size("held") - F.col("at"))
    met = asked.join(F.broadcast(templates), ["reach", "word"]).filter((F.size("held") >= F.col("least")) & (left >= F.col("least")))
    common = F.size(F.array_intersect("held", "sought"))
    return (
        met.filter(common >= F.col("least"))
        .select("row", "label", "nth", "reach", "block", (common / F.size("sought")).alias("containment"))
        .distinct()
        .drop("nth")
    )


def _labelled(found: Column, label: str) -> Column:
    return F.transform(F.array(found), lambda x: F.struct(F.lit(label).alias("label"), x["n"].alias("n"), x["first"].alias("first"), x["last"].alias("last")))[0]


_FOUND = "array<struct<label:string,containment:double,start:bigint,length:bigint>>"


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[Phrase] = PHRASES, threshold: float = THRESHOLD, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row per row of ``docs``: ``keep``, n_words, base (label, n, first and last of each phrase), found (label, containment, block start and length in words of the best block of each label)."""
    spark = docs.sparkSession
    sought = _sought(templates, threshold)
    order = word_order(docs, sorted({w for t in sought for w in t.words}), text) if sought else []
    ranks = {w: k for k, w in enumerate(order)}
    given = docs.select(*[F.col(c).alias(f"own_{k}") for k, c in enumerate(keep)], spaced(F.col(text)).alias("norm"))
    base = F.array(*[_labelled(places(F.col("norm"), p.words), p.label) for p in phrases]) if phrases else F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>")
    low = given.withColumn("words", _words(lowered(F.col("norm"))))
    narrow = low.select(
        *[f"own_{k}" for k in range(len(keep))],
        F.monotonically_increasing_id().alias("row"),
        F.size("words").cast("long").alias("n_words"),
        F.filter(base, lambda x: x["n"] > 0).alias("base"),
        _blocks(F.col("words"), order, sought, ranks).alias("blocks"),
    )
    narrow = saved(narrow, "license-blocks")
    kept = narrow.select("row", *[F.col(f"own_{k}").alias(c) for k, c in enumerate(keep)], "n_words", "base")
    if not sought:
        return kept.drop("row").withColumn("found", F.array().cast(_FOUND))
    met = similar(narrow.select("row", F.inline("blocks")), _template_rows(spark, sought, ranks))
    start = (F.col("block") * F.col("reach")).cast("long")
    # of a label the fullest, then the shortest, then the first block
    best = met.groupBy("row", "label").agg(F.max(F.struct("containment", (-F.col("reach")).alias("narrow"), (-start).alias("early"))).alias("x"))
    each = F.struct("label", F.col("x.containment").alias("containment"), (-F.col("x.early")).alias("start"), (F.col("x.narrow") * -2).cast("long").alias("length"))
    found = best.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(each)).alias("found"))
    return kept.join(found, F.col("row") == F.col("of"), "left").withColumn("found", F.coalesce("found", F.array().cast(_FOUND))).drop("row", "of")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = lambda name: F.transform(name, lambda x: x["label"])
    joined = lambda of: F.array_join(F.array_sort(F.array_distinct(of)), ",")
    n_base = F.aggregate("base", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0))
    return scan(docs).select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.concat(labels("base"), labels("found"))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def _quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _oracle() -> str:
    """Every block against every template of its reach, every word against every phrase: no filters."""
    sought = _sought(TEMPLATES, THRESHOLD)
    rows = ", ".join(f"('{t.label}', {t.reach}, {_quoted(sorted(t.words))}, {t.least})" for t in sought)
    phrases = " UNION ALL ".join(
        f"SELECT nr, i - 1 AS spot, '{p.label}' AS label FROM (SELECT nr, words, unnest(range(1, len(words) + 1)) AS i FROM docs) WHERE words[i : i + {len(p.words.split()) - 1}] = {_quoted(p.words.split())}" for p in PHRASES
    )
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS nr, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
templates AS (SELECT * FROM (VALUES {rows}) AS t(label, reach, sought, least)),
blocks AS (
  SELECT nr, reach, words[b * reach + 1 : (b + 2) * reach] AS held
  FROM (SELECT nr, words, reach, unnest(range(0, greatest(1, (len(words) - 1) // reach))) AS b FROM docs, (SELECT DISTINCT reach FROM templates))),
alike AS (
  SELECT nr, label, max(len(list_intersect(sought, held)) / len(sought)) AS containment
  FROM blocks JOIN templates USING (reach) WHERE len(list_intersect(sought, held)) >= least GROUP BY nr, label),
base AS ({phrases}),
based AS (SELECT nr, count(*) AS n_spots, min(spot) AS least_spot, max(spot) AS last_spot, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM base GROUP BY nr),
every AS (SELECT nr, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT nr, label FROM base UNION ALL SELECT nr, label FROM alike) GROUP BY nr),
best AS (SELECT nr, max(containment) AS containment FROM alike GROUP BY nr)
SELECT doc_id, len(words) AS n_words, coalesce(n_spots, 0) AS n_base, least_spot AS first_word, last_spot AS last_word, coalesce(based.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, CASE WHEN n_spots > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN based USING (nr) LEFT JOIN every USING (nr) LEFT JOIN best USING (nr)"""


ORACLE = _oracle()
