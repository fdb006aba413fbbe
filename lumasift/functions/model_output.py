"""Answers of models: finding, mending and checking their JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "，": ",", "：": ":"})


def balanced(text: str) -> str | None:
    """The first balanced object of a text, strings respected."""
    start = text.find("{")
    while start >= 0:
        depth, quote, at = 0, "", start
        while at < len(text):
            c = text[at]
            if quote:
                if c == "\\":
                    at += 1
                elif c == quote:
                    quote = ""
            elif c == '"':
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return text[start : at + 1]
            at += 1
        start = text.find("{", start + 1)
    return None


def mended(text: str | None) -> tuple[str | None, int]:
    """Canonical JSON of the object in a text, and how many kinds of mending it took (-1: hopeless)."""
    if not text:
        return None, -1
    steps = [
        lambda t: re.sub(r"```(?:json)?", "", t),
        lambda t: t.translate(_QUOTES),
        lambda t: re.sub(r",\s*([}\]])", r"\1", t),
        lambda t: re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", t))),
        lambda t: re.sub(r"'([^'\"]*)'", r'"\1"', t),
    ]
    used = 0
    for step in [lambda t: t, *steps]:
        new = step(text)
        used += new != text
        text = new
        found = balanced(text)
        if found:
            try:
                return json.dumps(json.loads(found), sort_keys=True, ensure_ascii=False, separators=(",", ":")), used
            except ValueError:
                pass
    return None, -1


def mended_json(text: Column) -> Column:
    """Struct (json, mends) of each text."""

    @F.pandas_udf("json string, mends int")
    def mend(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mended(t) for t in texts], columns=["json", "mends"])

    return mend(text)


def checked(answer: Column, categories: list[str]) -> Column:
    """Struct of a JSON answer: prob clipped to 0..1 (null if absent), known categories, whether the schema holds."""
    raw = F.from_json(answer, "nsfw_prob double, categories array<string>, confidence string")
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw["nsfw_prob"]))
    known = F.array_sort(F.array_intersect(F.coalesce(raw["categories"], F.array().cast("array<string>")), F.array(*map(F.lit, categories))))
    valid = raw["nsfw_prob"].isNotNull() & raw["confidence"].isin("low", "medium", "high")
    return F.struct(F.when(raw["nsfw_prob"].isNotNull(), prob).alias("prob"), known.alias("categories"), F.coalesce(valid, F.lit(False)).alias("valid"))
