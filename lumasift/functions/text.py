"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(text: Column, word: str) -> Column:
    """Times that ``word`` occurs without overlap."""
    gone = F.length(F.replace(text, F.lit(word), F.lit("")))
    return ((F.length(text) - gone) / F.lit(len(word))).cast("long")


def lexicon_counts(text: Column, words: Sequence[str]) -> Column:
    """How often each of the words occurs."""
    return F.array(*[occurrences(text, w) for w in words])


def lexicon_hits(counts: Column) -> Column:
    """How many words occur at all."""
    return F.size(F.filter(counts, lambda c: c > 0)).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def text_risk(title: Column, body: Column, first: Sequence[str], second: Sequence[str], third: Sequence[str]) -> Column:
    """Struct: distinct hits of three lexicons, density per mille, blobs, title flag, risk.

    Each word is counted once a text: counts are bound before anything is made of them.
    """

    def counted(text: Column) -> Column:
        blobs = (F.regexp_count(text, F.lit(r"[A-Za-z0-9+/]{40,}={0,2}")) + F.regexp_count(text, F.lit(r"[0-9a-fA-F]{32,}"))).cast("long")
        counts = [lexicon_counts(text, w).alias(f"c{k}") for k, w in enumerate((first, second, third), 1)]
        return bound(F.struct(*counts, lexicon_counts(title, first).alias("ct"), F.length(text).alias("n"), blobs.alias("blobs")), rated)

    def rated(x: Column) -> Column:
        total = F.aggregate(x["c1"], F.lit(0).cast("long"), lambda a, c: a + c)
        density = F.when(x["n"] > 0, total / x["n"] * 1000).otherwise(0.0)
        hits = [lexicon_hits(x[f"c{k}"]).alias(f"u{k}") for k in (1, 2, 3)]
        return bound(F.struct(*hits, density.alias("density"), x["blobs"].alias("blobs"), (lexicon_hits(x["ct"]) > 0).alias("in_title")), summed)

    def summed(x: Column) -> Column:
        risk = (
            F.least(F.lit(0.35), F.lit(0.10) * x["u1"])
            + F.when(x["density"] < 5, F.lit(0.03) * x["density"]).otherwise(F.lit(0.15))
            + F.least(F.lit(0.24), F.lit(0.08) * x["u2"])
            + F.least(F.lit(0.15), F.lit(0.05) * x["u3"])
            + F.least(F.lit(0.12), F.lit(0.06) * x["blobs"])
            + F.when(x["in_title"], 0.10).otherwise(0.0)
        )
        return F.struct(*[x[c].alias(c) for c in ("u1", "u2", "u3", "density", "blobs", "in_title")], F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)).alias("risk"))

    return bound(F.concat_ws(" ", title, body), counted)


def char_ngrams(df: DataFrame, id_col: str | Sequence[str], text: Column, sizes: Sequence[int] = (2, 3)) -> DataFrame:
    """(id, gram, c): counts of the character n-grams of each text; the id may be several columns.

    Grams are made by one generator over positions and summed map-side first.
    """

    def of_size(n: int) -> Column:
        starts = F.when(F.length("__text") >= n, F.sequence(F.lit(1), F.length("__text") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(F.col("__text"), i, F.lit(n)))

    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    parts = [of_size(n) for n in sizes]
    grams = df.select(*ids, text.alias("__text")).select(*ids, F.explode(F.concat(*parts)).alias("gram"))
    return grams.groupBy(*ids, "gram").agg(F.count("*").alias("c"))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokens_cjk(text: Column) -> Column:
    """Words of ASCII letters and digits, and bigrams of runs of Chinese characters (single ones alone)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+|[一-鿿]+)"), F.lit(1))
    split = F.transform(
        runs,
        lambda r: F.when(r.rlike(r"^[a-z0-9]") | (F.length(r) == 1), F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substr(r, i, F.lit(2)))
        ),
    )
    return F.flatten(split)


def marker_group(note: Column) -> Column:
    """The name in ``[组:name]``; empty without one."""
    return F.regexp_extract(F.coalesce(note, F.lit("")), r"\[组:([^\]]*)\]", 1)


def metric_name(name: Column) -> Column:
    """Characters outside [a-zA-Z0-9_:] become _, and a digit at the front gets one before it."""
    clean = F.regexp_replace(name, r"[^a-zA-Z0-9_:]", "_")
    return F.when(clean.rlike(r"^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def refresh_target(html: Column) -> Column:
    """Where a page sends its reader: meta refresh, else a script's location."""
    meta = F.regexp_extract(html, r"(?is)<meta[^>]+http-equiv=[\"']?refresh[\"']?[^>]*url=([^\"'>\s]+)", 1)
    script = F.regexp_extract(html, r"(?is)location(?:\.href)?\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.coalesce(F.nullif(meta, F.lit("")), F.nullif(script, F.lit("")))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*href=["']([^"']*)["']"""), F.lit(1))


def image_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?is)<img\s[^>]*src=["']([^"']*)["']"""), F.lit(1))


#: Ranges of characters that take two columns.
WIDE = "ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦"


def display_width(text: Column) -> Column:
    """Columns that a terminal needs: wide characters count two."""
    return (F.length(text) + F.regexp_count(text, F.lit(f"[{WIDE}]"))).cast("long")


def truncated(text: Column, columns: int) -> Column:
    """``text``, or as much of it as fits before an ellipsis."""
    signs = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("kept"), F.lit(True).alias("open"))

    def add(state: Column, sign: Column) -> Column:
        used = state["used"] + F.when(sign.rlike(f"[{WIDE}]"), 2).otherwise(1)
        fits = state["open"] & (used <= columns - 1)
        return F.struct(used.alias("used"), F.when(fits, F.concat(state["kept"], sign)).otherwise(state["kept"]).alias("kept"), fits.alias("open"))

    return F.when(display_width(text) <= columns, text).otherwise(F.concat(F.aggregate(signs, start, add, lambda s: s["kept"]), F.lit("…")))


def iso_utc(text: Column) -> Column:
    """A time in ISO form, dashed or compact, with or without seconds, fractions and an offset (none: UTC); null for anything else."""
    steps = (
        (r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3"),
        (r"^([\d-]{10}[T ]\d{2})(\d{2})(?=$|\d{2}|[Z+-])", "$1:$2"),
        (r"^([\d-]{10}[T ]\d{2}:\d{2})(\d{2})(?=$|[.,Z+-])", "$1:$2"),
        # offsets of hours alone, or without a colon
        (r"^(.{11,}[+-]\d{2})(\d{2})$", "$1:$2"),
        (r"^(.{11,}[+-]\d{2})$", "$1:00"),
        (r"^([\d-]{10}[T ]\d{2})(?=$|Z|[+-])", "$1:00"),
        (r"^([\d-]{10})$", "$1T00:00"),
        (r"^([\d-]{10}[T ]\d{2}:\d{2})(?=$|Z|[+-])", "$1:00"),
        # without an offset the session's zone would count
        (r"^(.{11,}(?<!Z)(?<![+-]\d{2}:\d{2}))$", "$1Z"),
        (",", "."),
    )
    plain = F.trim(text)
    for pattern, made in steps:
        plain = F.regexp_replace(plain, pattern, made)
    sound = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
    return F.transform(F.array(plain), lambda x: F.when(x.rlike(sound), x.try_cast("timestamp")))[0]
