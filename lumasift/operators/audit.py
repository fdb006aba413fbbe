"""Append-only audit logs with hash trees: roots of prefixes, and verification of whole logs.

A log is JSON lines.  An event line carries ``merkle_leaf``, the SHA-256 of the
rest of the line as canonical JSON; a ``merkle_checkpoint`` line states root,
leaf count and height of the tree so far; after a ``merkle_degraded`` line
events come without leaves, and the next leaf starts a new tree (segment).

A tree pairs nodes level by level, a last odd one with itself.  The root of a
prefix of c leaves follows from at most log2(c) perfect subtrees (peaks), one for
each bit of c.  So all perfect subtrees are made once, ``STEP`` levels a pass by
grouping runs of leaves, and every checkpoint fetches its peaks by an equi-join:
a checkpoint costs log2(c) rows however long the log is.

States that run along the log (degraded, segment, leaves so far) are running
values within blocks of ``BLOCK`` lines, carried from block to block by a table
with one row a block; no task holds the log.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumasift.scratch import saved

#: Lines that one task runs along, and levels of a tree that one pass makes.
BLOCK, STEP = 1 << 16, 6
#: Failures that a report lists.
LISTED = 50

#: Fixed values of the log's format.
CHECKPOINT, DEGRADED, LEAF = "merkle_checkpoint", "merkle_degraded", "merkle_leaf"
HASH_ALGO, SIGN_ALGO = "SHA-256", "HMAC-SHA256"
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


# -- canonical JSON -------------------------------------------------------------------------------


def canonical(value: object) -> str:
    """Keys in order, no blanks, letters of any script as they are, numbers as Python writes them."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null for null and for what is no JSON."""

    def form(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(json.loads(text))
        except ValueError:
            return None

    return texts.map(form, na_action="ignore")


def leaf_hash(text: Column) -> Column:
    """SHA-256 of a record, given as JSON text, in canonical form."""
    return F.sha2(canonical_json(text).cast("binary"), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC of a text, by two hashes with the padded key."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (F.lit(bytearray(b ^ pad for b in key.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signature(root: Column, leaf_count: Column, key: bytes) -> Column:
    return hmac_sha256(key, F.concat(F.lit('{"leaf_count":'), leaf_count.cast("string"), F.lit(',"root":"'), root, F.lit('"}')))


# -- trees ----------------------------------------------------------------------------------------


def paired(left: Column, right: Column) -> Column:
    return F.sha2(F.unhex(F.concat(left, right)), 256)


def height_of(count: Column) -> Column:
    """Levels above the leaves."""
    return F.when(count > 1, F.length(F.bin(count - 1))).otherwise(F.lit(0)).cast("long")


def perfect_nodes(leaves: DataFrame, step: int = STEP) -> DataFrame:
    """(tree, level, i, h) of all perfect subtrees over ``leaves`` (tree, i from 0, h), leaves included."""
    tables = [saved(leaves.select("tree", F.lit(0).alias("level"), F.col("i").cast("long").alias("i"), "h"), "peaks-0")]
    longest = (tables[0].agg(F.max("i")).first()[0] or 0) + 1
    level = 0
    while longest > 1:
        runs = tables[-1].filter(F.col("level") == level).groupBy("tree", F.shiftright("i", step).alias("run")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("nodes"))
        pairs = lambda nodes: F.transform(F.sequence(F.lit(1), F.floor(F.size(nodes) / 2).cast("int")), lambda k: paired(nodes[2 * k - 2], nodes[2 * k - 1]))
        up = lambda acc, _: F.array_append(acc, F.when(F.size(F.element_at(acc, -1)) > 1, pairs(F.element_at(acc, -1))).otherwise(F.array().cast("array<string>")))
        rows = F.aggregate(F.sequence(F.lit(1), F.lit(step)), F.array(F.transform("nodes", lambda x: x["h"])), up)
        made = (
            runs.select("tree", "run", F.posexplode(rows).alias("above", "row"))
            .filter("above > 0")
            .select("tree", (F.col("above") + level).alias("level"), "above", "run", F.posexplode("row").alias("at", "h"))
            .select("tree", "level", (F.expr(f"shiftleft(run, {step} - above)") + F.col("at")).alias("i"), "h")
        )
        level += step
        tables.append(saved(made, f"peaks-{level}"))
        longest >>= step
    return reduce(DataFrame.unionByName, tables)


def _folded(peaks: Column, count: Column) -> Column:
    """The root over ``count`` leaves from a map of levels to peaks."""

    def step(x: Column, level: Column) -> Column:
        p = F.try_element_at(peaks, level)
        return F.when(x.isNotNull(), paired(F.coalesce(p, x), x)).when(p.isNotNull(), paired(p, p))

    height = height_of(count).cast("int")
    levels = F.when(height > 0, F.sequence(F.lit(0), height - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(count == 0, F.lit(EMPTY_ROOT)).otherwise(F.coalesce(F.aggregate(levels, F.lit(None).cast("string"), step), F.try_element_at(peaks, height)))


def prefix_roots(leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (tree, count, ...) with root and height of the tree's first ``count`` leaves."""
    nodes = perfect_nodes(leaves)
    asked = wanted.select("tree", "count").distinct()
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit("count", b) == 1)
    peaks = asked.select("tree", "count", F.explode(bits).alias("level")).withColumn("i", F.expr("shiftright(count, level)") - 1)
    met = peaks.join(nodes, ["tree", "level", "i"]).groupBy("tree", "count").agg(F.map_from_entries(F.collect_list(F.struct("level", "h"))).alias("peaks"))
    roots = asked.join(met, ["tree", "count"], "left").select("tree", "count", _folded(F.col("peaks"), F.col("count")).alias("root"), height_of(F.col("count")).alias("height"))
    return wanted.join(roots, ["tree", "count"])


# -- logs -----------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(nth from 1, line) of text files, in order of paths and places, whatever tasks read them."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    read = saved(read.withColumn("at", F.monotonically_increasing_id()), "log-lines")
    # a task reads a block from end to end: a row a block
    blocks = read.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("path", "start", (before - F.col("first") + 1).alias("shift"))
    return read.join(blocks, ["path", "start"]).select((F.col("at") + F.col("shift")).alias("nth"), F.col("value").alias("line"))


_KINDS = {"leaf_count": T.LongType(), "height": T.LongType(), "signed": T.BooleanType()}
_PARSED = T.StructType([T.StructField(n, _KINDS.get(n, T.StringType())) for n in ("kind", "recorded", "replayed", "note", "algo", "root", "leaf_count", "height", "sign_algo", "signature", "signed")])


def _whole(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63 else None


def _text(value: object) -> str | None:
    return value if isinstance(value, str) and value else None


@F.pandas_udf(_PARSED)
def _parsed(lines: pd.Series) -> pd.DataFrame:
    names = _PARSED.names

    def form(line: str) -> dict:
        line = line.strip()
        if not line:
            return {"kind": "blank"}
        try:
            record = json.loads(line)
        except ValueError:
            return {"kind": "json"}
        if not isinstance(record, dict):
            return {"kind": "object"}
        event = record.get("event")
        if event == CHECKPOINT:
            texts = {k: _text(record.get(k)) for k in ("algo", "root", "sign_algo", "signature")}
            return {"kind": "checkpoint", "leaf_count": _whole(record.get("leaf_count")), "height": _whole(record.get("height")), "signed": record.get("signed") is True, **texts}
        if event == DEGRADED:
            return {"kind": "degraded", "note": str(record.get("reason") or "")}
        if LEAF not in record:
            return {"kind": "plain"}
        recorded = _text(record.pop(LEAF))
        return {"kind": "leaf" if recorded else "no leaf", "recorded": recorded, "replayed": hashlib.sha256(canonical(record).encode("utf-8", "surrogatepass")).hexdigest()}

    found = [form(line) for line in lines]
    out = pd.DataFrame({n: pd.Series([f.get(n) for f in found], dtype=object) for n in names})
    return out.assign(leaf_count=out["leaf_count"].astype("Int64"), height=out["height"].astype("Int64"))


def _running(lines: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Parsed lines with segment, leaves before them in it, degraded, started and the line where a degraded range ends."""
    spot = (F.floor((F.col("nth") - 1) / block)).alias("block")
    text = F.coalesce(F.col("line"), F.lit(""))
    parsed = lines.select("nth", spot, _parsed(text).alias("p")).select("nth", "block", "p.*")
    parsed = saved(parsed.withColumn("turn", F.when(F.col("kind") == "degraded", "D").when(F.col("kind").isin("leaf", "no leaf"), "L")), "log-parsed")
    total = parsed.agg(F.max("nth")).first()[0] or 0

    earlier, later = (Window.orderBy(way).rowsBetween(Window.unboundedPreceding, -1) for way in (F.asc("block"), F.desc("block")))
    inside = Window.partitionBy("block").orderBy("nth")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # in falling order: a frame that only grows is a running value, one that shrinks is folded anew for every line
    behind = Window.partitionBy("block").orderBy(F.desc("nth")).rowsBetween(Window.unboundedPreceding, -1)
    leaf, turn_at = (F.col("kind") == "leaf").cast("long"), F.when(F.col("turn").isNotNull(), F.col("nth"))
    signal = F.col("kind").isin("leaf", "checkpoint", "degraded").cast("int")

    blocks = parsed.groupBy("block").agg(F.max_by("turn", turn_at).alias("turn_"), F.sum(leaf).alias("leaves_"), F.max(signal).alias("signal_"), F.min(turn_at).alias("next_"))
    carried = blocks.select(
        "block",
        F.last("turn_", ignorenulls=True).over(earlier).alias("turn_"),
        F.coalesce(F.sum("leaves_").over(earlier), F.lit(0)).alias("leaves_"),
        F.coalesce(F.max("signal_").over(earlier), F.lit(0)).alias("signal_"),
        F.min("next_").over(later).alias("next_"),
    )
    placed = (
        parsed.join(carried, "block")
        .withColumn("degraded", F.coalesce(F.last("turn", ignorenulls=True).over(before), F.col("turn_"), F.lit("L")) == "D")
        .withColumn("leaves", F.coalesce(F.sum(leaf).over(before), F.lit(0)) + F.col("leaves_"))
        .withColumn("started", F.greatest(F.coalesce(F.max(signal).over(before), F.lit(0)), F.col("signal_")) == 1)
        .withColumn("ends", F.when(F.col("kind") == "degraded", F.coalesce(F.min(turn_at).over(behind) - 1, F.col("next_") - 1, F.lit(total))))
        .withColumn("opens", (F.col("turn") == "L") & F.col("degraded"))
        .drop("turn_", "leaves_", "signal_", "next_")
    )
    placed = saved(placed, "log-states")
    opened_at = F.when(F.col("opens"), F.col("leaves"))
    blocks = placed.groupBy("block").agg(F.sum(F.coalesce(F.col("opens"), F.lit(False)).cast("long")).alias("opens_"), F.max(opened_at).alias("base_"))
    carried = blocks.select("block", F.coalesce(F.sum("opens_").over(earlier), F.lit(0)).alias("opens_"), F.max("base_").over(earlier).alias("base_"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.coalesce(F.max(opened_at).over(upto), F.col("base_"), F.lit(0))
    opens = F.sum(F.coalesce(F.col("opens"), F.lit(False)).cast("long")).over(upto)
    return placed.join(carried, "block").withColumn("segment", opens + F.col("opens_")).withColumn("count", F.col("leaves") - base).drop("opens_", "base_"), total


class Audit:
    """What verification found.

    lines: nth, segment, kind, reason (null where nothing is wrong).
    checkpoints: nth, segment, count, replayed root and height, reason.
    degraded: start, end, reason of ranges without leaves.
    """

    def __init__(self, lines: DataFrame, checkpoints: DataFrame, degraded: DataFrame, total: int, cut: bool):
        self.lines, self.checkpoints, self.degraded, self.total, self.cut = lines, checkpoints, degraded, total, cut

    def failures(self, most: int = LISTED) -> DataFrame:
        """The first lines that are wrong."""
        return self.lines.filter(F.col("reason").isNotNull()).select("nth", "reason").orderBy("nth").limit(most)

    def report(self) -> DataFrame:
        """One row: counts, unsealed leaves, sealed (null without a tree) and exit_code (0: sound, 2: not)."""
        is_ = lambda kind: F.col("kind") == kind
        n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        fine = F.col("reason").isNull()
        # the last segment's leaves that no checkpoint which holds covers
        last = F.struct("segment", F.col("covers"))
        row = self.lines.withColumn("covers", F.when(is_("checkpoint") & fine, F.struct("nth", "count"))).agg(
            F.count("*").alias("total_lines"),
            n(is_("leaf") & fine).alias("verified_events"),
            n(is_("checkpoint")).alias("checkpoints_total"),
            n(is_("checkpoint") & fine).alias("checkpoints_passed"),
            n(is_("checkpoint") & (F.col("sign") == "verified")).alias("signatures_verified"),
            n(is_("checkpoint") & (F.col("sign") == "unverified")).alias("signatures_unverified"),
            n(is_("plain") & ~F.col("started") & ~F.col("degraded")).alias("legacy_lines"),
            n(is_("degraded")).alias("degraded_markers"),
            n(is_("plain") & F.col("degraded")).alias("degraded_events"),
            (F.coalesce(F.max("segment"), F.lit(0)) + 1).alias("segments"),
            n(~fine).alias("failures_total"),
            F.max(F.struct("segment", F.when(is_("leaf"), F.col("count") + 1).otherwise(F.col("count")).alias("end"))).alias("end"),
            F.max(F.when(F.col("covers").isNotNull(), last)).alias("seal"),
            F.max((F.col("started") | is_("leaf") | is_("checkpoint") | is_("degraded")).cast("int")).alias("tree"),
        )
        sealed = F.when(F.col("seal.segment") == F.col("end.segment"), F.col("seal.covers.count")).otherwise(0)
        unsealed = F.when(F.col("tree") == 1, F.greatest(F.lit(0), F.col("end.end") - F.coalesce(sealed, F.lit(0)))).otherwise(0)
        return row.withColumns({"unsealed": unsealed.cast("long"), "sealed": F.when(F.col("tree") == 1, unsealed == 0), "exit_code": F.when(F.col("failures_total") > 0, 2).otherwise(0), "scan_truncated": F.lit(self.cut)}).drop("end", "seal", "tree")


def verify_log(lines: DataFrame, key: bytes | None = None, block: int = BLOCK) -> Audit:
    """Replays a log (nth from 1 without gaps, line) and holds every checkpoint against it.

    Wrong are: blank lines, lines that are no JSON or no object, leaves that
    aren't their line's hash, lines without a leaf where a tree has begun, and
    checkpoints whose algorithm, root, count, height or signature doesn't hold.
    A leaf that is wrong still stands in the tree as replayed, so later
    checkpoints of its segment fail as well.  Lines from the first one that is no
    UTF-8 on are not read; that line is the last failure.
    """
    broken = lines.filter(~F.is_valid_utf8("line")).agg(F.min("nth")).first()[0]
    placed, total = _running(lines if broken is None else lines.filter(F.col("nth") < broken), block)
    placed = saved(placed, "log-placed")
    leaves = placed.filter(F.col("kind") == "leaf").select(F.col("segment").alias("tree"), F.col("count").alias("i"), F.col("replayed").alias("h"))
    stated = placed.filter(F.col("kind") == "checkpoint").select("nth", F.col("segment").alias("tree"), "count", "algo", F.col("root").alias("stated"), "leaf_count", F.col("height").alias("stated_height"), "sign_algo", "signature", "signed")
    roots = prefix_roots(leaves, stated)

    sound = F.col("stated").isNotNull() & F.col("leaf_count").isNotNull()
    compared = sound & F.col("stated_height").isNotNull()
    asks = F.col("signed") | F.col("signature").isNotNull()
    signable = asks & F.col("signature").isNotNull() & (F.coalesce(F.col("sign_algo"), F.lit("")) == SIGN_ALGO) & sound
    if key is None:
        unsigned, sign = F.lit(False), F.when(~asks | signable, "unverified")
    else:
        right = signature(F.col("stated"), F.col("leaf_count"), key) == F.lower("signature")
        unsigned, sign = signable & ~right, F.when(~asks, "unverified").when(signable & right, "verified")
    wrong = [
        (F.coalesce(F.col("algo"), F.lit("")) != HASH_ALGO, "algo"),
        (F.col("stated").isNull(), "no root"),
        (F.col("leaf_count").isNull(), "no count"),
        (F.col("stated_height").isNull(), "no height"),
        (compared & (F.col("root") != F.col("stated")), "root"),
        (compared & (F.col("count") != F.col("leaf_count")), "count"),
        (compared & (F.col("height") != F.col("stated_height")), "height"),
        (asks & F.col("signature").isNull(), "no signature"),
        (F.col("signature").isNotNull() & (F.coalesce(F.col("sign_algo"), F.lit("")) != SIGN_ALGO), "sign algo"),
        (unsigned, "signature"),
    ]
    why = F.concat_ws(";", *[F.when(c, F.lit(said)) for c, said in wrong])
    checked = saved(roots.select("nth", F.col("tree").alias("segment"), "count", "root", "height", F.when(why != "", F.concat(F.lit("checkpoint:"), why)).alias("reason"), sign.alias("sign")), "log-checkpoints")

    kind = F.col("kind")
    reason = (
        F.when(kind.isin("blank", "json", "object"), kind)
        .when(kind == "no leaf", "leaf field")
        .when((kind == "leaf") & (F.col("replayed") != F.col("recorded")), "leaf")
        .when((kind == "plain") & F.col("started") & ~F.col("degraded"), "leafless")
    )
    own = placed.join(checked.select("nth", F.col("reason").alias("said"), "sign"), "nth", "left")
    every = own.select("nth", "segment", "kind", F.coalesce(reason, F.col("said")).alias("reason"), "count", "started", "degraded", "sign")
    if broken is not None:
        last = lines.sparkSession.range(1).select(F.lit(broken).cast("long").alias("nth"), F.lit("bytes").alias("kind"), F.lit("bytes").alias("reason"))
        every = every.unionByName(last, allowMissingColumns=True)
    degraded = placed.filter(kind == "degraded").select(F.col("nth").alias("start"), F.col("ends").alias("end"), F.col("note").alias("reason"))
    return Audit(every, checked.drop("sign"), degraded, total, broken is not None)


def checkpoint_line(root: Column, count: Column, height: Column, key: bytes | None = None) -> Column:
    """A checkpoint as JSON text, signed if there is a key."""
    sign = F.lit("") if key is None else signature(root, count, key)
    fields = {"event": F.lit(CHECKPOINT), "algo": F.lit(HASH_ALGO), "root": root, "leaf_count": count, "height": height, "sign_algo": F.lit(SIGN_ALGO), "signature": sign, "signed": F.lit(key is not None)}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
