"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating.
They share ``share`` of all sizes by weight, none above ``cap`` times its own
size; the excess goes to the others by weight.  With sources in order of
cap / weight the level of this filling is a running sum, so no loop is needed.

Rounding: a document of a source with target / size = k + f is taken k times,
and once more with probability f.  Its open mass, f times its size in words, is
paired with that of another document of the source: words move from one to the
other, in a direction drawn at random so that expectations stay, until one of
the two is empty or full.  Chains of at most ``FAN_IN`` documents are folded in
one row, one open document is left of each, and these are folded in turn: a
reduction tree whose levels shrink by ``FAN_IN``.  Moves keep the source's words
exactly; only the last open document of a source is rounded by a draw.

So that it is not a large one, the ``FIRST`` largest open documents of a source
are settled before: the other of the pair is then all smaller ones together.  A
document of size s and open mass m fills with the chance m / s, and the others
lose s - m words in proportion to their masses, or it empties and they get m
words in proportion to their rooms; expectations stay.  If the others can bear
only one of the two, that one is taken, as no mix near the target has the other;
if neither, the document waits for the tree.  What is done to the others is one
affine map a source, so it costs a row a source.

Draws are hashes of the documents' ids, sizes and the place in the tree, so a
rerun agrees.  A hot source is many chains, dealt by hash.

Defined results: null text has size 0; a document of size 0 has target shares
but takes 0 words; a source of size 0 has target 0; rows that repeat an id are
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumasift.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, CAP, FAN_IN, FIRST = 1.5, 2.0, 64, 64
_SEED = 20240917


def word_count(text: Column) -> Column:
    """Words of a text (null: 0): each becomes one mark, and all white space goes."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row per source: source, source_size, target.  ``sizes`` has source and size."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = (
        weighed.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
        .withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    )
    # the first source that is not full fixes the level of all after it
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.withColumn("final", level).select(
        "source",
        "source_size",
        "rows",
        F.when(F.col("full") | F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w"))).alias("target"),
    )


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(_SEED), *parts), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _unit(x: Column, mass: Column) -> Column:
    return F.struct(x["key"].alias("key"), x["size"].alias("size"), mass.alias("mass"), x["draw"].alias("draw"))


def _meet(a: Column, b: Column) -> Column:
    """Move words between two open documents until one is empty or full."""
    room_a, room_b = a["size"] - a["mass"], b["size"] - b["mass"]
    up = F.least(room_a, b["mass"])  # words that a can get from b
    down = F.least(a["mass"], room_b)
    a_gains = _draw(a["draw"], b["draw"]) * (up + down) < down
    a_mass = F.when(a_gains, F.when(room_a <= b["mass"], a["size"]).otherwise(a["mass"] + b["mass"])).otherwise(F.when(a["mass"] <= room_b, F.lit(0.0)).otherwise(a["mass"] - room_b))
    b_mass = F.when(a_gains, F.when(room_a <= b["mass"], b["mass"] - room_a).otherwise(F.lit(0.0))).otherwise(F.when(a["mass"] <= room_b, b["mass"] + a["mass"]).otherwise(b["size"]))
    return F.array(_unit(a, a_mass), _unit(b, b_mass))


def _is_open(x: Column) -> Column:
    return (x["mass"] > F.lit(1e-9)) & (x["mass"] < x["size"] - F.lit(1e-9))


_UNIT = "struct<key:struct<doc_id:bigint,text_hash:bigint,rows:bigint,copies:bigint,more:bigint,source_size:bigint,target:double>,size:double,mass:double,draw:bigint>"


def _fold(units: Column) -> Column:
    """A chain's documents after all meetings: {done: settled documents, open: the one left, or none}."""
    start = F.struct(F.array().cast(f"array<{_UNIT}>").alias("done"), F.array().cast(f"array<{_UNIT}>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        met = F.when(F.size(acc["open"]) == 0, F.array(x)).otherwise(_meet(acc["open"][0], x))
        return _bind(
            met,
            lambda m: F.struct(
                F.concat(acc["done"], F.filter(m, lambda u: ~_is_open(u))).alias("done"),
                F.filter(m, _is_open).alias("open"),
            ),
        )

    return F.aggregate(units, start, step)


def _settled(items: DataFrame, fan_in: int) -> DataFrame:
    """``items`` (source, unit) with every unit's mass moved to 0 or its size."""
    left, done, level = items, None, 0
    rows = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while True:
        counts = left.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
        chains = F.ceil(F.col("n") / F.lit(fan_in // 2))
        folded = saved(
            left.join(counts, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("chain", F.pmod(F.xxhash64(F.lit(level), F.col("unit.draw")), chains))
            .groupBy("source", "chain")
            .agg(F.array_sort(F.collect_list(F.struct("unit.draw", "unit"))).alias("units"))
            .select("source", _fold(F.transform("units", lambda u: u["unit"])).alias("folded")),
            f"mix-{level}",
        )
        settled = folded.select("source", F.explode("folded.done").alias("unit"))
        done = settled if done is None else done.unionByName(settled)
        left = folded.select("source", F.explode("folded.open").alias("unit"))
        level, rows = level + 1, -(-rows // (fan_in // 2))
        if rows <= 1:
            break
    last = F.when(_draw(F.col("unit.draw"), F.lit(-1)) * F.col("unit.size") < F.col("unit.mass"), F.col("unit.size")).otherwise(F.lit(0.0))
    return done.unionByName(left.select("source", F.col("unit").withField("mass", last).alias("unit")))


_FIRST = f"struct<a:double,b:double,mass:double,size:double,units:array<{_UNIT}>>"


def _largest_first(units: Column, mass: Column, size: Column) -> Column:
    """The largest documents of a source after each was drawn against all smaller ones.

    {a, b: an open document's share p is a * p + b now; units: the documents with
    their mass}.  ``mass`` and ``size``: of all open documents of the source.
    """
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), mass.alias("mass"), size.alias("size"), F.array().cast(f"array<{_UNIT}>").alias("units")).cast(_FIRST)

    def step(acc: Column, u: Column) -> Column:
        left_mass, left_size = F.greatest(F.lit(0.0), acc["mass"] - u["mass"]), F.greatest(F.lit(0.0), acc["size"] - u["size"])
        now = F.greatest(F.lit(0.0), F.least(u["size"], acc["a"] * u["mass"] + acc["b"] * u["size"]))
        others = F.greatest(F.lit(0.0), F.least(left_size, acc["a"] * left_mass + acc["b"] * left_size))
        held = F.struct(now.alias("now"), others.alias("others"), (left_size - others).alias("room"))

        def drawn(x: Column) -> Column:
            need = u["size"] - x["now"]
            can_fill, can_empty = (x["others"] >= need) & (x["others"] > 0), (x["room"] >= x["now"]) & (x["room"] > 0)
            fills = can_fill & (~can_empty | (_draw(u["draw"], F.lit(-2)) * u["size"] < x["now"]))
            keep = F.when(fills, F.lit(1.0) - need / x["others"]).when(can_empty, F.lit(1.0) - x["now"] / x["room"]).otherwise(F.lit(1.0))
            settled = F.when(fills, u["size"]).when(can_empty, F.lit(0.0)).otherwise(x["now"])
            moved = F.when(fills | ~can_empty, keep * acc["b"]).otherwise(F.lit(1.0) - keep + keep * acc["b"])
            return F.struct((keep * acc["a"]).alias("a"), moved.alias("b"), left_mass.alias("mass"), left_size.alias("size"), F.array_append(acc["units"], _unit(u, settled)).alias("units")).cast(_FIRST)

        return _bind(held, drawn)

    return F.aggregate(units, start, step)


def _without_large(units: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Open units (source, unit) as (the ``first`` largest of each source, settled where that can be; the others with their mass now)."""
    order = F.struct((-F.col("unit.size")).alias("size"), F.col("unit.draw").alias("draw"))
    totals = units.groupBy("source").agg(F.sum("unit.mass").alias("mass"), F.sum("unit.size").alias("size"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(order))
    top = units.withColumn("place", place).filter(F.col("place") <= first).groupBy("source").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "unit"))).alias("top"))
    met = top.join(totals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    settled = saved(met.select("source", F.element_at("top", -1)["order"].alias("bound"), _largest_first(F.transform("top", lambda x: x["unit"]), F.col("mass"), F.col("size")).alias("x")), "mix-largest")
    large = settled.select("source", F.explode("x.units").alias("unit"))
    maps = settled.select(F.col("source").alias("of"), "bound", "x.a", "x.b")
    share = F.greatest(F.lit(0.0), F.least(F.col("unit.size"), F.col("a") * F.col("unit.mass") + F.col("b") * F.col("unit.size")))
    rest = units.join(maps, F.col("source").eqNullSafe(F.col("of"))).filter(order > F.col("bound")).select("source", F.col("unit").withField("mass", share).alias("unit"))
    return large, rest


def decide(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, fan_in: int = FAN_IN) -> DataFrame:
    """A row per distinct (doc_id, text, source): size, source_size, target, rows, copies, more.

    Of its ``rows`` equal rows each is taken ``copies`` times, and the first
    ``more`` of them once more.
    """
    sizes = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
        .groupBy("source", "doc_id", "text_hash", "size")
        .agg(F.count("*").alias("rows")),
        "mix-sizes",
    )
    goals = saved(targets(sizes.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, cap).withColumnRenamed("source", "of").drop("rows"), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        sizes.join(goals, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.floor(ratio + F.lit(1e-12)))
        .withColumn("open_rows", F.greatest(F.lit(0.0), ratio - F.col("copies")) * F.col("rows"))
        .withColumn("more", F.floor(F.col("open_rows") + F.lit(1e-12)))
        .select(
            "source",
            F.struct(
                F.struct("doc_id", "text_hash", "rows", "copies", "more", "source_size", "target").alias("key"),
                F.col("size").cast("double").alias("size"),
                (F.greatest(F.lit(0.0), F.col("open_rows") - F.col("more")) * F.col("size")).alias("mass"),
                F.xxhash64(F.lit(_SEED), "doc_id", "text_hash", "source", "size").alias("draw"),
            ).alias("unit"),
        )
    )
    unit = F.col("unit")
    large, rest = _without_large(units.filter(_is_open(unit)), FIRST)
    drawn = large.unionByName(rest)
    settled = _settled(drawn.filter(_is_open(unit)), fan_in).unionByName(drawn.filter(~_is_open(unit))).unionByName(units.filter(~_is_open(unit)))
    extra = F.when((unit["mass"] > 0) & (unit["mass"] > unit["size"] / 2), 1).otherwise(0)
    key = F.col("unit.key")
    return settled.select(
        key["doc_id"].alias("doc_id"), "source", key["text_hash"].alias("text_hash"), unit["size"].cast("long").alias("size"), key["source_size"].alias("source_size"),
        key["target"].alias("target"), key["rows"].alias("rows"), key["copies"].alias("copies"), (key["more"] + extra).alias("more"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    taken = F.col("size") * (F.col("copies") + F.when(F.col("i") <= F.col("more"), 1).otherwise(0))
    return (
        decide(docs, **options)
        .withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        .select("doc_id", "size", "source_size", "target", taken.alias("taken"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken (documents of no words stay out)."""
    names = docs.columns
    own = {n: f"__mix_{n}" for n in ("doc_id", "source", "text_hash", "rows", "copies", "more", "size")}
    chosen = decide(docs, **options).select(*[F.col(n).alias(a) for n, a in own.items()]).filter(F.col("__mix_size") > 0)
    keyed = docs.withColumn("__mix_of", F.xxhash64("text")).withColumn("__mix_id", F.col("doc_id").cast("long"))
    joined = keyed.join(
        chosen,
        F.col("__mix_id").eqNullSafe(F.col("__mix_doc_id")) & (F.col("__mix_of") == F.col("__mix_text_hash")) & F.col("source").cast("string").eqNullSafe(F.col("__mix_source")),
    )
    nth = F.row_number().over(Window.partitionBy("__mix_doc_id", "__mix_text_hash", "__mix_source").orderBy(F.lit(1)))
    times = F.col("__mix_copies") + F.when(F.col("__mix_nth") <= F.col("__mix_more"), 1).otherwise(0)
    return (
        joined.withColumn("__mix_nth", nth)
        .withColumn("__mix_times", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
        .select(*names)
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
