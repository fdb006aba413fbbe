"""Event-sourced tables: projection, reconciliation, healing, integrity, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumasift.scratch import saved

#: Status that each event type sets.
STATUS = {"added": "pending", "approved": "approved", "rejected": "rejected", "submitted": "submitted"}
#: Transitions that may follow a status.
NEXT = {"pending": ("approved", "rejected"), "approved": ("submitted",)}


def status_of(event_type: Column) -> Column:
    made = None
    for kind, status in STATUS.items():
        made = F.when(event_type == kind, status) if made is None else made.when(event_type == kind, status)
    return made


def projection(events: DataFrame) -> DataFrame:
    """Per entry what the events make of it: status, note, chain of statuses, counts.

    One partial aggregation by entry; the chain is a sorted list of (seq, status).
    """
    status = status_of(F.col("event_type"))
    has_note = (F.col("note") != "") & status.isNotNull()
    return events.groupBy("entry_id").agg(
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("status"),
        F.max_by("note", F.when(has_note, F.col("seq"))).alias("note"),
        F.transform(F.array_sort(F.collect_list(F.when(status.isNotNull(), F.struct("seq", status.alias("status"))))), lambda x: x["status"]).alias("chain"),
        F.min("seq").alias("created_seq"),
        F.count("*").alias("events"),
        F.count(F.when(status.isNull(), 1)).alias("other_events"),
    )


def query(events: DataFrame, entry_id: int | None = None, event_type: str | None = None, seq_from: int | None = None, seq_to: int | None = None) -> DataFrame:
    """Events in order that meet all conditions given."""
    if seq_from is not None and seq_to is not None and seq_from > seq_to:
        raise ValueError(f"seq_from {seq_from} lies behind seq_to {seq_to}")
    tests = (("entry_id", entry_id, "=="), ("event_type", event_type, "=="), ("seq", seq_from, ">="), ("seq", seq_to, "<="))
    for name, value, how in tests:
        if value is not None:
            events = events.filter(F.col(name) == value if how == "==" else F.col(name) >= value if how == ">=" else F.col(name) <= value)
    return events.orderBy("seq")


def reachable(start: Column, end: Column) -> Column:
    """Whether transitions lead from one status to another."""
    steps = {s: set(n) for s, n in NEXT.items()}
    for s in list(steps):
        steps[s] |= {x for n in NEXT[s] for x in NEXT.get(n, ())}
    made = F.lit(False)
    for s, ends in steps.items():
        made = made | ((start == s) & end.isin(*sorted(ends)))
    return made


def reconcile(projected: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences of the projection and the actual table (entry_id, status, note).

    Kinds: the ledger lacks the entry; events are ahead of the table; statuses
    disagree; notes disagree.  Status goes before fields.
    """
    both = projected.select("entry_id", F.col("status").alias("expected_status"), F.col("note").alias("expected_note"), "created_seq").join(
        actual.select("entry_id", F.col("status").alias("actual_status"), F.col("note").alias("actual_note")), "entry_id", "full_outer"
    )
    e, a = F.col("expected_status"), F.col("actual_status")
    kind = (
        F.when(e.isNull(), "账本缺失")
        .when(a.isNull() | reachable(a, e), "事件超前")
        .when(e != a, "状态不一致")
        .when(~F.col("expected_note").eqNullSafe(F.col("actual_note")), "字段不一致")
    )
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("entry_id", "kind", "expected_status", "actual_status")


def heal_plan(differences: DataFrame) -> DataFrame:
    """Transitions, in order, that would bring entries whose events are ahead up to date.  A plan only."""
    path = F.when((F.col("actual_status") == "pending") & (F.col("expected_status") == "submitted"), F.array(F.lit("approved"), F.lit("submitted"))).otherwise(F.array("expected_status"))
    ahead = differences.filter((F.col("kind") == "事件超前") & F.col("actual_status").isNotNull())
    return ahead.select("entry_id", F.posexplode(path).alias("step", "to_status"))


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events whose status may not follow the one before."""
    changes = events.withColumn("to_status", status_of(F.col("event_type"))).filter(F.col("to_status").isNotNull())
    before = F.lag("to_status").over(Window.partitionBy("entry_id").orderBy("seq"))
    legal = F.lit(False)
    for s, ends in NEXT.items():
        legal = legal | ((F.col("from_status") == s) & F.col("to_status").isin(*ends))
    return changes.withColumn("from_status", before).filter(F.col("from_status").isNotNull() & ~legal).select("entry_id", "seq", "from_status", "to_status")


def merkle_root(leaves: DataFrame, order: str, leaf: str) -> DataFrame:
    """Root of a binary hash tree over hex ``leaf`` in ``order``; an odd level repeats its last node.

    Each round halves the nodes: node i of a level joins its pair by i // 2.
    One row: root and how many leaves.  Without leaves the root hashes nothing.
    """
    spark = leaves.sparkSession
    # positions without one task for all rows: counts of range partitions first
    ranged = leaves.select(order, leaf).repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    ranged = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1)
    ranged = saved(ranged, "merkle-leaves")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = saved(ranged.join(sizes.select("__part", before.alias("__before")), "__part").select((F.col("__before") + F.col("__nth")).alias("i"), F.col(leaf).alias("h")), "merkle-0")
    n = count = level.count()
    if not n:
        return spark.createDataFrame([("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", 0)], "root string, leaves long")
    k = 0
    while count > 1:
        k += 1
        right = F.coalesce(F.max(F.when(F.pmod("i", F.lit(2)) == 1, F.col("h"))), F.max(F.when(F.pmod("i", F.lit(2)) == 0, F.col("h"))))
        pairs = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.sha2(F.unhex(F.concat(F.max(F.when(F.pmod("i", F.lit(2)) == 0, F.col("h"))), right)), 256).alias("h"))
        level = saved(pairs, f"merkle-{k}")
        count = -(-count // 2)
    return level.select(F.col("h").alias("root"), F.lit(n).cast("long").alias("leaves"))


def timer_stats(samples: DataFrame, name: str, order: str, value: str, last: int = 256) -> DataFrame:
    """Count, mean, p95 and max of the last samples of each timer.

    p95 is the sample at the half-even rounded rank of 0.95 n.
    """
    recent = samples.withColumn("back", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(order)))).filter(F.col("back") <= last)
    ranked = recent.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy(value)))
    sized = ranked.withColumn("n", F.count("*").over(Window.partitionBy(name)))
    pick = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(0.95), 0).cast("int"))
    return sized.groupBy(name).agg(F.max("n").alias("n"), F.avg(value).alias("mean"), F.max(F.when(F.col("rank") == pick, F.col(value))).alias("p95"), F.max(value).alias("max"))


def span_tree(spans: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """trace_id, span_id, depth, root: spans below roots (no parent, or an absent one).

    One join on (trace, parent) and one table a level, until a level is empty;
    spans in a circle have no root and are absent.  Deeper trees than
    ``max_depth`` are an error.
    """
    spans = saved(spans.select("trace_id", "span_id", "parent_span_id"), "spans")
    known = spans.select(F.col("trace_id").alias("known_trace"), F.col("span_id").alias("known_id"))
    rooted = spans.join(known, (F.col("trace_id") == F.col("known_trace")) & (F.col("parent_span_id") == F.col("known_id")), "left_anti")
    level = saved(rooted.select("trace_id", "span_id", F.lit(0).alias("depth"), F.col("span_id").alias("root")), "spans-0")
    children = spans.select(F.col("trace_id").alias("of_trace"), F.col("span_id").alias("child_id"), F.col("parent_span_id").alias("parent_id")).filter(F.col("parent_id").isNotNull())
    found, depth = level, 0
    while True:
        depth += 1
        level = level.join(children, (F.col("trace_id") == F.col("of_trace")) & (F.col("span_id") == F.col("parent_id"))).select("trace_id", F.col("child_id").alias("span_id"), F.lit(depth).alias("depth"), "root")
        level = saved(level, f"spans-{depth}")
        if not level.take(1):
            return found
        if depth >= max_depth:
            raise ValueError(f"spans lie deeper than {max_depth}")
        found = found.unionByName(level)
