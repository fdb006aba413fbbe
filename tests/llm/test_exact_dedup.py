import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from lumasift.llm import exact_dedup as X

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, ""), (5, None), (None, "a"), (7, "x" * 5000), (8, "x" * 5000), (8, "x" * 5000), (9, "A"), (10, "a "), (2, "b")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize("budget", [1, 300, 1 << 20])
def test_assign(spark, budget):
    df = spark.createDataFrame([(i, t, i) for i, t in ROWS], "doc_id long, text string, keep_id long").repartition(3)
    got = X.assign(df, local_budget=budget, grace_budget=budget).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(ROWS)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({t or "" for _, t in ROWS}) and all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_survivors_keep_columns(spark, budget):
    df = spark.createDataFrame([(i, t, str(i), i) for i, t in ROWS], "doc_id long, text string, source string, n long").repartition(3)
    got = X.survivors(df, local_budget=budget, grace_budget=budget)
    assert got.columns == df.columns
    rows = {r["text"] or "": r["doc_id"] for r in got.collect()}
    assert rows == {"a": 3, "b": 2, "": 5, "x" * 5000: 8, "A": 9, "a ": 10} and got.count() == 6


def test_all_ids_null_and_empty_table(spark):
    got = X.assign(spark.createDataFrame([(None, "q"), (None, "q")], "doc_id long, text string")).collect()
    assert [r["group_size"] for r in got] == [2, 2] and sum(r["kept"] for r in got) == 1
    assert X.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert X.survivors(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_hashes_end(tmp_path):
    rows = [(42, bytes([k]), (k,)) for k in range(40)] * 2
    seen = [(done.table.contents[e], r[0]) for done in X.grace(iter(rows), 400, str(tmp_path)) for part in done.members.parts() for e, r in part]
    assert sorted(seen) == sorted([(bytes([k]), k) for k in range(40)] * 2)


def test_members_and_spilled_rows_in_files(tmp_path, monkeypatch):
    monkeypatch.setattr(X, "MEMBER_ROWS", 7)
    monkeypatch.setattr(X, "SPILL_BYTES", 500)
    rows = [(k % 50, b"t%d" % (k % 50), (k, k)) for k in range(600)]
    found = {}
    for done in X.grace(iter(rows), 900, str(tmp_path), weight=lambda row: 2):
        for part in done.members.parts():
            for e, row in part:
                found[row[1]] = (done.table.contents[e], done.leads[e][0], done.weights[e])
    assert found == {k: (b"t%d" % (k % 50), 550 + k % 50, 24) for k in range(600)}


def test_a_hot_text_takes_no_memory(spark, tmp_path):
    """400 MB of rows of one text: a task holds that text, ids and one row."""
    import tracemalloc
    from types import SimpleNamespace

    text = "x" * 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([text] * 2000)], names=["doc_id", "text"])
    real, X.TaskContext = X.TaskContext, SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    try:
        tracemalloc.start()
        X_emitted = []
        for _ in X._local(1 << 26, lambda first, ids, null, entries, table: iter([X_emitted.append((len(ids), len(table)))]))(iter([batch] * 20)):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        X.TaskContext = real
    assert X_emitted == [(40_000, 1)] and peak < 20 << 20


def test_very_long_texts_and_other_columns(spark):
    rows = [(1, "y" * 3_000_000, [1, 2], {"a": "b"}), (2, "y" * 3_000_000, [3], None), (3, None, None, {"c": None})]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept array<int>, part map<string,string>")
    for budget in (1 << 10, 1 << 26):
        got = sorted(X.survivors(df, local_budget=budget, grace_budget=budget).collect(), key=lambda r: r["doc_id"])
        assert [(r["doc_id"], r["kept"], r["part"]) for r in got] == [(2, [3], None), (3, None, {"c": None})]
        assert sorted((r["doc_id"], r["keep_id"]) for r in X.assign(df, local_budget=budget, grace_budget=budget).collect()) == [(1, 2), (2, 2), (3, 3)]
