"""Stateful streams give what the batch operators give on the same rows, late rows included."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumasift.operators import sequential as S
from lumasift.plans.streams import ROCKSDB, _settings
from lumasift.sources import sinks
from lumasift.streaming import processors

START = datetime.datetime(2024, 1, 1)


def fed(spark, path, rows, schema, batches):
    """A stream of the rows, a file at a time."""
    step = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[step * k : step * k + step], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drained(spark, df, tmp_path):
    with _settings(spark, ROCKSDB):
        df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()


SCHEMA = "site long, pos long, sha string, h long, width long, height long, ts timestamp"


def images(rng, n):
    """Copies, near copies, small ones and rows without a hash."""
    rows, known = [], []
    for i in range(n):
        how = rng.random()
        h, sha = rng.getrandbits(64) - (1 << 63), f"s{i}"
        if known and how < 0.4:
            h = rng.choice(known)[0]
            for _ in range(rng.randrange(8)):
                h ^= 1 << rng.randrange(63)
        elif known and how < 0.55:
            h, sha = rng.choice(known)
        known.append((h, sha))
        rows.append((rng.randrange(3), i, sha, None if how > 0.95 else h, rng.choice([100, 300]), rng.choice([100, 300]), START + datetime.timedelta(minutes=i)))
    return rows


def test_gate_with_late_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = images(rng, 150)
    late = sorted(rows, key=lambda r: (r[-1] + datetime.timedelta(minutes=rng.randrange(50)), r[1]))
    late += [(99, 10_000, "end", 0, 300, 300, START + datetime.timedelta(days=9))]
    stream = fed(spark, tmp_path / "in", late, SCHEMA, 4)
    got = {(r["site"], r["pos"]): r["decision"] for r in drained(spark, processors.send_gate(stream, late="1 hour"), tmp_path)}
    want = {(r["site"], r["pos"]): r["decision"] for r in S.send_gate(spark.createDataFrame(rows, SCHEMA), "site", "pos").collect()}
    assert got == want and len(set(want.values())) == 4


def test_gate_forgets_quiet_sites_and_decides_at_once(spark, tmp_path):
    row = lambda pos, day: (1, pos, "same", 5, 300, 300, START + datetime.timedelta(days=day))
    rows = [row(1, 0), row(2, 1), row(3, 30), (9, 9, "z", 0, 300, 300, START + datetime.timedelta(days=60))]
    stream = fed(spark, tmp_path / "in", rows, SCHEMA, 4)
    got = {r["pos"]: r["decision"] for r in drained(spark, processors.send_gate(stream, forget_hours=48), tmp_path)}
    assert (got[1], got[2], got[3]) == ("sent", "copy", "sent")
    at_once = fed(spark, tmp_path / "now", rows[:3], SCHEMA, 2)
    with _settings(spark, ROCKSDB):
        # timers of processing time never end a run by themselves: one batch
        processors.send_gate(at_once, late=None).writeStream.format("parquet").option("path", str(tmp_path / "o2")).option("checkpointLocation", str(tmp_path / "c2")).trigger(once=True).start().awaitTermination(60)
    assert sorted((r["pos"], r["decision"]) for r in spark.read.schema("site long, pos long, sha string, decision string").parquet(str(tmp_path / "o2")).collect()) == [(1, "sent"), (2, "copy"), (3, "copy")]


@pytest.mark.parametrize("batches", [1, 5])
def test_reliability_in_any_order(spark, tmp_path, batches):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.random() < 0.7, float(i)) for i in range(200)]
    rng.shuffle(rows)
    schema = "provider string, correct boolean, t double"
    stream = fed(spark, tmp_path / "in", rows, schema, batches)
    with _settings(spark, ROCKSDB):
        out = processors.reliability(stream, 60.0)
        out.writeStream.foreachBatch(sinks.upsert(spark, str(tmp_path / "t"), ["provider"], "n")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    sums = sinks.read_upserted(spark, str(tmp_path / "t"), ["provider"], "n")
    want = S.bayes_checkpoint(spark.createDataFrame(rows, schema), 60.0)
    weights = lambda x: {r["provider"]: (r["mean"], r["weight"]) for r in S.checkpoint_weights(x, F.lit(250.0), 60.0).collect()}
    got, want = weights(sums), weights(want)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))
    assert sum(r["n"] for r in sums.collect()) == 200


class Kept(dict):
    """A map state that counts its calls."""

    calls = 0

    def counted(self, got):
        self.calls += 1
        return got

    def exists(self):
        return self.counted(bool(self))

    def containsKey(self, key):
        return self.counted(key in self)

    def getValue(self, key):
        return self.counted(self[key])

    def updateValue(self, key, value):
        self.counted(self.update({key: value}))


@pytest.mark.parametrize("held", [processors.HELD, 400])
def test_gate_reads_and_writes_a_band_once_a_call(monkeypatch, held):
    monkeypatch.setattr(processors, "HELD", held)
    rng = random.Random(5)
    rows = [(k, k, f"s{k // 2}", rng.getrandbits(64) - (1 << 63), 300, 300) for k in range(3000)]
    gate = processors._Gate("site", 6, 200, 1, True, None)
    seen, sent = Kept(), Kept()
    gate.init(type("Handle", (), {"getMapState": lambda _, name, *__: {"seen": seen, "sent": sent}[name], "getListState": lambda *_: None, "getValueState": lambda *_: None})())
    got = [d for part in (rows[:2001], rows[2001:]) for d in gate.rows((1,), part)["decision"]]
    want, known, hashes = [], set(), []
    for _, _, sha, h, _, _ in rows:
        near = any(((h ^ x) & (1 << 64) - 1).bit_count() <= 6 for x in hashes)
        want.append("copy" if sha in known else "near" if near else "sent")
        known.add(sha)
        if want[-1] == "sent":
            hashes.append(h)
    assert got == want and sum(len(v[0]) for v in sent.values()) == 7 * want.count("sent")
    if held > 400:  # two calls: a look, a read and a write a band each
        assert sent.calls <= 2 * (3 * len(sent) + 1)
    assert seen.calls <= 2 * (len(rows) + 1)


def test_sprt_keeps_waiting_scores_as_columns():
    kept, timers = [], []
    state = type("State", (), {"get": lambda _: None, "appendList": lambda _, entries: kept.extend(entries)})()
    handle = type("Handle", (), {"getValueState": lambda *_: state, "getListState": lambda *_: state, "registerTimer": lambda _, at: timers.append(at)})()
    test = processors._Sprt("site", (3.0, -3.0), (0.5, -0.5), 1)
    test.init(handle)
    n = processors.AT_ONCE + 5
    part = pd.DataFrame({"seq": range(n), "p4": [5000] * n, "ts": pd.to_datetime(np.arange(n) * 1000 + 7_000_000, unit="us")})
    assert list(test.handleInputRows((1,), iter([part, part[:3]]), None)) == [] and timers == [7001]
    # one entry a run of scores, no entry a score, and all of them
    assert [len(e[0]) for e in kept] == [processors.AT_ONCE, 5, 3]
    assert [row for e in kept for row in zip(*e)] == [(7000 + k, k, 5000) for k in (*range(n), *range(3))]
