import hashlib
import hmac
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lumasift.operators import audit as A


def sha(b):
    return hashlib.sha256(b).digest()


def root_of(leaves):
    if not leaves:
        return sha(b"").hex()
    row = [bytes.fromhex(h) for h in leaves]
    while len(row) > 1:
        row = [sha(row[i] + row[min(i + 1, len(row) - 1)]) for i in range(0, len(row), 2)]
    return row[0].hex()


def height(n):
    return (n - 1).bit_length() if n else 0


def canon(x):
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sign(root, n, key):
    return hmac.new(key, canon({"leaf_count": n, "root": root}).encode(), hashlib.sha256).hexdigest()


def replay(lines):
    """Line by line: failed lines, tree segments, degraded ranges, unsealed leaves, counts."""
    leaves, started, degraded, sealed, segment = [], False, None, 0, 0
    failed, ranges, n = set(), [], dict.fromkeys(("verified", "legacy", "loose", "passed"), 0)
    for nth, line in enumerate(lines, 1):
        try:
            r = json.loads(line)
            assert isinstance(r, dict)
        except (ValueError, AssertionError):
            failed.add(nth)
            continue
        if r.get("event") == A.CHECKPOINT:
            started = True
            good = r.get("algo") == "SHA-256" and (r.get("root"), r.get("leaf_count"), r.get("height")) == (root_of(leaves), len(leaves), height(len(leaves))) and not any(isinstance(r[k], bool) for k in ("leaf_count", "height"))
            if r.get("signed") or r.get("signature"):
                good = good and r.get("sign_algo") == "HMAC-SHA256" and r.get("signature") == sign(r["root"], r["leaf_count"], b"k")
            if good:
                sealed, n["passed"] = len(leaves), n["passed"] + 1
            else:
                failed.add(nth)
        elif r.get("event") == A.DEGRADED:
            started = True
            if degraded:
                ranges.append((degraded, nth - 1))
            degraded = nth
        elif A.LEAF in r:
            if degraded:
                ranges.append((degraded, nth - 1))
                degraded, leaves, sealed, segment = None, [], 0, segment + 1
            h = r.pop(A.LEAF)
            if not isinstance(h, str) or not h:
                failed.add(nth)
                continue
            leaves.append(sha(canon(r).encode()).hex())
            started = True
            if leaves[-1] == h:
                n["verified"] += 1
            else:
                failed.add(nth)
        elif degraded:
            n["loose"] += 1
        elif not started:
            n["legacy"] += 1
        else:
            failed.add(nth)
    if degraded:
        ranges.append((degraded, len(lines)))
    return failed, ranges, segment + 1, max(0, len(leaves) - sealed) if started else 0, started, n


def made(rng, size, hostile):
    lines, leaves, degraded = [], [], False
    for i in range(size):
        event = {"event": "x", "n": i, "v": rng.choice([1.5, 2.0, 1e16, -0.0, "é\u0001\n", None, {"b": [1], "a": True}, 10**25])}
        roll = rng.random()
        if roll < 0.03:
            lines.append(json.dumps({"event": A.DEGRADED, "reason": "r"}))
            degraded = True
        elif roll < 0.13 and lines:
            n, root = len(leaves), root_of(leaves)
            point = {"event": A.CHECKPOINT, "algo": "SHA-256", "root": root, "leaf_count": n, "height": height(n)}
            if rng.random() < 0.5:
                point |= {"signed": True, "sign_algo": "HMAC-SHA256", "signature": sign(root, n, b"k")}
            if rng.random() < hostile:
                key = rng.choice([k for k in point if k != "event"])
                point[key] = rng.choice([None, 7, "0" * 64, True])
            lines.append(json.dumps(point))
        elif degraded and rng.random() < 0.7:
            lines.append(json.dumps(event))
        else:
            if degraded:
                degraded, leaves = False, []
            own = sha(canon(event).encode()).hex()
            leaves.append(own)
            how = rng.random()
            if how < hostile / 3:
                event["n"] = -1
                leaves[-1] = sha(canon(event).encode()).hex()
            elif how < hostile / 2:
                leaves.pop()
                own = rng.choice(["", None, 3])
            lines.append(json.dumps(event | {A.LEAF: own}, ensure_ascii=rng.random() < 0.5))
        if rng.random() < hostile / 4:
            lines.append(rng.choice(["", "  ", "[1]", "{", "3", json.dumps({"event": "late"})]))
    return [json.dumps({"event": "old"})] * rng.randrange(3) + lines


@pytest.mark.parametrize("seed,size,block,hostile", [(1, 400, 16, 0.2), (2, 300, 1000, 0.0), (3, 250, 7, 0.5), (4, 0, 5, 0.0)])
def test_whole_logs_against_replay(spark, seed, size, block, hostile):
    lines = made(random.Random(seed), size, hostile)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "nth long, line string").repartition(4)
    failed, ranges, segments, unsealed, started, n = replay(lines)
    got = A.verify_log(df, b"k", block)
    assert {r["nth"] for r in got.lines.filter("reason IS NOT NULL").collect()} == failed
    assert [r["nth"] for r in got.failures(10).collect()] == sorted(failed)[:10]
    assert sorted((r["start"], r["end"]) for r in got.degraded.collect()) == ranges
    r = got.report().first()
    assert (r["total_lines"], r["failures_total"], r["exit_code"]) == (len(lines), len(failed), 2 if failed else 0)
    assert (r["verified_events"], r["legacy_lines"], r["degraded_events"], r["checkpoints_passed"]) == (n["verified"], n["legacy"], n["loose"], n["passed"])
    assert r["segments"] == segments and r["unsealed"] == unsealed and r["sealed"] == ((unsealed == 0) if started else None)


def test_every_prefix_of_trees(spark):
    sizes = {1: 1, 2: 2, 3: 70, 4: 129, 5: 200}
    hashes = {t: [sha(f"{t}.{i}".encode()).hex() for i in range(n)] for t, n in sizes.items()}
    leaves = spark.createDataFrame([(t, i, h) for t, own in hashes.items() for i, h in enumerate(own)], "tree int, i long, h string")
    wanted = spark.createDataFrame([(t, c) for t, n in sizes.items() for c in range(n + 1)], "tree int, count long")
    for r in A.prefix_roots(leaves, wanted).collect():
        assert (r["root"], r["height"]) == (root_of(hashes[r["tree"]][: r["count"]]), height(r["count"]))


def test_lines_of_split_files(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 90) for i in range(5000)] + [""]
    (tmp_path / "a.log").write_text("\n".join(lines[:3000]) + "\n")
    (tmp_path / "b.log").write_text("\n".join(lines[3000:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = A.read_lines(spark, str(tmp_path)).orderBy("nth").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line"] for r in got] == lines and [r["nth"] for r in got] == list(range(1, 5002))


def test_bytes_end_the_reading_and_signatures(spark):
    rows = [(1, bytearray(b'{"event":"old"}')), (2, bytearray(b"\xff\xfe")), (3, bytearray(b"{"))]
    df = spark.createDataFrame(rows, "nth long, b binary").select("nth", F.col("b").cast("string").alias("line"))
    got = A.verify_log(df)
    assert [tuple(r) for r in got.failures().collect()] == [(2, "bytes")] and got.report().first()["scan_truncated"]
    for key in (b"k", b"long" * 40):
        (r,) = spark.range(1).select(A.signature(F.lit("ab"), F.lit(3), key).alias("s")).collect()
        assert r["s"] == sign("ab", 3, key)


def test_a_long_block_is_a_running_value(spark):
    """Ends of degraded ranges in one block of 60,000 lines: work that grows with the square of a block takes minutes."""
    nth = F.col("id")
    line = F.when(nth.isin(2, 31_000), '{"event":"merkle_degraded","reason":"disk"}').when(nth.isin(30_000, 60_000), '{"merkle_leaf":"x"}').otherwise('{"a":1}')
    lines = spark.range(1, 60_001, 1, 4).select(nth.alias("nth"), line.alias("line"))
    began = time.monotonic()
    placed, total = A._running(lines, A.BLOCK)
    ends = sorted(tuple(r) for r in placed.filter("kind = 'degraded'").select("nth", "ends").collect())
    assert ends == [(2, 29_999), (31_000, 59_999)] and total == 60_000
    assert placed.agg(F.max("segment")).first()[0] == 2
    assert time.monotonic() - began < 40
