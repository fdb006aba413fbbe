import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lumasift.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, proof string, i int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes, fanout):
    """Root, and for each node its runs' parts before and behind the path, from below."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for p, i in enumerate(at):
            run = runs[i // fanout]
            paths[p].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        at, nodes = [i // fanout for i in at], [sha("".join(r)) for r in runs]
    return (nodes or [sha("")])[0], paths


def brute(rows, fanout):
    """Of every row: (id, leaf, subroot, root, proof)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    found, tops = [], []
    for s in sources:
        own = sorted((r[0] is not None, r[0] or 0, leaf(r)) for r in rows if r[1] == s)
        subroot, paths = tree([h for *_, h in own], fanout)
        tops.append(subroot)
        found.append([(i if known else None, h, subroot, p) for (known, i, h), p in zip(own, paths)])
    root, above = tree(tops, fanout)
    return root, [(i, h, sub, p + above[k]) for k, own in enumerate(found) for i, h, sub, p in own]


def key(x):
    return repr(x)


@pytest.mark.parametrize("fanout,k,n", [(2, 1, 150), (3, 2, 400), (16, 2, 1500), (16, 3, 40)])
def test_against_plain_python(spark, fanout, k, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        source = rng.choices(["a", "b", "é", "z", "\U0001f600", "Z", None, f"one{i}"], [30, 5, 2, 1, 1, 1, 3, 2])[0]
        text = rng.choice([None, "", "Aé:1", "x" * rng.randrange(40), f"T {i}"])
        rows.append((rng.choice([i, i, i, i // 2, None]), source, rng.choice(["en", None]), rng.choice([None, i]), text, "l", "p", 1))
    rows += [rows[0]] * 30  # a row again and again
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = M.build(df, fanout=fanout, k=k)
    root, want = brute(rows, fanout)
    assert got.root == root
    out = got.proofs.withColumn("to", M.folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], [tuple(x) for x in r["proof"]]) for r in out), key=key) == sorted(want, key=key)
    assert {r["to"] for r in out} == {root}
    assert {r["source"] for r in got.subroots.collect()} == {r[1] for r in rows}


def test_changed_rows_fail_and_the_rest_holds(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), "en", 3, rng.choice(["Text", "text", "ÉA", "é", "", None])) for i in range(300)] + [(None, "a", "en", 3, "Text")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    root, want = brute(rows, 16)
    proof = {i: (h, sub, p) for i, h, sub, p in want}
    got = M.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r["root"] for r in got} == {root}
    texts = {r[0]: r[4] for r in rows}
    for r in got:
        i = r["doc_id"]
        picked = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        text = texts[i]
        low = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        assert r["verified"] == (not picked or text == low) == (r["folded_root"] == root)
        h, sub, p = proof[i]
        assert (r["leaf"], r["subroot"], r["proof_sha256"]) == (h, sub, sha("".join(a + b for a, b in p)))
    assert 0 < sum(not r["verified"] for r in got) < 80


def test_long_texts_one_row_and_no_rows(spark):
    rows = [(7, None, None, 0, "A" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    one = M.build(df)
    assert one.root == leaf(rows[0]) and [r["proof"] for r in one.proofs.collect()] == [[]]
    none = M.build(df.filter("doc_id = 0"))
    assert none.root == sha("") and none.proofs.count() == 0 and none.subroots.count() == 0
