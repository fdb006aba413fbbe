import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumasift.llm import ngram_join as J

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(n_shingles, smallest id reachable) of each row, in order."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j, o in Counter(j for x in s for j in where[x] if j > k).items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                a, b = root(k), root(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[root(k)] = min(best.get(root(k), i), i)
    return sorted(((i, len(s), best.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    out = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (5, "one  two three four five"), (6, "É x"), (7, "é x")]
    bases = [rng.choices(vocabulary, k=rng.randrange(5, 120)) for _ in range(12)]
    common = rng.choices(vocabulary, k=55)
    at = 10
    for base in bases:
        for _ in range(rng.randrange(1, 14)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append((at, " ".join(words)))
            at += 1
    chain = rng.choices(vocabulary, k=60)
    for k in range(8):  # neighbours link, ends don't
        out.append((at, " ".join(chain[2 * k :] + [f"n{j}" for j in range(2 * k)])))
        at += 1
    for _ in range(15):  # unlike texts around one passage
        out.append((at, " ".join([*rng.choices(vocabulary, k=60), *common, *rng.choices(vocabulary, k=30)])))
        at += 1
    return out + [(11, out[9][1]), (None, out[12][1]), (None, "lonely words of no id here")]


@pytest.mark.parametrize("options", [{}, {"pairs_up_to": 2, "leaders": 1, "cluster": 3}, {"pairs_up_to": 2, "leaders": 1, "block_nodes": 2}, {"pairs_up_to": 2, "leaders": 1, "hot": 2, "part": 2, "cluster": 5}])
def test_components(spark, rows, options):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    got = sorted((tuple(r) for r in J.join(df, **options).collect()), key=repr)
    assert got == brute(rows)


def test_links_across_the_parts_of_hot_shingles(spark):
    """Two linked texts hold nothing but a passage of many documents, and unlike texts rank before them in their parts."""
    rows = []
    for at in range(0, 12000, 1000):
        passage = [f"p{at}x{k}" for k in range(12)]
        rows += [(at + 1, " ".join(passage)), (at + 2, " ".join(passage[:-1]))]
        rows += [(at + 10 * n + lo, " ".join(passage[lo : lo + n])) for n in (5, 6, 7) for lo in range(13 - n)]
        rows += [(at + 100 + k, " ".join([*(f"u{at}x{k}x{j}" for j in range(60)), *passage])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in J.join(df, hot=16, part=8).collect()), key=repr) == brute(rows)


def test_tile_of_many_short_nodes():
    """Matrices, not loops over pairs: 3,000 sets of 5 to 8 elements, and links as by brute force."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 9), dtype=np.uint64)) for _ in range(2900)]
    sets += [np.append(h[:-1], np.uint64(7)) if k % 2 else h[1:] for k, h in enumerate(sets[:100])]
    sets = [np.sort(h) for h in sets]
    ns, bits = np.array([len(h) for h in sets]), [J.bitmap_of(h) for h in sets]
    every = np.arange(len(sets))
    began = time.perf_counter()
    got = J.tile_links(ns, bits, sets, every, every, every, 80)
    assert time.perf_counter() - began < 2
    want = {(k, 2900 + k) for k in range(100) if J.linked(sets[k], sets[2900 + k])}
    assert {tuple(sorted(p)) for p in got} == want and want
    assert J.tile_links(ns, bits, sets, np.zeros(len(sets), int), every, every, 80) == []


def test_folded_bitmaps():
    rng = np.random.default_rng(6)
    h = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    wide = np.frombuffer(J.bitmap_of(h), "<u8")[None, :]
    want = np.bincount((h & np.uint64(127)).astype(np.int64), minlength=128) & 1
    assert (np.unpackbits(np.ascontiguousarray(J._folded(wide, 2)).view(np.uint8), bitorder="little") == want).all()


def test_representatives(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, label string")
    kept = J.representatives(df)
    assert kept.columns == df.columns
    groups = {(c, n > 0) if n else (i, "empty", k) for k, (i, n, c) in enumerate(brute(rows))}
    assert kept.count() == len(groups)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(df).count() == 0 and J.representatives(df).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m, k = rng.integers(1, 300), rng.integers(0, 300), rng.integers(0, 300)
        pool = np.unique(rng.integers(0, 1 << 63, n + m + k + 5, dtype=np.uint64))
        a = np.sort(np.concatenate([pool[:n], pool[n : n + m]]))
        b = np.sort(np.concatenate([pool[:n], pool[n + m : n + m + k]]))
        assert J.intersection(a, b) == n <= J.overlap_bound(len(a), J.bitmap_of(a), len(b), J.bitmap_of(b))


def test_windows_do_not_change_sets():
    rng = random.Random(1)
    texts = [" ".join(f"t{rng.randrange(50)}" for _ in range(rng.randrange(0, 400))) for _ in range(20)] + ["", "a b\tc\nd"]
    whole = list(J.shingle_sets(pa.array(texts, pa.large_string())))
    small = list(J.shingle_sets(pa.array(texts, pa.large_string()), max_bytes=64))
    assert len(whole) == len(texts) and all((x == y).all() for x, y in zip(whole, small)) and [len(x) for x in whole] == [len(shingles(t)) for t in texts]
