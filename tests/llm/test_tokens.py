import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumasift.llm import encode, packing, token_files

TEXTS = [
    "Hello world, this is fine.\nNext line's here.",
    "",
    None,
    "  two  blanks\t tab ",
    "don't stop\n\nnow 12345 *** x_y",
    "éàü ñandú Straße «q» 日本語 test",
    "a" * 3000,
    "word " * 4000,
    "<|endoftext|> inside <|endoftext|>",
    "x\x1cy \x1c z",
    "tail\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(encode.default_path())


def test_encoder_equals_the_library(library):
    texts = [t for t in TEXTS if t is not None]
    for limit in (3, 10**6):
        e = encode.Encoder(encode.default_path(), max_pieces=limit)
        for _ in range(2):
            got = [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def _frame(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, "again", 1), (3, "again", 1), (None, "no id", 1), (None, None, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)


def test_token_files_round_trip(spark, library, tmp_path):
    rows, df = _frame(spark)
    shards = token_files.write(df, f"file://{tmp_path}/ids", shard_bytes=4000)
    got = sorted(token_files.read(shards).collect(), key=lambda r: r["start"])
    want = {}
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    seen = {}
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    keys = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got]
    assert keys == sorted(keys)
    place = {r["doc_id"]: r["path"] for r in got}
    with token_files.Shard(place[4]) as s:
        assert s.get(4).tolist() == [*library.encode(TEXTS[4], add_special_tokens=False).ids, 0]
        assert s.get(777777) is None and s.get(None, 5) is None


def test_no_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(df, f"file://{tmp_path}/none")).count() == 0
    assert packing.pack(packing.pieces(df)).count() == 0


def test_perfect_hash():
    keys = token_files.keys_of(np.arange(5000), np.zeros(5000, np.uint64))
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    assert len(token_files.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


def _check_packing(got, library, rows):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = 0
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        if sum(x[0] == i for x in rows) > 1:
            continue
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(parts) == 1 if len(ids) <= 1024 else all(r["length"] == 1024 for r in parts[1:]))
    assert sum(r["length"] for r in got) == total
    return len(by_seq), -(-total // 1024)


def test_packing_whole(spark, library):
    rows, df = _frame(spark)
    used, least = _check_packing(packing.pack(packing.pieces(df)).collect(), library, rows)
    assert used <= least + 1


def test_packing_blocks_islands_and_ids(spark, library):
    rows, df = _frame(spark)
    got = packing.pack(packing.pieces(df, with_ids=True), block=4, islands=3, epochs=3)
    _check_packing(got.collect(), library, rows)
    assert all(len(r["ids"]) == 4 * r["length"] for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_genetic_search_beats_best_fit(seed):
    """Sizes that best fit, longest first, packs with bins to spare."""
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(200, 700) for _ in range(400)), reverse=True)
    p = packing.Packer(sizes, 1024, 3)
    first = p.fresh(0)
    best = p.evolve([], packing.POPULATION, packing.GENERATIONS)
    assert len(best) < len(first) and sorted(i for b in best for i in b) == list(range(400)) and all(p.fill(b) <= 1024 for b in best)
    assert packing._to_bins(packing._to_places(best, 400)) and packing.cut_points(1025, 1024) == [0, 1, 1025] and packing.cut_points(2048, 1024) == [0, 1024, 2048]


def test_genetic_search_finds_what_exists():
    """Bins that are full to the brim, cut in three: the least number can be met."""
    rng = random.Random(5)
    sizes = []
    for _ in range(60):
        a, b = sorted(rng.sample(range(1, 1024), 2))
        sizes += [a, b - a, 1024 - b]
    p = packing.Packer(sorted(sizes, reverse=True), 1024, 7)
    assert p.least == 60 and len(p.evolve([], packing.POPULATION, 30, 30)) <= 61


def test_refill_against_all_subsets():
    rng = random.Random(8)
    for _ in range(40):
        sizes = sorted((rng.randrange(1, 60) for _ in range(9)), reverse=True)
        p = packing.Packer(sizes, 100, 1)
        left = list(range(9))
        for made in p.refill(left):
            head, rest = left[0], left[1:]
            best = max(sum(sizes[i] for i in some) for n in range(len(rest) + 1) for some in combinations(rest, n) if sizes[head] + sum(sizes[i] for i in some) <= 100)
            assert made[0] == head and p.fill(made) == sizes[head] + best
            left = [i for i in left if i not in made]
        assert not left


def test_packing_is_repeatable_with_ties(spark):
    df = spark.createDataFrame([(i, "same words here " * (i % 3 + 1)) for i in range(60)], "doc_id long, text string").repartition(2, "doc_id")
    one, two = (sorted(map(tuple, packing.pack(packing.pieces(df), block=16).collect())) for _ in range(2))
    assert one == two and len(one) == 60


def test_reading_in_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARDS_PER_TASK", 1)
    monkeypatch.setattr(token_files, "READ_ROWS", 2)
    df = spark.createDataFrame([(i, f"text {i} " * 9) for i in range(40)], "doc_id long, text string")
    back = token_files.read(token_files.write(df, f"file://{tmp_path}/ids", shard_bytes=400))
    assert back.rdd.getNumPartitions() > 1 and sorted(r["doc_id"] for r in back.collect()) == list(range(40))
