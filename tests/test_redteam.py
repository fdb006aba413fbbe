import numpy as np
import pytest

from lumasift.operators import redteam as R
from lumasift.operators import similarity as S
from lumasift.operators import vision as P


def pictures(rng, n, h, w):
    """Smooth pictures: a few waves."""
    wave = lambda m: np.cos((2 * np.arange(m)[None, :] + 1) * np.arange(7)[:, None] * np.pi / (2 * m))
    g = wave(h).T @ (rng.standard_normal((n, 7, 7)) / (1 + np.add.outer(np.arange(7), np.arange(7)))) @ wave(w)
    return np.clip(np.floor(128 + 60 * g), 0, 255)


def test_batches_equal_single_pictures():
    g = pictures(np.random.default_rng(1), 9, 50, 70)
    found = R.all_hashes(g)
    for k in range(len(g)):
        assert found["ring"][k, 0] == P.ring_hash(g[k]) and found["dft_ring"][k, 0] == P.dft_ring_hash(g[k])
        assert found["tiles"][k].tolist() == P.tile_hash(g[k])
        small = P.resized(g[k][:50, :50], 32)
        assert np.allclose(R.resized(g[k : k + 1, :50, :50], 32, 32)[0], small)
        assert found["phash"][k, 0] == S.signed(S.phash_bits(R.resized(g[k : k + 1], 32, 32)[0]))
    assert R.packed(np.array([[1] * 64, [0] * 63 + [1]])).tolist() == [-1, 1]


def test_attacks_against_loops():
    rng = np.random.default_rng(2)
    g = pictures(rng, 3, 24, 32)
    seeds = np.array([1, 2, 3])
    for f in (0.5, 2.0):
        assert R.attacked(g, "resize", str(f), seeds).shape == (3, 24 * f, 32 * f)
    light = R.attacked(g, "brightness", "1.4", seeds)
    contrast = R.attacked(g, "contrast", "0.6", seeds)
    mark = R.attacked(g, "watermark", "0.35", seeds)
    for k in range(3):
        for y in range(24):
            for x in range(32):
                v = g[k, y, x]
                assert light[k, y, x] == min(255, int(v * 1.4 + 0.5)) and contrast[k, y, x] == max(0, min(255, np.floor((v - 128) * 0.6 + 128.5)))
                assert mark[k, y, x] == (np.floor(v * 0.65 + 255 * 0.35 + 0.5) if y >= 24 - 11 and x >= 32 - 14 else v)
    turned = R.attacked(g[:, :, :24], "rotate", "90", seeds)
    assert np.array_equal(turned, np.rot90(g[:, :, :24], 1, (1, 2))) or np.array_equal(turned, np.rot90(g[:, :, :24], -1, (1, 2)))
    flat = np.full((1, 20, 20), 77.0)
    assert np.array_equal(R.attacked(flat, "jpeg", "60", seeds[:1]), R.attacked(flat, "jpeg", "60", seeds[:1])) and abs(R.attacked(flat, "jpeg", "60", seeds[:1]) - 77).max() <= 2
    # a coarser quality is further away
    errors = [np.abs(R.attacked(g, "jpeg", q, seeds) - g).mean() for q in R.ATTACKS["jpeg"]]
    assert errors == sorted(errors) and errors[0] < errors[-1]
    noisy = R.attacked(g, "noise", "16", seeds)
    assert np.array_equal(noisy, R.attacked(g, "noise", "16", seeds)) and not np.array_equal(noisy, R.attacked(g, "noise", "16", seeds + 1))
    with pytest.raises(ValueError):
        R.attacked(g, "melt", "1", seeds)


def test_recall_of_a_table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i, g in enumerate(np.concatenate([pictures(rng, 20, 48, 48)])):
        rows.append((i, 48, 48, bytearray(np.repeat(g.astype(np.uint8)[:, :, None], 3, 2).tobytes())))
    wide = pictures(rng, 4, 40, 60)
    rows += [(100 + i, 60, 40, bytearray(np.repeat(g.astype(np.uint8)[:, :, None], 3, 2).tobytes())) for i, g in enumerate(wide)]
    rows += [(200, 48, 48, bytearray(b"short")), (201, None, 48, None), (202, 48, 48, None), (203, 0, 0, bytearray(b""))]
    df = spark.createDataFrame(rows, "id long, width int, height int, rgb binary").repartition(3)
    hashes = R.attacked_hashes(df, at_once=7).cache()
    assert hashes.count() == 24 * sum(map(len, R.ATTACKS.values()))
    by = {(r["family"], r["strength"], r["kind"]): r["recall"] for r in R.recall(hashes).collect()}
    assert all(v == 1 for (f, _, _), v in by.items() if f == "none")
    assert all(by["flip", s, "mirror"] > 0.9 for s in "hv") and by["flip", "h", "phash"] < 0.3
    assert all(by["resize", s, "phash"] > 0.9 for s in R.ATTACKS["resize"]) and by["jpeg", "60", "phash"] > 0.9
    assert by["rotate", "15", "dft_ring"] > by["rotate", "15", "phash"]
    # distances by a loop over numpy's own results
    gray = {r[0]: np.frombuffer(bytes(r[3]), np.uint8).reshape(r[2], r[1], 3) for r in rows[:24]}
    for r in R.distances(hashes.filter("family IN ('none', 'rotate')")).filter("strength = '8'").collect():
        g = P.gray_of(gray[r["id"]])[None].astype(float)
        a, b = R.all_hashes(g)[r["kind"]][0], R.all_hashes(R.attacked(g, "rotate", "8", np.zeros(1)))[r["kind"]][0]
        bits = lambda x, y: bin((int(x) ^ int(y)) & (1 << 64) - 1).count("1")
        want = {"tiles": lambda: min(bits(x, y) for x in a for y in b), "pyramid": lambda: min(map(bits, a, b))}.get(r["kind"], lambda: sum(map(bits, a, b)))()
        assert r["distance"] == want
    # the search over all originals finds what the distance says, and a lossy one not more
    exact = {(r["family"], r["strength"]): r["found"] for r in R.search_recall(hashes).collect()}
    assert exact == {(f, s): round(v * 24) for (f, s, k), v in by.items() if k == "phash"}
    lossy = {(r["family"], r["strength"]): r["found"] for r in R.search_recall(hashes, bands=8, radius=0).collect()}
    assert all(lossy[k] <= v for k, v in exact.items())
    low = {(r["family"], r["kind"]): r for r in R.weakest(R.recall(hashes)).collect()}
    assert low["none", "phash"]["least"] is None and low["flip", "phash"]["least"] == "h"


def test_tile_hashes_draw_no_tile_unless_rounding_could_decide(monkeypatch):
    rng = np.random.default_rng(6)
    flat, rows = np.full((2, 40, 64), 200.0), np.repeat(rng.integers(0, 256, (2, 40, 1)), 64, 2).astype(float)
    plain = rng.integers(0, 256, (6, 40, 64)).astype(float)
    every = np.concatenate([plain, flat, rows])
    want = R.tile_hashes_by_steps(every)
    assert (R.tile_hashes(every) == want).all() and want.shape == (10, 12)
    drawn = []
    monkeypatch.setattr(R, "resized", lambda gray, *side: drawn.append(side))
    assert (R.tile_hashes(plain) == want[:6]).all() and not drawn
