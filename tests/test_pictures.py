"""Picture operators against loops over pixels, and readers of files."""

import io
import json
import math
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumasift.operators import records as R
from lumasift.operators import vision as P
from lumasift.sources import readers, sinks


def png(pixels, colour, filters):
    """A PNG of rows of samples, each row with the filter asked for."""
    h, w, c = pixels.shape
    raw = b""
    for y in range(h):
        kind, line = filters[y % len(filters)], bytearray()
        for x in range(w):
            for k in range(c):
                a = int(pixels[y, x - 1, k]) if x else 0
                b = int(pixels[y - 1, x, k]) if y else 0
                d = int(pixels[y - 1, x - 1, k]) if x and y else 0
                near = min((abs(a + b - d - v), i, v) for i, v in enumerate((a, b, d)))[2]
                line.append((int(pixels[y, x, k]) - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        raw += bytes([kind]) + bytes(line)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    packed = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:10]) + chunk(b"IDAT", packed[10:]) + chunk(b"IEND", b"")


def test_png_of_all_filters_and_colours():
    rng = np.random.default_rng(1)
    for colour, c in ((0, 1), (2, 3), (4, 2), (6, 4)):
        x = rng.integers(0, 256, (7, 5, c), dtype=np.uint8)
        got = P.decode_png(png(x, colour, [0, 1, 2, 3, 4]))
        assert (got == (x[:, :, :3] if c >= 3 else x[:, :, :1])).all() and got.shape == (7, 5, 3)
    good = png(x, 6, [4])
    assert P.decode_png(good[:-20]) is None or P.decode_png(good[:40]) is None
    assert P.decode_png(good[:30] + b"x" + good[31:]) is None and P.decode_png(None) is None and P.decode_png(b"GIF89a") is None


def brute_skin(rgb):
    h, w, _ = rgb.shape
    ys, xs = range(0, h, max(1, h // 64)), range(0, w, max(1, w // 64))
    skin, gray = {}, {}
    for j, y in enumerate(ys):
        for i, x in enumerate(xs):
            r, g, b = map(int, rgb[y, x])
            cb, cr = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
            skin[j, i] = 77 <= cb <= 127 and 133 <= cr <= 173
            gray[j, i] = (299 * r + 587 * g + 114 * b) // 1000
    n, m = len(ys), len(xs)
    cells = {}
    for (j, i), s in skin.items():
        cells.setdefault((j * 8 // n, i * 8 // m), []).append(s)
    on = {k for k, v in cells.items() if 2 * sum(v) >= len(v)}
    best = 0
    while on:
        todo, seen = [on.pop()], 0
        while todo:
            y, x = todo.pop()
            seen += 1
            for k in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if k in on:
                    on.remove(k)
                    todo.append(k)
        best = max(best, seen)
    edge = sum((i > 0 and abs(v - gray[j, i - 1]) > 40) or (j > 0 and abs(v - gray[j - 1, i]) > 40) for (j, i), v in gray.items())
    shares = sum(skin.values()) / len(skin), best / 64, edge / len(skin)
    return (*shares, min(0.98, max(0.0, 1.5 * shares[0] + 1.2 * shares[1] + 0.3 * shares[2] - 0.35)))


def test_skin_against_a_loop():
    rng = np.random.default_rng(2)
    for shape in ((8, 8), (70, 130), (33, 9)):
        x = rng.integers(0, 256, (*shape, 3), dtype=np.uint8)
        x[: shape[0] // 2] = (220, 170, 140)
        assert np.allclose(P.skin_features(x), brute_skin(x))
    assert P.largest_blob(np.zeros((8, 8), bool)) == 0 and P.largest_blob(np.eye(8, dtype=bool)) == 1


def test_ssim_against_a_loop():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (19, 25)), rng.integers(0, 256, (19, 25))
    total = []
    for y in range(0, 12, 8):
        for x in range(0, 18, 8):
            p, q = a[y : y + 8, x : x + 8].ravel().tolist(), b[y : y + 8, x : x + 8].ravel().tolist()
            mp, mq = sum(p) / 64, sum(q) / 64
            vp, vq, c = (sum(s * t for s, t in zip(u, v)) / 64 - m * n for u, v, m, n in ((p, p, mp, mp), (q, q, mq, mq), (p, q, mp, mq)))
            total.append((2 * mp * mq + 6.5025) * (2 * c + 58.5225) / ((mp * mp + mq * mq + 6.5025) * (vp + vq + 58.5225)))
    assert abs(P.ssim(a, b) - sum(total) / len(total)) < 1e-12 and P.ssim(a, a) == 1.0
    with pytest.raises(ValueError):
        P.ssim(a, b[:4])


def scene(turn):
    """Blobs at angles round a centre, turned."""
    y, x = np.mgrid[:160, :160] - 79.5
    out = np.full((160, 160), 60.0)
    for angle, radius, level in ((10, 30, 120), (80, 50, 90), (150, 25, 150), (230, 55, 130), (300, 40, 100)):
        a = math.radians(angle + turn)
        out += level * np.exp(-((x - radius * math.cos(a)) ** 2 + (y - radius * math.sin(a)) ** 2) / 150)
    return out


def test_rings_survive_rotation_and_tiles_a_crop():
    bits = lambda a, b: (a ^ b).bit_count()
    still = scene(0)
    for turn in (5, 15, 40, 90):
        assert bits(P.dft_ring_hash(still), P.dft_ring_hash(scene(turn))) <= 4, turn
    assert bits(P.ring_hash(still), P.ring_hash(scene(2))) <= 8 and P.dft_ring_hash(np.full((40, 40), 9.0)) == P.ring_hash(np.full((40, 40), 9.0)) == 0
    assert bits(P.dft_ring_hash(still), P.dft_ring_hash(scene(0).T * 0.5)) <= 4
    rng = np.random.default_rng(4)
    whole = np.kron(rng.integers(0, 256, (12, 12)), np.ones((16, 16)))
    crop = whole[28:164, 28:164]
    near = min(bits(a & (1 << 64) - 1, b & (1 << 64) - 1) for a in P.tile_hash(whole) for b in P.tile_hash(crop))
    far = min(bits(a & (1 << 64) - 1, b & (1 << 64) - 1) for a in P.tile_hash(whole) for b in P.tile_hash(np.kron(rng.integers(0, 256, (12, 12)), np.ones((16, 16)))))
    assert len(P.tile_hash(whole)) == 12 and near <= 8 < far


def test_variants_and_certificates():
    small, large = np.zeros((20, 10, 3), np.uint8) + 7, np.arange(601 * 700 * 3, dtype=np.uint8).reshape(601, 700, 3)
    (tag, up), *rest = P.variants_of(small)
    assert tag == "up2x" and up.shape == (40, 20, 3) and (up == 7).all() and not rest and P.variants_of(large[:400, :500]) == []
    parts = dict(P.variants_of(large))
    assert (np.vstack([np.hstack([parts[f"grid_r{r}c{c}"] for c in (0, 1)]) for r in (0, 1)]) == large).all()
    low, high, radius = P.certified_radius(100, 100, 0, 0.5)
    assert abs(low - 0.025 ** (1 / 100)) < 1e-12 and abs(high - (1 - low)) < 1e-9 and abs(radius - 0.5 * P.norm_ppf(low)) < 1e-6
    assert P.certified_radius(10, 5, 5, 1.0)[2] is None and P.certified_radius(1, 1, 0, 1.0)[2] is None and P.certified_radius(100, 90, 10, 0.0)[2] == 0
    with pytest.raises(ValueError):
        P.certified_radius(5, 2, 3, 1.0)


def test_pictures_with_nulls(spark, tmp_path):
    rgb = bytes([220, 170, 140]) * 16
    df = spark.createDataFrame([(1, 4, 4, rgb), (2, 4, 4, None), (3, 9, 9, rgb)], "id long, width int, height int, rgb binary")
    got = {r["id"]: r for r in P.skin_scores(df).collect()}
    assert got[1]["prob"] == 0.98 and got[2]["prob"] is None and got[3]["prob"] is None
    assert [r["tag"] for r in P.variants(df).collect()] == ["up2x"] and P.shape_hashes(df.limit(0)).count() == 0
    (tmp_path / "a.png").write_bytes(png(np.full((3, 4, 3), 9, np.uint8), 2, [1]))
    (tmp_path / "b.png").write_bytes(b"nothing")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted((r["path"][-5:], r["width"], r["height"]) for r in P.decoded(files).collect()) == [("a.png", 4, 3), ("b.png", None, None)]
    label = {r["id"]: r["label"] for r in P.noise_consensus(df, 3.0, copies=16).collect()}
    assert label == {1: "nsfw", 2: None, 3: None}


def test_more_readers(spark, tmp_path):
    (tmp_path / "u.yaml").write_text("urls:\n  - example.com  # one\n  - 'https://b.org/p'\n  - example.com\n")
    assert sorted(r["url"] for r in readers.url_list(spark, str(tmp_path / "u.yaml"))[0].collect()) == ["https://b.org/p", "https://example.com"]
    (tmp_path / "odd.yml").write_text("names: 3\n")
    with pytest.raises(ValueError):
        readers.url_list(spark, str(tmp_path / "odd.yml"))
    (tmp_path / "w1.txt").write_text("- url: https://a.com/\n  note: one\n")
    (tmp_path / "w2.txt").write_text("- url: https://b.com/\n  enabled: false\n")
    assert sorted(tuple(r) for r in readers.watchlist(spark, f"{tmp_path}/w*.txt").collect()) == [("https://a.com/", "one", True), ("https://b.com/", "", False)]
    for k in (1, 2):
        (tmp_path / f"s{k}.jsonl").write_text(f'# model=m{k}\n{{"sha256": "x{k}"}}\n')
    assert sorted((r["model"], r["sha256"]) for r in readers.score_file(spark, f"{tmp_path}/s*.jsonl").collect()) == [("m1", "x1"), ("m2", "x2")]
    (tmp_path / "c.json").write_text('{"a": 1}\n\n{oops\n{"b": 2}\n{"a": 5}\n')
    good, bad = readers.json_lines_counted(spark, str(tmp_path / "c.json"), "a long", ["a"])
    assert sorted(r["a"] for r in good.collect()) == [1, 5] and sorted(r["nth"] for r in bad.collect()) == [3, 4]
    with pytest.raises(ValueError, match="line 3"):
        readers.json_lines(spark, str(tmp_path / "c.json"), "a long", strict=True, needs=["a"])
    (tmp_path / "k.txt").write_text("Word\n# no\nword\nother\n")
    assert sorted(r["word"] for r in readers.keyword_file(spark, str(tmp_path / "k.txt")).collect()) == ["other", "word"]
    (tmp_path / "t.tpl").write_text("Dear {name}, {site} {name}")
    assert readers.template_file(spark, str(tmp_path / "t.tpl"), ["site"]).first()["slots"] == ["name", "site"]
    with pytest.raises(ValueError):
        readers.template_file(spark, str(tmp_path / "t.tpl"), ["date"])


def test_manifests_and_archives(spark, tmp_path):
    report = {"site_url": "https://a.com", "n": 3}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "manifest.json").write_text(json.dumps({"report": report, "files": []}))
    for name, inside in (("root.zip", "manifest.json"), ("nested.zip", "b/manifest.json"), ("none.zip", "b/c/manifest.json")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(inside, json.dumps(report))
        (tmp_path / "x" / name).write_bytes(data.getvalue())
    (tmp_path / "x" / "bad.zip").write_bytes(b"PK??")
    got = {r["file"].rsplit("/", 1)[1]: json.loads(r["report"]) for r in readers.manifests(spark, str(tmp_path / "x")).collect()}
    assert got == {k: report for k in ("manifest.json", "root.zip", "nested.zip")}
    for n in (3, 2):
        sinks.write_archive(spark.range(n), f"file://{tmp_path}/archive")
        assert sinks.read_archive(spark, f"file://{tmp_path}/archive").count() == n
    with pytest.raises(ValueError):
        sinks.markdown_report("t", {"big": spark.range(2000)})
    vp8 = b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + (640).to_bytes(2, "little") + (480).to_bytes(2, "little")
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((99) | (49 << 14)).to_bytes(4, "little")
    heif = b"\0\0\0\x18ftypheic" + b"\0" * 20 + b"ispe\0\0\0\0" + (30).to_bytes(4, "big") + (20).to_bytes(4, "big")
    assert (readers.image_size(vp8), readers.image_size(lossless), readers.image_size(heif)) == ((640, 480), (100, 50), (30, 20))


def test_texts_are_stable(spark):
    once = spark.range(1).select(R.polished(F.lit("全部泛滥成灾" + "。话" * 150)).alias("t")).withColumn("again", R.polished(F.col("t"))).first()
    assert once["t"] == once["again"] and len(once["t"]) <= R.MOST_CHARS and once["t"].endswith(R.CLOSING) and "全部" not in once["t"]
    assert spark.range(1).select(R.polished(F.lit(None).cast("string")), R.fitted_reason(F.lit(" a\n b "))).first()[:] == ("", "a b")
    assert spark.range(1).select(R.is_vision(F.lit("x-vl-7b")), R.is_vision(F.lit("plain-7b"))).first()[:] == (True, False)


def test_polishing_replaces_words_once_a_row(spark):
    """The plan names each replacement once: a step that is used twice isn't computed twice."""
    rows = [("大量" * 3 + "内容",), ("话。" * 80 + "尾",), ("话" * 300,), ("好。以上情况本人已人工核实。",), ("  ",), (None,), ("完？",), ("尾部  ",), ("话" * 250 + "以上情况本人已人工核实。",)]
    df = spark.createDataFrame(rows, "t string").select(R.polished(F.col("t")).alias("t"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("触目惊心") <= 2
    end = R.CLOSING
    room = R.MOST_CHARS - len(end) - 1
    want = ["多张" * 3 + "内容。" + end, "话。" * 80 + "尾。" + end if 161 <= room else None, "话" * room + "。" + end, "好。" + end, "  ", "", "完？" + end, "尾部。" + end, "话" * room + "。" + end]
    assert [r["t"] for r in df.collect()] == want


def test_pictures_are_hashed_in_pieces(spark):
    """Batches of any size are cut before they become arrays; hashes are those of whole batches."""
    import pyarrow as pa

    from lumasift.operators import similarity as H

    whole = pa.RecordBatch.from_pydict({"id": list(range(1000)), "v": [[float(k)] for k in range(1000)]})
    assert [b.num_rows for b in H._pieces(iter([whole, whole.slice(0, 3)]))] == [256, 256, 256, 232, 3]
    pixels = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: F.pmod(k * 7 + F.col("id") * k * 3, F.lit(251)).cast("double"))
    images = spark.range(0, 600, 1, 1).select("id", F.when(F.col("id") % 100 != 0, pixels).alias("p"))
    for of in (H.image_hashes, H.wide_hashes):
        got = {r[0]: tuple(r)[1:] for r in of(images, "id", "p").collect()}
        some = {r[0]: tuple(r)[1:] for r in of(images.filter("id IN (255, 256, 599, 300)"), "id", "p").collect()}
        assert len(got) == 600 and all(got[k] == some[k] for k in some) and got[599][0] is not None and got[300][0] is None


def test_likeness_of_batches(spark):
    """Pictures of several sizes, in pieces, against one pair at a time; pixels that lack give null."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        h, w = ((16, 24), (9, 7), (32, 32))[k % 3]
        a, b = (rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for _ in range(2))
        rows.append((k, w, h, a.tobytes(), None if k == 5 else a.tobytes() if k == 6 else b.tobytes()))
    df = spark.createDataFrame(rows, "id long, width int, height int, rgb_a binary, rgb_b binary")
    got = {r["id"]: r["ssim"] for r in P.likeness(df, at_once=4).collect()}
    gray = lambda x, w, h: P.gray_of(np.frombuffer(x, np.uint8).reshape(h, w, 3))
    assert got[5] is None and got[6] == pytest.approx(1.0)
    for k, w, h, a, b in rows:
        assert b is None or got[k] == pytest.approx(P.ssim(gray(a, w, h), gray(b, w, h)), abs=1e-12)
