import zipfile

import numpy as np
from pyspark.sql import functions as F

from lumasift.operators import checks as C
from lumasift.operators import vision as P
from lumasift.plans.streams import _settings
from lumasift.sources import archives as Z


def test_members_filters_and_broken_ones(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    pictures = {f"d/p{i}.png": rng.integers(0, 256, (5 + i % 3, 10 + i), dtype=np.uint8) for i in range(30)}
    rows = [(f"a{i % 4}.zip", name, bytearray(Z.png(x))) for i, (name, x) in enumerate(pictures.items())]
    df = spark.createDataFrame([*rows, ("a0.zip", "manifest.json", bytearray(b'{"report": {}}'))], "archive string, member string, data binary")
    assert Z.write_archives(df, f"file://{tmp_path}/z") == 4
    (tmp_path / "z" / "torn.zip").write_bytes(b"PK nothing")
    (tmp_path / "z" / "other.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "z" / "a9.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.txt", "good" * 50)
        z.writestr("bad.txt", "bad" * 5000)
    data = bytearray((tmp_path / "z" / "a9.zip").read_bytes())
    at = data.index(b"bad.txt") + 12
    data[at : at + 8] = b"\xff" * 8
    (tmp_path / "z" / "a9.zip").write_bytes(bytes(data))
    monkeypatch.setattr(Z, "MEMBERS", 3)
    got = {r["member"]: r for r in Z.read_archives(spark, f"file://{tmp_path}/z").collect()}
    assert set(got) == set(pictures) | {"manifest.json", "good.txt"}
    for name, x in pictures.items():
        assert (got[name]["height"], got[name]["width"]) == x.shape and np.array_equal(P.decode_png(bytes(got[name]["data"]))[:, :, 0], x)
    assert got["manifest.json"]["width"] is None and got["good.txt"]["size"] == 200
    with _settings(spark, Z.PUSHDOWN):
        wide = Z.read_archives(spark, f"file://{tmp_path}/z").filter((F.col("width") > 25) & (F.col("archive") != "a1.zip") & (F.col("size") < 10_000))
        assert {r["member"] for r in wide.collect()} == {n for i, (n, x) in enumerate(pictures.items()) if x.shape[1] > 25 and i % 4 != 1}


def test_filters_rule_out_before_unpacking(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(5):
            z.writestr(f"{i}.png", Z.png(np.zeros((3, 10 + i), np.uint8)))
    reader = Z._PushedReader(f"file://{tmp_path}")
    left = list(reader.pushFilters([GreaterThan(("width",), 12), EqualTo(("data",), b""), IsNull(("width",))]))
    assert [type(f) for f in left] == [EqualTo, IsNull]
    (part,) = reader.partitions()
    assert [r for b in reader.read(part) for r in b.column(1).to_pylist()] == ["3.png", "4.png"]
    assert Z._Reader(str(tmp_path)).partitions()[0].stop == 5
    none = Z._PushedReader(str(tmp_path))
    list(none.pushFilters([EqualTo(("archive",), "b.zip")]))
    assert none.partitions() == []


def test_checks_pass_fail_and_break(spark):
    def broken():
        raise OSError("no kernel")

    checks = [C.Check("a", "m", 1.0, False, lambda: 0.5), C.Check("b", "m", 1.0, True, lambda: 0.5), C.Check("c", "m", 1.0, None, lambda: 1.0), C.Check("d", "m", 1.0, None, broken)]
    got = [tuple(r) for r in C.run(spark, checks).collect()]
    assert [(r[0], r[2], r[4], r[5]) for r in got] == [("a", 0.5, "pass", None), ("b", 0.5, "fail", None), ("c", 1.0, "pass", None), ("d", None, "fail", "OSError")]
    assert C.measured(spark.range(17).filter("id < 5")) == 5


def test_palettes_sixteen_bits_and_reasons(spark):
    import zlib

    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = lambda w, h, depth, colour, laced=0: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([depth, colour, 0, 0, laced]))
    end = lambda raw: chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    colours = bytes([10, 20, 30, 40, 50, 60])
    palette = head(2, 2, 8, 3) + chunk(b"PLTE", colours) + end(bytes([0, 0, 1, 2, 1, 0]))
    wide = head(2, 1, 16, 2) + end(bytes([1, *range(1, 7), *range(1, 7)]))
    files = [("palette", palette), ("wide", wide), ("index", head(1, 1, 8, 3) + chunk(b"PLTE", colours) + end(bytes([0, 9]))), ("laced", head(1, 1, 8, 0, 1) + end(b"\0\0")), ("bits", head(1, 1, 4, 0) + end(b"\0\0")), ("torn", palette[:-20]), ("text", b"text"), ("none", None)]
    rows = P.decoded(spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in files], "path string, content binary"), at_once=3).collect()
    got = {r["path"]: (r["width"], r["height"], None if r["rgb"] is None else list(r["rgb"]), r["reason"]) for r in rows}
    # the second row is what stands above it plus 1 and 0
    assert got["palette"] == (2, 2, [10, 20, 30, 40, 50, 60, 40, 50, 60, 40, 50, 60], None)
    assert got["wide"] == (2, 1, [1, 3, 5, 2, 6, 10], None)
    assert {n: got[n][3] for n in ("index", "laced", "bits", "torn", "text", "none")} == {"index": "broken", "laced": "unsupported", "bits": "unsupported", "torn": "broken", "text": "no png", "none": "empty"}
