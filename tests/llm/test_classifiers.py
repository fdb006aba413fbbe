import random

import numpy as np
import pyarrow as pa
import pytest

from lumasift.llm import common, langid, toxicity
from pyspark.sql import functions as F


def words(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))


LANGS = {"en": ["th", "er", "on", "an", "ing"], "de": ["sch", "ei", "un", "ge", "lich"], "fr": ["eau", "oi", "que", "é", "eux"], "es": ["ción", "os", "ar", "ñ", "ll"], "xx": ["qz", "zq", "xv"]}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    names = list(LANGS)
    rows = [(i, words(rng, LANGS[names[i % 5]], rng.randrange(3, 60)), names[i % 5]) for i in range(400)]
    return rows + [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (None, words(rng, LANGS["de"], 20), "de"), (1003, "THE" + words(rng, LANGS["en"], 30000), None)]


def test_language(spark, corpus):
    df = spark.createDataFrame([(*r, "clash") for r in corpus], "doc_id long, text string, lang string, score string")
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == len(corpus)
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(400) if by[i]["held_out"]]
    assert np.mean([by[i]["lang_pred"] == corpus[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == by[1002]["lang_pred"] == "und"
    assert by[1003]["lang_pred"] == "en" and by[None]["held_out"] is False


def test_language_learns_every_label(spark):
    names = ["".join(chr(97 + (k * m + m) % 26) for m in (1, 3, 7, 11)) + chr(97 + k // 26) for k in range(120)]
    rows = [(10 * k + j, f"{n} " * 20, f"x{k:03}") for k, n in enumerate(names) for j in range(9)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=60)
    assert sorted(x for of in model.languages.values() for x in of) == [f"x{k:03}" for k in range(120)]


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(df, langid.train(df)).first()["lang_pred"] == "und"
    empty = df.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0


def test_long_text_in_windows_is_one_text():
    import pyarrow as pa

    text = "wort und noch ein wort " * 60000
    both = list(langid.features(pa.array([text, "wort"], pa.large_string())))
    assert [lo for lo, _ in both][0] == 0 and sum(len(x) for _, x in both) == 2
    small = next(langid.features(pa.array([text[:23000]], pa.large_string())))[1][0]
    assert np.abs(both[0][1][0] - small).max() < 0.01


def test_scores_do_not_depend_on_neighbours():
    import pyarrow as pa

    place = np.arange(1 << toxicity.BITS, dtype=np.int32)
    alone = toxicity.present(pa.array(["bad word"]), place)[1]
    d, f = toxicity.present(pa.array(["other", "bad word", None, "more"]), place)
    assert sorted(alone) == sorted(f[d == 1]) and not (d == 2).any() or sorted(alone) == sorted(f[d == 1])


@pytest.fixture(scope="module")
def toxic():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        text = words(rng, LANGS["en"], rng.randrange(5, 80))
        rows.append((i, text + (" " + " ".join(rng.choices(["moronzz", "vilezz", "scumzz"], k=3)) if bad else "")))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, toxic):
    rows, labels = toxic
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "vilezz")], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None), (3, labels[3][1])], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 903
    held = [i for i, _ in labels if got[i]["held_out"]]
    truth = dict(labels)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert got[5000]["score"] == got[5001]["score"] and got[5000]["predicted"] == 0
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    r = toxicity.score(docs, toxicity.train(docs, none)).first()
    assert r["score"] == 0.5 and r["predicted"] == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def test_fold(spark):
    import zlib

    got = {r["id"]: r["h"] for r in spark.range(50).select("id", common.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_repeated_rows_and_a_sample_by_threshold(spark, corpus):
    """An id that very many rows repeat is learned once, and far more rows than the sample are thinned out before a shuffle."""
    rows = [r for r in corpus if r[2]] * 2 + [(0, corpus[0][1], "en")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, sample=50)
    assert sorted(x for of in model.languages.values() for x in of) == sorted(LANGS)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows) and len({r["lang_pred"] for r in got if r["doc_id"] == 0}) == 1


def test_toxicity_of_repeated_and_very_long_texts(spark, toxic):
    rows, labels = toxic
    long = rows[0][1] + " " + "calm words here " * 60_000 + "moronzz vilezz scumzz"
    docs = spark.createDataFrame([*rows, rows[1], rows[1], (7000, long), (7000, long)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, *labels], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"]))
    assert len(got) == len(rows) + 4 and all(len(v) == 1 for v in by.values()) and 0 <= next(iter(by[7000]))[0] <= 1


def test_toxicity_scores_few_texts_at_a_time(monkeypatch):
    rng = np.random.default_rng(7)
    place = np.arange(1 << toxicity.BITS, dtype=np.int32)
    model = toxicity.Model(place, rng.normal(size=len(place)), 0.25)
    texts = [" ".join(rng.choice(["bad", "good", "day", "worse", ""], k)) for k in rng.integers(0, 30, 1000)] + [None, ""]
    seen, present = [], toxicity.present
    monkeypatch.setattr(toxicity, "present", lambda column, place: seen.append(len(column)) or present(column, place))
    scores = toxicity.score_texts(pa.array(texts), model)
    assert max(seen) <= 256 and sum(seen) == len(texts)
    alone = [toxicity.score_texts(pa.array([t], pa.string()), model)[0] for t in texts]
    assert scores.tolist() == alone
