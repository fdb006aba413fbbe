import random
import re
from collections import defaultdict

import pytest

from lumasift.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates, phrases, threshold):
    """Base places by label, and the best containment by label: every block against every template."""
    w = words(text)
    base, found = defaultdict(list), defaultdict(float)
    for p in phrases:
        own = p.words.split()
        base[p.label] += [i for i in range(len(w)) if w[i : i + len(own)] == own]
    for t in templates:
        own = words(t.text)
        reach = L.reach_of(own)
        for b in range(0, max(1, (len(w) - 1) // reach)):
            share = len(set(own) & set(w[b * reach : (b + 2) * reach])) / len(set(own))
            if share >= threshold - 1e-12:
                found[t.label] = max(found[t.label], share)
    return {k: v for k, v in base.items() if v}, dict(found)


def made(rng, templates):
    """A text with whole, thinned, shuffled and cut templates among other words."""
    vocabulary = sorted({x for t in templates for x in words(t.text)})
    out = []
    for _ in range(rng.randrange(1, 7)):
        own = words(rng.choice(templates).text)
        how = rng.randrange(6)
        if how == 0:
            own = [x for x in own if rng.random() < 0.9]
        elif how == 1:
            rng.shuffle(own)
        elif how == 2:
            own = own[: len(own) // 2]
        elif how == 3:
            own = [x for w in own for x in ([w, "extra"] if rng.random() < 0.1 else [w])]
        elif how == 4:
            own = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        out += own + [rng.choice(["lorem", "été", "the", "of", "0", "license"]) for _ in range(rng.randrange(60))]
    return rng.choice([" ", ", ", "\n", " -- "]).join(x.upper() if rng.random() < 0.2 else x for x in out)


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_against_every_block(spark, threshold):
    rng = random.Random(threshold)
    rows = [(k, made(rng, L.TEMPLATES), "x") for k in range(250)] + [(1, None, "x"), (None, "", "x"), (7, " .,- ", "x"), (8, "Under the MIT license under the mit LICENSE", "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(5)
    got = L.scan(df, threshold=threshold, keep=("doc_id", "text", "label"))
    assert set(got.columns) == {"doc_id", "text", "label", "n_words", "base", "found"}
    got = got.collect()
    assert len(got) == len(rows)
    hits = 0
    for r in got:
        base, found = brute(r["text"], L.TEMPLATES, L.PHRASES, threshold)
        assert r["n_words"] == len(words(r["text"]))
        assert {b["label"]: (b["n"], b["first"], b["last"]) for b in r["base"]} == {k: (len(v), min(v), max(v)) for k, v in base.items()}
        assert {f["label"]: round(f["containment"], 9) for f in r["found"]} == {k: round(v, 9) for k, v in found.items()}
        for f in r["found"]:
            block = set(words(r["text"])[f["start"] : f["start"] + f["length"]])
            assert any(t.label == f["label"] and abs(len(block & set(words(t.text))) / len(set(words(t.text))) - f["containment"]) < 1e-9 for t in L.TEMPLATES)
        hits += len(found)
    assert hits > 50


def test_places_may_overlap_and_signs_count(spark):
    phrases = (L.Phrase("a b a", "x"), L.Phrase("c+d".replace("+", " "), "y"), L.Phrase("é", "z"))
    texts = ["A b,a B a", "ab a", "a b a a b a", "c d c-D C_d", "É é é", "a b a b a", "K b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(df, (), phrases).collect():
        base, _ = brute(texts[r["doc_id"]], (), phrases, 1)
        assert {b["label"]: (b["n"], b["first"], b["last"]) for b in r["base"]} == {k: (len(v), min(v), max(v)) for k, v in base.items()}


def test_long_texts_and_no_rows(spark):
    text = " ".join(["word"] * 300_000) + " " + L.TEMPLATES[2].text + " tail" * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = L.scan(df).collect()
    assert [f["label"] for f in row["found"]] == ["mit"] and row["found"][0]["containment"] == 1.0 and row["n_words"] == 400_000 + len(words(L.TEMPLATES[2].text))
    assert L.scan(df.filter("doc_id = 0")).count() == 0


def test_no_python_in_the_plan(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "released under the MIT license. é")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plans, kept = [], L.saved
    monkeypatch.setattr(L, "saved", lambda d, label: plans.append(d) or kept(d, label))
    got = L.query(spark, str(tmp_path))
    plans.append(got)
    for p in plans:
        assert not re.search("Python|Pandas|Arrow", p._jdf.queryExecution().executedPlan().toString())
    (row,) = got.collect()
    assert tuple(row) == (1, 6, 1, 1, 1, "mit", "mit", 1.0)
