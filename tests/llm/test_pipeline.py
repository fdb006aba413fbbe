import os
import random
import sys
from collections import Counter

import pytest

import corpus_pipeline
from lumasift.llm import exact_dedup, mixing, ngram_join, toxicity

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_ngram_join import brute as near_copies  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        if k < 4:
            assert after.columns == names
        after = spark.createDataFrame(after.collect(), after.schema)
        if k == 0:
            scores = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scores if r["predicted"] == 0}
        if k == 1:
            texts = Counter(r["text"] for r in after.collect())
            assert set(texts) == {r["text"] for r in before.collect()} and max(texts.values()) == 1
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in exact_dedup.assign(before).collect() if r["kept"]}
        if k == 2:
            joined = ngram_join.join(before).collect()
            assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in joined}
        if k == 3:
            taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["size"]}
            assert Counter(r["doc_id"] for r in after.collect()) == Counter({i: n for i, n in taken.items() if n})
        counts.append(after.count())
        before = after
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def odd_rows():
    """Nulls, empty and very long texts, repeated rows and ids, copies and near copies."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=80)
    near = [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in (3, 40, 77)]
    texts = [" ".join(base), *near, " ".join(base), None, "", " \n", "one two", "one two", " ".join(rng.choices(words, k=60_000))]
    texts += [" ".join(rng.choices(words, k=rng.randrange(5, 90))) for _ in range(40)]
    rows = [(i, t, rng.choice(["a", "b", None]), rng.choice(["s", "t", None])) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, "no id at all here", None, "s"), (3, near[0], "a", "s")]


def test_stages_on_odd_rows(spark, tmp_path):
    """Each stage against plain Python, then the whole pipeline; columns that stages use inside clash with the table's."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, component string, keep_id long, part int"
    rows = [(i, t, lang, s, len(t or ""), "x", 7, 1) for i, t, lang, s in odd_rows()]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    assert stages[0](spark, docs, sf).count() == len(rows)  # nothing is known of toxicity, so nothing goes

    kept = stages[1](spark, docs, sf)
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert kept.columns == docs.columns and sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == sorted(best.items())

    alone = stages[2](spark, kept, sf)
    pairs = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {(i if not n else c, n > 0) for i, n, c in near_copies(pairs)}
    assert alone.columns == docs.columns and {(r["doc_id"], bool((r["text"] or "").split())) for r in alone.collect()} == want

    mixed = stages[3](spark, alone, sf)
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in alone.collect()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and max(copies.values(), default=0) <= 2 and set(copies) <= set(size)
    total = sum(size.values())
    assert abs(sum(size[i] * n for i, n in copies.items()) - 1.5 * total) <= 2 * max(size.values())

    made = corpus_pipeline.run(spark, sf).collect()
    by_sequence = {}
    for r in made:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        assert sum(n for _, n in parts) <= 1024 and sorted(o for o, _ in parts) == [sum(n for o2, n in parts if o2 < o) for o in sorted(o for o, _ in parts)]


def test_stages_on_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, str(tmp_path))
        assert after.count() == 0 and (k == 4 or after.columns == docs.columns)
