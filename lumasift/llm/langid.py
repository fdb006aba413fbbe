"""Language ID by hierarchical discrimination.

First a linear one-versus-rest machine predicts the language family, then
one-versus-one linear support vector machines separate the languages of that
family, by votes and then by summed margins.  Features are square roots of the
shares of hashed 1- to 4-grams (of UTF-8 bytes) of the lower-cased letters.

Learning takes at most ``SAMPLE`` labelled rows in all, or one of each language
if there are more languages, dealt evenly to the languages, the first ids of
each by a hash, one row an id: a stated bound.  A threshold of the hash, from the
language's count, leaves about twice as many rows before any is shuffled.  Prediction is one narrow pass over all whole
texts.

Defined results: null text, or text without a letter, gets ``und`` with score
0; with no labelled rows every other text gets ``und`` too; a null id counts as
not held out and isn't learned from; a language in no known family is a family
of its own; of rows that repeat an id at most one is learned from, and all are
predicted; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumasift.llm.common import flat, fold_of, gram_hashes, held_out, letters_only, saved, table, windows

GRAMS, BITS = (1, 2, 3, 4), 12
SAMPLE = 4000
_SAMPLE_PARTS, _HASHES = 8, 1 << 40

#: Families of common languages by their ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "sinitic": "zh",
    "austronesian": "id jv ms tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], f"own:{language}")


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, rows of features) for few texts at a time; rows of no letters are 0."""
    data, starts = flat(column, max(GRAMS) - 1)
    size = 1 << BITS
    waiting: tuple[int, np.ndarray] | None = None
    for i, j, lo, hi in windows(starts, 64, 1 << 20):
        counts = np.zeros((j - i) * size)
        docs = np.repeat(np.arange(j - i), np.diff(np.clip(starts[i : j + 1], lo, hi)))
        for n in GRAMS:
            counts += np.bincount(docs * size + gram_hashes(data, lo, hi, n, BITS), minlength=len(counts))
        if waiting and waiting[0] == i:
            waiting[1][:] += counts.reshape(-1, size)
            continue
        if waiting:
            yield waiting[0], _scaled(waiting[1])
        waiting = (i, counts.reshape(-1, size))
    if waiting:
        yield waiting[0], _scaled(waiting[1])


def _scaled(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True))).astype(np.float32)


def svm(x: np.ndarray, positive: np.ndarray, rounds: int = 60, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine by Nesterov steps; classes weigh alike."""
    sign = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb = w.copy(), b
    # rows have norm 1 and the bias adds 1: the gradient's slope is 4 at most
    step = np.float32(1 / (4 + ridge))
    for t in range(rounds):
        slack = np.maximum(0, 1 - sign * (x @ vw + vb)) * sign * weight
        nw = vw + step * (2 * (slack @ x) - ridge * vw)
        nb = vb + step * 2 * slack.sum()
        keep = np.float32(t / (t + 3))
        vw, vb = nw + keep * (nw - w), nb + keep * (nb - b)
        w, b = nw, nb
    return w, float(b)


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    family_w: np.ndarray | None = None
    family_b: np.ndarray | None = None
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        model = cls()
        langs_arr = np.array(langs, dtype=object)
        fams = np.array([family_of(c) for c in langs], dtype=object)
        model.families = sorted(set(fams))
        if len(model.families) > 1:
            fitted = [svm(x, fams == f) for f in model.families]
            model.family_w = np.stack([w for w, _ in fitted], 1)
            model.family_b = np.array([b for _, b in fitted], np.float32)
        for f in model.families:
            names = model.languages[f] = sorted(set(langs_arr[fams == f]))
            model.pairs[f] = []
            for a, b in combinations(range(len(names)), 2):
                rows = (langs_arr == names[a]) | (langs_arr == names[b])
                w, bias = svm(x[rows], langs_arr[rows] == names[a])
                model.pairs[f].append((a, b, w, bias))
        return model

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if not self.families:
            return ["und"] * n, np.zeros(n)
        if self.family_w is None:
            chosen, sure = np.zeros(n, np.int64), np.ones(n)
        else:
            margins = x @ self.family_w + self.family_b
            chosen = margins.argmax(1)
            sure = _logistic(margins[np.arange(n), chosen])
        names = np.empty(n, dtype=object)
        for k, f in enumerate(self.families):
            at = np.flatnonzero(chosen == k)
            langs = self.languages[f]
            votes = np.zeros((len(at), len(langs)))
            sums = np.zeros((len(at), len(langs)))
            for a, b, w, bias in self.pairs[f]:
                margin = x[at] @ w + bias
                votes[:, a] += margin >= 0
                votes[:, b] += margin < 0
                sums[:, a] += margin
                sums[:, b] -= margin
            best = (votes + sums / (1e3 * (1 + np.abs(sums).max(initial=0)))).argmax(1)
            for i, c in zip(at, best):
                names[i] = langs[c]
            if len(langs) > 1:
                sure[at] *= _logistic(sums[np.arange(len(at)), best] / (len(langs) - 1))
        return list(names), sure


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * np.clip(margin.astype(np.float64), -50, 50)))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows with a language whose fold isn't 1; every language has a row at least."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (fold_of(F.col("doc_id")) != 1))
    counts = saved(known.groupBy("lang").agg(F.count("*").alias("rows")), "lang-counts")
    n_langs = counts.count()
    if not n_langs:
        return Model()
    each = max(1, sample // n_langs)
    # the first ``each`` of a language by hash lie below a threshold that 2 x each + 50 rows are expected to meet
    key = F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES))
    below = known.withColumn("key", key).join(counts, "lang").filter(F.col("key") < F.lit(float(_HASHES)) * (2 * each + 50) / F.col("rows"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    picked = below.groupBy("lang", "key", "doc_id").agg(F.count("*")).withColumn("nth", nth).filter(F.col("nth") <= each).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"))
    # at most ``sample`` pairs of an id and a language, or one of each language
    rows = docs.join(F.broadcast(picked), (F.col("doc_id").cast("long") == F.col("id")) & (F.col("lang") == F.col("of"))).select("id", F.col("of").alias("lang"), F.col("text").cast("string").alias("text"))
    # of rows that repeat an id one is learned
    rows = rows.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")
    rows = saved(rows.repartition(_SAMPLE_PARTS), "lang-sample")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x in features(letters_only(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(x)), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], names=["lang", "x"])

    names, xs = [], []
    for r in rows.mapInArrow(vectors, "lang string, x binary").collect():
        names.append(r["lang"])
        xs.append(np.frombuffer(r["x"], np.float16))
    if not names:
        return Model()
    order = sorted(range(len(names)), key=lambda k: (names[k], xs[k].tobytes()))
    return Model.fit(np.stack([xs[k] for k in order]).astype(np.float32), [names[k] for k in order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = letters_only(batch.column(1))
            names: list[str] = []
            sure = []
            for _, x in features(letters):
                a, b = shared.value.predict(x)
                names += a
                sure.append(b)
            none = pc.equal(pc.utf8_trim(letters, characters=" "), "").to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, bool)
            names = ["und" if z else a for a, z in zip(names, none)]
            scores = np.where(none, 0.0, np.concatenate(sure)) if sure else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    done = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, lang_pred string, score double")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs))
