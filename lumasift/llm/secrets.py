"""Secret scans: three plain patterns, and dictionary-primed zstandard novelty.

Novelty: a candidate is a maximal run of at least ``MIN_CHARS`` key-like
characters with a sensitive word close before or behind it.  A zstandard
compressor primed with a dictionary of words, as identifiers and code consist
of, packs the surrounding text with and without the candidate; the extra bytes
are what it costs.  It is packed as it stands and as the words that an
identifier of its form would have (``userTokenId`` as ``user token id``), and
the cheaper form counts.  Its *novelty* is that cost against the mean cost of
random strings of its length and kinds of characters in such a place: about 1
for a random key of any kind, and less for names, words and dates that the
dictionary or the neighbourhood explains.  A candidate is reported as ``novel`` if its novelty is
``NOVEL`` or more, its measured information (novelty, at most 1, times the bits
of a random string) is ``LEAST_BITS`` or more, and no plain pattern has covered
any of it.  No rule on single characters takes part.

One narrow pass over whole texts.  An RE2 pass over each Arrow batch finds the
texts that can hold anything, and only those are looked at in Python.

Defined results: null text counts as empty and has no spans (base_sha256 is
then the hash of nothing); rows that repeat are scanned each, with equal
results; positions count code points, the end exclusive; of spans that start
together the kinds come in the listed order; an empty table gives no rows; extra
columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumasift.llm.common import table, texts_of
from lumasift.llm.encode import default_path

#: The plain kinds in order, each with its pattern, and the rest of its condition.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)  # runs are maximal, so the length can stand in the pattern
BASE = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "hex": (HEX, lambda m: True),
}
#: RE2 patterns of the texts that can match; they may take in more.
MAYBE = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}

#: Fewer characters can't hold ``LEAST_BITS``.
MIN_CHARS, NOVEL, LEAST_BITS = 11, 0.79, 64
SENSITIVE = re.compile(r"(?:api|access|private|secret|signing|encryption|account)[ _-]?key|secret|token|passw|passphrase|credential|authori[sz]ation|bearer|signature|client[ _-]?id", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(rf"(?<![\w+/=-])[A-Za-z0-9+/_-]{{{MIN_CHARS},}}={{0,2}}(?![\w+/=-])")
MAYBE_NOVEL = rf"[A-Za-z0-9+/_-]{{{MIN_CHARS}}}"
MAYBE_SENSITIVE = r"(?i)key|secret|token|passw|passphrase|credential|authori[sz]ation|bearer|signature|client[ _-]?id"
#: Characters before and behind a candidate in which a sensitive word counts; characters of neighbourhood on each side.
BEFORE, BEHIND, AROUND = 64, 32, 1024
_LEVEL, _DRAWS, _LONG = 12, 16, 256

_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_BEFORE, _BEHIND = b"the report says that the api key for this account is ", b" and it was changed last week by the admin"


def dictionary(vocabulary: str | None = None) -> bytes:
    """The words of a public tokenizer's vocabulary (a path), the most frequent ones last and so nearest, behind parts of dates."""
    with open(vocabulary or default_path(), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    found = (re.fullmatch("\u0120?([A-Za-z]{3,})", piece) for piece in sorted(ids, key=ids.get))
    words = dict.fromkeys(m[1].lower() for m in found if m)
    return " ".join([*(str(y) for y in range(1970, 2040)), *(f"{d:02d}" for d in range(60)), *reversed(words), ""]).encode()


def read_as_words(piece: str) -> str:
    """The words of an identifier, in small letters between blanks."""
    return f" {' '.join(_PARTS.findall(piece)).lower()} "


def alphabet_of(piece: str) -> str:
    """The kinds of characters in ``piece``, each in full; signs as they occur."""
    kinds = (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789"))
    has = {"a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in piece}
    return "".join(letters for k, letters in kinds if k in has) + "".join(sorted(has - {"a", "A", "0"}))


class Novelty:
    """Marginal packed bytes of a piece of text in its neighbourhood, against those of random strings."""

    def __init__(self, primed_with: bytes | None = None):
        primed = zstandard.ZstdCompressionDict(primed_with or dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=_LEVEL)
        self._packer = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        self._random: dict[tuple[str, int], float] = {}

    def cost(self, before: bytes, piece: str, behind: bytes) -> int:
        without = len(self._packer.compress(before + behind))
        return min(len(self._packer.compress(before + x.encode() + behind)) for x in (piece, read_as_words(piece))) - without

    def _mean_cost(self, before: bytes, alphabet: str, n: int, behind: bytes) -> float:
        rng = random.Random(f"{alphabet} {n}")
        return sum(self.cost(before, "".join(rng.choices(alphabet, k=n)), behind) for _ in range(_DRAWS)) / _DRAWS

    def random_cost(self, alphabet: str, n: int) -> float:
        """Mean cost of random strings in plain prose, drawn with a fixed seed; beyond ``_LONG`` characters it goes on in proportion."""
        if n > _LONG:
            return self.random_cost(alphabet, _LONG) * n / _LONG
        if (alphabet, n) not in self._random:
            self._random[alphabet, n] = self._mean_cost(_BEFORE, alphabet, n, _BEHIND)
        return self._random[alphabet, n]

    def of(self, text: str, start: int, end: int, threshold: float = NOVEL) -> tuple[float, float]:
        """Novelty of text[start:end] (ASCII) and its bits of information.

        Among many random strings all of them cost less, since their letters
        have codes of their own.  So where plain prose leaves it open whether
        the threshold is met, random strings are measured in the same place.
        """
        before, behind = (x.encode("utf-8", "surrogatepass") for x in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
        n, alphabet = end - start, alphabet_of(text[start:end])
        whole = n * math.log2(max(2, len(alphabet)))
        cost = self.cost(before, text[start:end], behind)
        novelty = cost / self.random_cost(alphabet, n)
        if novelty < threshold <= 8 * cost / whole:
            novelty = cost / max(whole / 8, self._mean_cost(before, alphabet, n, behind))
        return novelty, min(1.0, novelty) * whole


def base_spans(text: str, kinds=tuple(BASE)) -> list[tuple[int, int, str]]:
    found = []
    for kind in kinds:
        pattern, holds = BASE[kind]
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if holds(m)]
    return found


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty, threshold: float = NOVEL) -> list[tuple[int, int, str]]:
    found = []
    # ends of plain spans up to each start, so that a look at the last one before a candidate's end is enough
    covered: list[tuple[int, int]] = []
    for s, e, _ in sorted(taken):
        covered.append((s, max(e, covered[-1][1] if covered else 0)))
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        last = bisect_left(covered, (e, -1)) - 1
        if last >= 0 and covered[last][1] > s:
            continue
        if not SENSITIVE.search(text, max(0, s - BEFORE), s) and not SENSITIVE.search(text, e, e + BEHIND):
            continue
        share, bits = novelty.of(text, s, e, threshold)
        if share >= threshold and bits >= LEAST_BITS:
            found.append((s, e, "novel"))
    return found


_RANK = {kind: k for k, kind in enumerate([*BASE, "novel"])}


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], _RANK[x[2]])))


def scan(docs: DataFrame, threshold: float = NOVEL, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start, end, text).

    The dictionary (some 300 kB, as large as the vocabulary) goes to the workers.
    """
    words = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = None
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
        for batch in batches:
            texts = texts_of(batch.column(1))
            flags = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in MAYBE.items()}
            novel = pc.match_substring_regex(texts, MAYBE_SENSITIVE).to_numpy(zero_copy_only=False) & pc.match_substring_regex(texts, MAYBE_NOVEL).to_numpy(zero_copy_only=False)
            rows = []
            for i in range(len(texts)):
                kinds = [k for k in BASE if flags[k][i]]
                if not kinds and not novel[i]:
                    rows.append([])
                    continue
                text = texts[i].as_py()
                spans = base_spans(text, kinds)
                if novel[i]:
                    novelty = novelty or Novelty(words.value)
                    spans += novel_spans(text, spans, novelty, threshold)
                spans.sort(key=lambda x: (x[0], _RANK[x[2]]))
                rows.append([{"kind": k, "start": s, "end": e, "text": text[s:e]} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(apply, "doc_id long, spans array<struct<kind:string,start:long,end:long,text:string>>")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
