"""Ids of whole texts by the tokenizers library, each distinct piece encoded once a worker.

A byte-level vocabulary never joins what lies on both sides of a blank between
two other characters: the blank starts the next piece.  So a text can be cut
there, and equal pieces have equal ids.  Pieces that a worker has met are kept
in a table of bounded size, which is emptied when full.

Most new pieces are a word of Latin letters, perhaps with signs behind it and a
line break to a further word.  The library's pre-tokenizer cuts such a piece
between letters, signs and line break, and its model merges each part alone; so
the model is given only the parts that are new.  Any other piece goes through
the whole library.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from itertools import islice
from operator import attrgetter

import numpy as np

#: Pieces kept by a worker, and pieces given to the library at once.
MAX_PIECES, AT_ONCE = 1_200_000, 1000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"([{_LETTERS}]+)([{_SIGNS}]+)?(?:(\n)([{_LETTERS}]+)([{_SIGNS}]+)?)?")
_kept: dict[str, Encoder] = {}


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes are themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(others)}


_AS_LETTERS = byte_letters()
_BLANK = chr(_AS_LETTERS[32])
_id = attrgetter("id")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``encode(texts)``: little-endian ids of each text, ``dtype`` wide."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self.max_pieces = max_pieces
        self.pieces: dict[str, bytes | None] = {}  # behind a blank; None: white space at an end, so not safe to cut there
        self.bare: dict[str, bytes] = {}  # parts that follow something else

    @classmethod
    def of(cls, path: str) -> Encoder:
        """This worker's encoder: tasks that it runs later find the pieces."""
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merged(self, part: str) -> bytes:
        """Ids of one part, by the library's model; ``part`` is in the byte-level alphabet."""
        ids = array(self._code, map(_id, self.model.tokenize(part)))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _bare(self, part: str) -> bytes:
        ids = self.bare.get(part)
        if ids is None:
            ids = self.bare[part] = self._merged(part.encode().decode("latin-1").translate(_AS_LETTERS))
        return ids

    def _learn(self, words: list[str]) -> None:
        """Ids of the words with a blank in front."""
        odd = []
        pieces, bare, match = self.pieces, self._bare, _PLAIN.fullmatch
        for w in words:
            if w.isascii() and w.isalpha():
                pieces[w] = self._merged(_BLANK + w)
                continue
            m = match(w)
            if m is None:
                if w and w == w.strip():
                    odd.append(w)
                else:
                    pieces[w] = None
                continue
            word, signs, line, further, more = m.groups()
            ids = pieces.get(word)
            if ids is None:
                ids = pieces[word] = self._merged(_BLANK + (word if word.isascii() else word.encode().decode("latin-1").translate(_AS_LETTERS)))
            if signs:
                ids += bare(signs)
            if line:
                ids += bare(line) + bare(further)
                if more:
                    ids += bare(more)
            pieces[w] = ids
        groups = [odd[k : k + AT_ONCE] for k in range(0, len(odd), AT_ONCE)]
        encoded = self.tokenizer.encode_batch([[" " + w for w in g] for g in groups], is_pretokenized=True, add_special_tokens=False)
        for group, e in zip(groups, encoded):
            ids = np.array(e.ids, self.dtype).tobytes()
            cuts = np.searchsorted(np.array(e.word_ids), np.arange(len(group) + 1)) * self.dtype.itemsize
            for w, a, b in zip(group, cuts[:-1].tolist(), cuts[1:].tolist()):
                pieces[w] = ids[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # nothing here is in a cycle
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        words = set().union(*cut)
        if len(self.pieces) + len(self.bare) + len(words) > self.max_pieces:
            self.pieces.clear()
            self.bare.clear()
        pieces = self.pieces
        self._learn([w for w in words if w not in pieces])
        out = []
        for text, c in zip(texts, cut):
            first = c[0]
            try:
                if not first or first != first.strip():
                    raise TypeError
                out.append(self.plain(first) + b"".join(map(pieces.__getitem__, islice(c, 1, None))))
            except TypeError:  # white space beside a blank: cut only where it is safe
                first, *rest = _SAFE.split(text)
                self._learn([w for w in dict.fromkeys(rest) if w not in pieces])
                out.append(self.plain(first) + b"".join([pieces[w] if pieces[w] is not None else self.plain(" " + w) for w in rest]))
        return out


def grouped(texts: list[str], max_chars: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of texts of about ``max_chars`` characters."""
    runs, lo, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= max_chars:
            runs.append((lo, i + 1))
            lo, held = i + 1, 0
    if lo < len(texts):
        runs.append((lo, len(texts)))
    return runs
