"""Exact, fast encoding of many whole texts with the tokenizers library.

Neither tokenizer here ever makes a token across a boundary between a character that isn't white space and a following
space or line feed, or between a word of letters and a following mark such as a comma. So a text's ids are those of its
pieces between such boundaries, each of which the library encodes once per worker; the tests compare this with encoding
whole texts. The string of a special token in a text has that token's id, as the library's default is; no such string holds
a boundary.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np

#: white space other than space and line feed, in the widest sense of any library
ODD = re.compile(r"[^\S \n]")
#: a word of letters that a boundary follows; the apostrophe isn't one, since it may begin a token with letters
_LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,!?;:#*$%&|]|\Z)"
#: spaces and line feeds go with what follows them
LEADING = re.compile(rf"[ \n]*(?:{_LETTERS}|[^ \n]+)|[ \n]+")
#: for texts with odd white space: a space after it isn't a boundary
LEADING_ODD = re.compile(r"[ \n]*(?:[^ \n]|(?<=[^\S \n])[ \n]+)+|[ \n]+")
#: for tokenizers that drop white space
BARE = re.compile(rf"{_LETTERS}|[^ \n]+")

#: a whole piece that is one word, which the model takes without normaliser and splitter
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_characters() -> dict[int, str]:
    """The characters that byte-level models write bytes with: visible ones as they are, the others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


PIECES = 400_000  # pieces a worker keeps by default; a matter of memory against time, never of results
_codecs: dict[tuple, "Codec"] = {}


def codec(name: str, *, drops_space: bool = False, offsets: bool = False, most: int = PIECES) -> "Codec":
    """The worker's own codec for a tokenizer file; kept between tasks. most: pieces kept, about 150 bytes each."""
    key = (name, drops_space, offsets, most)
    if key not in _codecs:
        _codecs[key] = Codec(name, drops_space, offsets, most)
    return _codecs[key]


class Codec:
    def __init__(self, name: str, drops_space: bool, offsets: bool, most: int = PIECES):
        """most: pieces kept; beyond that, the table of pieces is begun anew."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from .common import tokenizer_path

        self.tokenizer = Tokenizer.from_file(name if "/" in name else tokenizer_path(name))
        self.drops_space, self.offsets, self.most = drops_space, offsets, most
        self.bytes = byte_characters()
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.spans = np.empty((1 << 16, 2), np.int32) if self.offsets else None
        self.first = np.zeros(1 << 16, np.int64)
        self.full = 0

    def _grow(self, array, n):
        while len(array) < n:
            array = np.concatenate([array, np.empty_like(array)])
        return array

    def _words(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that are words: the model alone, on their bytes' characters."""
        one, table, lower = self.tokenizer.model.tokenize, self.bytes, self.drops_space
        text = (p.lower() if lower else p for p in pieces)
        return [[t.id for t in one(p.encode().decode("latin-1").translate(table))] for p in text]

    def _learn(self, pieces: list[str]):
        if not self.offsets:
            words = [p for p in pieces if _WORD.fullmatch(p)]
            self._add(words, self._words(words))
            pieces = [p for p in pieces if p not in self.at]
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            coded = (self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast)(part, add_special_tokens=False)
            self._add(part, [e.ids for e in coded], [s for e in coded for s in e.offsets] if self.offsets else None)

    def _add(self, pieces: list[str], rows: list[list[int]], spans: list | None = None):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        n, end = len(self.at), self.full + int(sizes.sum())
        self.ids = self._grow(self.ids, end)
        self.ids[self.full : end] = np.fromiter(chain.from_iterable(rows), np.int32, end - self.full)
        if spans is not None:
            self.spans = self._grow(self.spans, end)
            self.spans[self.full : end] = np.array(spans, np.int32).reshape(-1, 2)
        self.first = self._grow(self.first, n + len(rows) + 1)
        self.first[n + 1 : n + len(rows) + 1] = self.full + np.cumsum(sizes)
        self.at.update(zip(pieces, range(n, n + len(pieces))))
        self.full = end

    def encode(self, texts: list[str]):
        """(ids of all texts, ids of each text) and, with offsets, the ids' code point spans in their texts."""
        split = [(BARE if self.drops_space else LEADING_ODD if ODD.search(t) else LEADING).findall(t) for t in texts]
        pieces = list(chain.from_iterable(split))
        which = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(which < 0).tolist()
        fresh = list(dict.fromkeys(pieces[k] for k in missing))
        if len(self.at) + len(fresh) > self.most:
            fresh, missing = list(dict.fromkeys(pieces)), range(len(pieces))
            self._clear()
        if fresh:
            self._learn(fresh)
            which[missing] = [self.at[pieces[k]] for k in missing]
        starts, sizes = self.first[which], self.first[which + 1] - self.first[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
        marks = np.cumsum([len(s) for s in split])
        counts = np.diff(np.concatenate([[0], np.concatenate([[0], ends])[marks]])) if len(marks) else np.empty(0, np.int64)
        if not self.offsets:
            return self.ids[take], counts
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(lengths) - lengths
        heads = np.concatenate([[0], marks[:-1]]).astype(np.int64)
        own = np.concatenate([np.cumsum(lengths), [0]])
        text_begins = np.where(heads > 0, own[heads - 1], 0)
        begins = begins - np.repeat(text_begins, [len(s) for s in split])
        return self.ids[take], counts, self.spans[take] + np.repeat(begins, sizes)[:, None]


def texts_of(column, most: int = 1 << 18):
    """Lists of a column's texts, about `most` characters each; nulls are empty. Gives (row range, texts)."""
    a, texts, size = 0, [], 0
    for x in column:
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield a, texts
            a, texts, size = a + len(texts), [], 0
    if texts:
        yield a, texts
