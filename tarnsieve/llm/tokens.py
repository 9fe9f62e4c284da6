"""Token ids of whole texts by a public tokenizer file, at word-cache speed.

The tokenizers library spends almost all of its time in the merges of single words, and
the words of a corpus repeat.  `WordTokenizer` therefore cuts texts at spaces, tabs and line
ends, has the library encode each distinct piece once, and joins the cached ids.  That is
exact for tokenizers which drop white space and never merge across it, such as
`word_bpe_49k.json` (its pre-tokenizer keeps runs of letters, single digits and runs of
other marks).  Each file is probed for it; one that fails has whole texts encoded by the library.

Memory: the cache is bounded in bytes and the bound is looked at every `_AT_ONCE` pieces; a long text
is cut at white space into slices of `_SLICE` characters, so what exists beside the cache and the ids
is the pieces of one slice.  A run of characters without any white space is one piece.
"""

from __future__ import annotations

import re
import sys
import zlib
from itertools import chain

import numpy as np

#: What ends a document in the written and packed token streams.
END_ID = 2

#: Bytes that a worker's cache of words and their ids may hold.
CACHE_BYTES = 256 << 20

#: Pieces that are looked up at once, and characters of a text that are cut into pieces at once.
_AT_ONCE, _SLICE = 50_000, 250_000

#: Stands for a text's end among its pieces; no piece holds a line end.
_END = "\n"

#: A word of Latin-1 letters with at most one mark behind it: case and mark are independent of it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


class _Places(dict):
    """Piece to place in the store; a new piece gets the next place and waits to be encoded."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        self.waiting.append(piece)
        return place


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: visible Latin-1 as itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_GAP = re.compile(r"[ \t\r\n]")

#: Texts whose ids must be those of their pieces if a tokenizer drops white space.
_PROBES = ["a b", " A  b\tc\n\nd\r\n", "It's 12, 'tis ok?\nyes - no", "x\u00a0y e\u0301 \u0301", "word , .. (a) \u4e2d \u6587\n"]


def _slices(text: str):
    """The text in slices that end at white space."""
    at = 0
    while len(text) - at > _SLICE:
        gap = _GAP.search(text, at + _SLICE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def _pieces(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class WordTokenizer:
    """Encodes texts with the tokenizer file at `path`; a cache of over `cache_bytes` starts anew."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._model, self._letters = self._whole.model, _byte_letters()
        self._limit = cache_bytes
        self._marks: dict[str, list[int]] = {"": []}
        self._end_id: int | None = None
        #: whether the pieces' ids are the text's
        self.by_pieces = all(list(chain.from_iterable(self._ids_of(_pieces(t)))) == self._ids_of([t])[0] for t in _PROBES)
        # plain words may go straight to the merges if that gives what the whole tokenizer gives
        probes = ["the", "straße", "élevé", "señor", "tokenizer", "øre", "ÿ", "a"]
        self._direct = all(self._word(w) == self._ids_of([w])[0] == self._ids_of([w.upper() if len(w.upper()) == len(w) else w])[0] for w in probes)
        self._clear()

    def _ids_of(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self._whole.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """Ids of one lower-case word of Latin-1 letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self._model.tokenize(word)]

    def _clear(self) -> None:
        self._places = _Places()
        self._ids = np.empty(1 << 16, np.uint32)
        self._from = np.empty(1 << 16, np.int64)
        self._len = np.empty(1 << 16, np.int64)
        self._used = self._known = 0
        #: bytes held: a dictionary's slot and a number are some 130 for each piece
        self.held = 0

    def _put(self, pieces: list[str], ids: list[list[int]]) -> None:
        """Appends the ids of the next places."""
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        total, known = int(lens.sum()), self._known + len(ids)
        if self._used + total > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._used], np.empty(self._used // 8 + total + (1 << 16), np.uint32)])
        if known > len(self._from):
            more = np.empty(known // 8 + len(ids) + (1 << 16), np.int64)
            self._from = np.concatenate([self._from[: self._known], more])
            self._len = np.concatenate([self._len[: self._known], more])
        self._ids[self._used : self._used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self._from[self._known : known] = self._used + np.cumsum(lens) - lens
        self._len[self._known : known] = lens
        self._used += total
        self._known = known
        self.held += sum(map(sys.getsizeof, pieces)) + 4 * total + 150 * len(pieces)

    def _learn(self, end_id: int | None) -> None:
        """Encodes the waiting pieces: plain words by the merges alone, others by the whole tokenizer."""
        waiting, self._places.waiting = self._places.waiting, []
        found: list = [None] * len(waiting)
        others, fresh = [], {}
        for k, piece in enumerate(waiting):
            if piece == _END:
                found[k] = [end_id]
                continue
            m = _PLAIN.fullmatch(piece) if self._direct else None
            if m is None:
                others.append(k)
                continue
            word, mark = m.groups()
            word = word.lower()
            if (ids := fresh.get(word)) is None:
                at = self._places.get(word, self._known)
                if at < self._known:
                    ids = self._ids[self._from[at] : self._from[at] + self._len[at]].tolist()
                else:
                    ids = self._word(word)
                fresh[word] = ids
            if mark:
                if mark not in self._marks:
                    self._marks[mark] = self._ids_of([mark])[0]
                ids = ids + self._marks[mark]
            found[k] = ids
        for k, ids in zip(others, self._ids_of([waiting[k] for k in others])):
            found[k] = ids
        self._put(waiting, found)

    def _look_up(self, pieces: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and how many each has."""
        if self.held > self._limit or end_id != self._end_id:
            self._clear()
            self._end_id = end_id
        at = np.fromiter(map(self._places.__getitem__, pieces), np.int64, len(pieces))
        if self._places.waiting:
            self._learn(end_id)
        lens = self._len[at]
        take = np.repeat(self._from[at] - (np.cumsum(lens) - lens), lens)
        take += np.arange(len(take))
        return self._ids[take], lens

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has; with `end_id` behind each, if given."""
        if not self.by_pieces:
            ids = [i + [end_id] * (end_id is not None) for i in self._ids_of(texts)]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens
        found, per_text = [], np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owners: list[int] = []  # texts of the waiting pieces, and how many each has
        counts: list[int] = []

        def look_up():
            ids, lens = self._look_up(pieces, end_id)
            found.append(ids)
            np.add.at(per_text, np.repeat(owners, counts), lens)
            pieces.clear(), owners.clear(), counts.clear()

        for i, text in enumerate(texts):
            for part in _slices(text):
                had = len(pieces)
                pieces += _pieces(part)
                owners.append(i)
                counts.append(len(pieces) - had)
                if len(pieces) >= _AT_ONCE:
                    look_up()
            if end_id is not None:
                pieces.append(_END)
                owners.append(i)
                counts.append(1)
        if pieces:
            look_up()
        return np.concatenate(found) if found else np.empty(0, np.uint32), per_text


_made: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, cache_bytes: int = CACHE_BYTES) -> WordTokenizer:
    """This Python worker's tokenizer; its cache stays from task to task."""
    if (path, cache_bytes) not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made.clear()  # one cache in a worker
        _made[path, cache_bytes] = WordTokenizer(path, cache_bytes)
    return _made[path, cache_bytes]


def blocks(column, most_bytes: int = 500_000):
    """(first, texts) of runs of an Arrow column of texts, about `most_bytes` each, so that only one run
    exists as Python strings; a null text is empty."""
    import pyarrow.compute as pc

    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield first, [t or "" for t in column.slice(first, last - first).to_pylist()]
        first = last


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
