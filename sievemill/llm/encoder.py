"""Whole-text encoding with the tokenizers library, through a table of the ids of the words met so far.

Texts of plain Western prose (ASCII and À-ÿ, single spaces and line feeds, no apostrophes) are cut into the
tokenizer's own pre-tokens with array operations; the library encodes each distinct pre-token once in a worker, and
the ids of all texts are gathered from that table. Every other text is encoded whole by the library. Both ways give
the ids that the library gives for the whole text, which the tests check.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from . import common

# One thread a task: Spark runs a task on every core already.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

#: Words that the table of a worker holds (about 45 MB with their ids); it starts anew beyond that.
TABLE_WORDS = 800_000
#: Bytes of text that encode() should get at once; its arrays take about 40 times as much.
PIECE = 1 << 19

_SPACE, _LINE, _LETTER, _NUMBER, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x20], _CLASS[0x0A] = _SPACE, _LINE
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER
_CLASS[0x30:0x3A] = _NUMBER
_RARE = np.zeros(256, bool)
_RARE[:0x20] = _RARE[0x7F] = _RARE[0x27] = _RARE[0xC0:] = True
_RARE[0x0A] = _RARE[0xC3] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[0x80:0x9F] += 0x20  # after 0xC3: À to Þ


class Encoder:
    """kind: "spaced" for a byte-level tokenizer whose words take the space before them along, "bare" for one that lower-cases and drops white space."""

    def __init__(self, path: str, kind: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.spaced = kind == "spaced"
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values, self.n = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0
        self.start, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        # The library's result objects are large; few of them are alive at once.
        return [np.array(e.ids, np.uint32) for k in range(0, len(texts), 2000) for e in self.tokenizer.encode_batch_fast(texts[k : k + 2000], add_special_tokens=False)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash in the table, -1 if it is not there."""
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        out = np.full(len(h), -1, np.int32)
        key = self.keys[slot]
        hit = key == h
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & mask
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        left = np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            at, first = np.unique(slot[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[at], self.values[at] = h[placed], rows[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & mask

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        ids = self.whole(words)
        rows = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        self.start = np.append(self.start, self.start[-1] + np.cumsum([len(x) for x in ids]))
        self.pool = np.concatenate([self.pool, *ids])
        if self.n > 0.4 * len(self.keys):
            held = np.flatnonzero(self.keys)
            keys, values = self.keys[held], self.values[held]
            size = len(self.keys)
            while self.n > 0.4 * size:
                size *= 2
            self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(keys, values)
        self._put(h, rows)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of ids) of UTF-8 texts."""
        n_docs, n = len(offsets) - 1, len(data)
        kind = _CLASS[data]
        odd = _RARE[data]
        if n > 1:
            # × and ÷ are no letters; white space beside white space may go together; nothing may end in a space.
            sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            odd[:-1] |= sign if not self.spaced else sign | (kind[:-1] <= _LINE) & (kind[1:] <= _LINE)
        if self.spaced and n:
            ends = offsets[1:][np.diff(offsets) > 0] - 1
            odd[ends] |= data[ends] == 0x20
        sums = np.append(0, np.cumsum(odd, dtype=np.int64))
        plain = (sums[offsets[1:]] - sums[offsets[:-1]]) == 0
        # Starts of pre-tokens.
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) & ((kind[:-1] != _SPACE) | (not self.spaced))
        if self.spaced:
            start |= (kind == _SPACE) | (kind == _LINE)
        else:
            start |= kind == _NUMBER
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)[: len(begin)]
        doc = np.searchsorted(offsets, begin, "right") - 1
        use = plain[doc]
        if not self.spaced:
            use &= kind[begin] >= _LETTER
        begin, end, doc = begin[use], end[use], doc[use]
        text = data if self.spaced else _LOWER[data]
        h = common.slice_hashes(text, begin, end)
        if self.n > TABLE_WORDS:
            self._clear()
        row = self._find(h)
        if (missing := np.flatnonzero(row < 0)).size:
            new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            raw = text.tobytes()
            self._learn(new, [raw[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            row[missing] = self._find(h[missing])
        length = self.start[row + 1] - self.start[row]
        per_doc = np.zeros(n_docs, np.int64)
        sums = np.append(0, np.cumsum(length))
        edge = np.searchsorted(doc, np.arange(n_docs + 1))
        per_doc = sums[edge[1:]] - sums[edge[:-1]]
        total = int(sums[-1])
        ids = self.pool[np.repeat(self.start[row] - sums[:-1], length) + np.arange(total)]
        if plain.all():
            return ids, np.append(0, np.cumsum(per_doc))
        raw = data.tobytes()
        hard = np.flatnonzero(~plain)
        coded = self.whole([raw[offsets[k] : offsets[k + 1]].decode() for k in hard])
        parts, at = [], 0
        for k, x in zip(hard.tolist(), coded, strict=True):
            parts += [ids[sums[edge[at]] : sums[edge[k]]], x]
            per_doc[k], at = len(x), k + 1
        parts.append(ids[sums[edge[at]] :])
        return np.concatenate(parts), np.append(0, np.cumsum(per_doc))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder for a vocabulary file; it keeps its table from task to task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
