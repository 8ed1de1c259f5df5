"""Byte-level BPE ids of many texts, piece by piece.

The tokenizer's own split always breaks at some easily seen places (before a
space that a word follows, between a letter and punctuation, around a
single line feed that a letter follows). Cutting there first gives short pieces that repeat all
the time; each distinct piece is encoded once per worker and looked up by its
64-bit span hash and length afterwards. The ids are those of whole texts.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from weekloom.llm.common import SpanHash

CACHE_PIECES = 1 << 18
LONGEST = 64  # longer pieces are encoded each time

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[ord("A"): ord("Z") + 1] = _ASCII_LETTER[ord("a"): ord("z") + 1] = True
_ASCII = np.arange(256) < 128
_MAYBE_SPACE = np.zeros(256, dtype=bool)  # ASCII white space, and lead bytes of wider white space
_MAYBE_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class CachedTokenizer:
    _shared: dict[str, "CachedTokenizer"] = {}

    @classmethod
    def shared(cls, path: str) -> "CachedTokenizer":
        """One per worker and file, so that its cache outlives a task."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # the strings of special tokens in a text are those tokens, as the tokenizer has it
        self.special = sorted({t.content.encode() for t in self.tok.get_added_tokens_decoder().values()})
        self.hash = SpanHash()
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}  # hash -> row of the two arrays
        self.begin, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _encoded(self, pieces: list[bytes]) -> list:
        return self.tok.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)

    def _raw(self, pieces: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self._encoded(pieces)]

    def _remember(self, keys: list[int], pieces: list[bytes]) -> None:
        found = [e.ids for e in self._encoded(pieces)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        to = self.used + np.cumsum(counts)
        row, rows, used = len(self.at), len(self.at) + len(found), int(to[-1]) if found else self.used
        while rows > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used: used] = np.fromiter(chain.from_iterable(found), np.uint32, used - self.used)
        self.begin[row: rows], self.count[row: rows] = to - counts, counts
        self.at.update(zip(keys, range(row, rows)))
        self.used = used

    @staticmethod
    def cuts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Places where a new piece surely starts; ``borders`` are the starts of further texts."""
        before, here = data[:-1], data[1:]
        after = np.append(data[2:], 32)[: len(here)]
        after[borders[(borders >= 2) & (borders < len(data))] - 2] = 32
        latin = np.zeros(len(before), dtype=bool)  # the two-byte letters that U+00C0 to U+00FF have
        latin[1:] = (before[:-1] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
        letter = _ASCII_LETTER[before] | latin
        cut = (here == 32) & ~_MAYBE_SPACE[after]
        cut |= letter & _ASCII[here] & ~_ASCII_LETTER[here]
        cut[1:] |= (before[1:] == 10) & _ASCII_LETTER[here[1:]] & _ASCII[before[:-1]] & ~_MAYBE_SPACE[before[:-1]]
        return np.flatnonzero(cut) + 1

    def without_special(self, buffer: bytes, cuts: np.ndarray) -> np.ndarray:
        """The cuts that lie neither inside a special token nor in the white space before it."""
        for token in self.special:
            at = buffer.find(token)
            while at >= 0:
                start, stop = at, at + len(token)
                while start and _MAYBE_SPACE[buffer[start - 1]]:
                    start -= 1
                lo, hi = np.searchsorted(cuts, [start + 1, stop])
                cuts = np.delete(cuts, np.s_[lo:hi])
                at = buffer.find(token, stop)
        return cuts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        buffer = b"".join(raw)
        if not buffer:
            return [b""] * len(texts)
        data = np.frombuffer(buffer, dtype=np.uint8)
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[0] = begins[ends] = begins[self.without_special(buffer, self.cuts(data, ends[:-1]))] = True
        starts = np.flatnonzero(begins[:-1])
        stops = np.append(starts[1:], len(data))
        long = np.flatnonzero(stops - starts > LONGEST)
        keys = self.hash(data, starts, stops)
        keys[long] = 0  # any one value; their rows are not used
        coded = pa.array(keys).dictionary_encode()
        inverse, listed = np.asarray(coded.indices), np.asarray(coded.dictionary).tolist()
        where = np.empty(len(listed), np.int64)
        where[inverse[::-1]] = np.arange(len(keys) - 1, -1, -1)  # first place of each
        if len(self.at) > CACHE_PIECES:
            self._clear()
        missing = np.array([k for k, key in enumerate(listed) if key not in self.at], np.int64)
        new = where[missing]
        self._remember([listed[k] for k in missing.tolist()], [buffer[lo:hi] for lo, hi in zip(starts[new].tolist(), stops[new].tolist())])
        rows = np.fromiter(map(self.at.__getitem__, listed), np.int64, len(listed))[inverse]
        begin, count = self.begin[rows], self.count[rows]
        apart = self._raw([buffer[starts[k]: stops[k]] for k in long.tolist()])
        count[long] = [len(x) for x in apart]
        begin[long] = 0
        to = np.cumsum(count)
        source = np.arange(to[-1]) + np.repeat(begin - to + count, count)
        ids = self.flat[np.minimum(source, len(self.flat) - 1)].astype("<u4")
        for k, x in zip(long.tolist(), apart):
            ids[to[k] - count[k]: to[k]] = x
        per_text = np.concatenate([[0], to])[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return [ids[lo:hi].tobytes() for lo, hi in zip(per_text[:-1].tolist(), per_text[1:].tolist())]
