"""Word shingles of whole texts as 64-bit numbers."""

from __future__ import annotations

import numpy as np

from weekloom.llm.common import SpanHash, mixed

WORDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32

_hash = SpanHash(seed=3)
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def word_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of the lower-cased words of all texts, and where each text's words begin and end."""
    raw = [t.encode() + b" " for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    data = _LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return _hash(data, starts, stops), np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle numbers of each text; a text of fewer words is one shingle, one without words none."""
    w, bounds = word_numbers(texts)
    n = len(w) - words + 1
    run = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(words):
        if n > 0:
            run += mixed(w[k: k + n] * _ODD[k % len(_ODD)] + np.uint64(k))
    run = mixed(run)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(run[lo: hi - words + 1]))
        elif hi > lo:
            short = np.array([hi - lo], dtype=np.uint64)
            for k in range(hi - lo):
                short = mixed(short + w[lo + k: lo + k + 1] * _ODD[k % len(_ODD)])
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_key(h: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit digests of a set."""
    a = mixed(np.array([mixed(h).sum(dtype=np.uint64)], dtype=np.uint64) + np.uint64(len(h)))
    b = np.array([mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=np.uint64)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])
