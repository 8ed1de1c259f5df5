"""T-occurrence search over one block of sets: DivideSkip."""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush, heapreplace
from math import log2

import numpy as np

MU = 0.0085  # the method's cost ratio of merging to probing


def least_overlap(n: int) -> int:
    """Shared shingles that a set of n needs with any set at similarity 0.8 or more."""
    return -(-4 * n // 5)


def linked(overlap, n, m):
    return 100 * overlap >= 80 * (n + m - overlap)


def merge_skip(lists: list[list[int]], need: int) -> dict[int, int]:
    """Members on at least ``need`` of the sorted lists, with their counts, by a heap that skips."""
    found: dict[int, int] = {}
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    at = [0] * len(lists)
    heapify(heap)
    while len(heap) >= need:
        top = heap[0][0]
        count = 0
        while heap and heap[0][0] == top:
            i = heap[0][1]
            count += 1
            at[i] += 1
            if at[i] < len(lists[i]):
                heapreplace(heap, (lists[i][at[i]], i))
            else:
                heappop(heap)
        if count >= need:
            found[top] = count
        elif need - 1 <= len(heap) and need > 1:
            # whatever is smaller than the need-th head cannot be on enough lists
            moved = [heappop(heap)[1] for _ in range(need - 1)]
            if not heap:
                break
            goal = heap[0][0]
            for i in moved:
                at[i] = bisect_left(lists[i], goal, at[i])
                if at[i] < len(lists[i]):
                    heappush(heap, (lists[i][at[i]], i))
    return found


class OverlapIndex:
    """Inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, every))
        self.owner = owner[order]
        self.tokens, self.start = np.unique(every[order], return_index=True)
        self.stop = np.append(self.start[1:], len(every)).astype(np.int64)

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(members, overlaps) of all sets linked to the query."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.tokens) or not len(query):
            return none
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        t = least_overlap(len(query))
        if len(at) < t:
            return none
        length = self.stop[at] - self.start[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(self.stop[at[-1]] - self.start[at[-1]])
        aside = min(t - 1, int(t / (MU * log2(longest) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside:]
        count = merge_skip([self.owner[self.start[i]: self.stop[i]].tolist() for i in short], t - aside)
        if not count:
            return none
        members = np.array(sorted(count))
        overlap = np.array([count[m] for m in members.tolist()])
        left = len(long)
        for i in long.tolist():
            held = self.owner[self.start[i]: self.stop[i]]
            place = np.minimum(np.searchsorted(held, members), len(held) - 1)
            overlap += held[place] == members
            left -= 1
            possible = overlap + left >= t
            if not possible.all():
                members, overlap = members[possible], overlap[possible]
                if not len(members):
                    return none
        true = linked(overlap, len(query), self.sizes[members])
        return members[true], overlap[true]
