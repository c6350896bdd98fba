"""Pair merging of many slices at once.

Slices of similar length are the rows of an array of ids. In each round every row joins its pair of lowest
rank, the leftmost of equals, until no row has a pair that is a token. Ranks of pairs come from a hash table
over all ways to part a token into two tokens, probed for whole columns at a time.

Long slices are merged one by one, with their pairs in a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: Slices longer than this are merged one by one.
LONGEST = 48
#: Rank of a pair that is no token.
NONE = np.int32(2**31 - 1)


def merge_one(ids: list[int], find: Callable[[int, int], tuple[int, int] | None]) -> list[int]:
    """``ids`` with the pair of lowest rank joined, the leftmost of equals, until none is left. ``find`` gives
    a pair's rank and joint. The work grows as n log n with the number of ids."""
    n, ids = len(ids), list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    shift = max(n.bit_length(), 1)
    # rank and place as one number; an entry whose pair has changed since is passed over
    heap = [x[0] << shift | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (x := find(a, b)) is not None]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & ((1 << shift) - 1)
        j = after[i]
        if ids[i] < 0 or j >= n:
            continue
        found = find(ids[i], ids[j])
        if found is None or found[0] != top >> shift:
            continue
        ids[i], ids[j] = found[1], -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (x := find(ids[i], ids[k])) is not None:
                heapq.heappush(heap, x[0] << shift | i)
        h = before[i]
        if h >= 0 and (x := find(ids[h], ids[i])) is not None:
            heapq.heappush(heap, x[0] << shift | h)
    return [x for x in ids if x >= 0]


class Pairs:
    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        keys, joint = [], []
        for word, i in ranks.items():
            for k in range(1, len(word)):
                a, b = get(word[:k]), get(word[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    joint.append(i)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.joint = np.full(1 << self.bits, NONE, np.int32)
        todo, said = np.array(keys, np.int64), np.array(joint, np.int32)
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] < 0
            # of several that want one slot the first gets it, the rest move on
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots], self.joint[slots] = todo[won], said[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, said, at = todo[left], said[left], (at[left] + 1) & ((1 << self.bits) - 1)
        self.byte = np.array([get(bytes([b]), -1) for b in range(256)], np.int64)
        every = np.repeat(self.byte, 256) << 32 | np.tile(self.byte, 256)
        self.bytes = self.find(every).reshape(256, 256)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The joint of each pair (left id << 32 | right id), NONE if it is no token."""
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.joint[at], NONE)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.joint[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each slice. Every slice must be LONGEST bytes at most, and not empty."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, 26), (26, LONGEST)):
            own = np.flatnonzero((size > low) & (size <= high))
            if len(own):
                for i, ids in zip(own.tolist(), self._rows([pieces[i] for i in own.tolist()], size[own], high)):
                    out[i] = ids
        return out

    def _rows(self, pieces: list[bytes], size: np.ndarray, width: int) -> list[list[int]]:
        # ids and ranks lie flat, row after row; a row's places are found by adding its beginning
        n = len(pieces)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        ids = self.byte[raw].ravel()
        column = np.arange(width)
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.bytes[raw[:, :-1], raw[:, 1:]]
        rank[column >= size[:, None] - 1] = NONE
        # a joined pair's right place is left empty; links lead over empty places
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1)).ravel()
        after = np.minimum(after, size[:, None].astype(np.int32)).ravel()
        full = (column < size[:, None]).ravel()
        end = size.astype(np.int64)
        row = np.arange(n)
        flat = rank.ravel()
        while len(row):
            j = rank[row].argmin(axis=1)
            at = row * width + j
            best = flat[at]
            some = best != NONE
            if not some.all():
                row, j, at, best = row[some], j[some], at[some], best[some]
                if not len(row):
                    break
            begin = at - j
            gone = after[at]
            ids[at] = best
            over = after[begin + gone]
            after[at] = over
            flat[at] = flat[begin + gone] = NONE
            full[begin + gone] = False
            right = over < end[row]
            b, k, o = begin[right], at[right], over[right]
            before[b + o] = j[right]
            flat[k] = self.find(ids[k] << 32 | ids[b + o])
            left = before[at]
            some = left >= 0
            b = begin[some] + left[some]
            flat[b] = self.find(ids[b] << 32 | best[some])
        kept = full.reshape(n, width)
        out, lo = [], 0
        every = ids[full].tolist()
        for k in kept.sum(axis=1).tolist():
            out.append(every[lo : lo + k])
            lo += k
        return out
