"""Column-wise construction of a collection's Burrows-Wheeler transform and longest common prefixes.

Round by round, from their ends, each text of the collection inserts one symbol: the suffix that is one longer than
the one before. Where it goes follows from the rank of its symbol in the transform; its common prefix with its left
neighbour, and its right neighbour's with it, are one more than the least common prefix between the two earlier
suffixes. Nothing but the transform, the prefixes (cut off at ``most``) and each text's place is kept, and each round
reads and rewrites them from front to back: as files in ``folder`` if one is given (a collection larger than memory),
else as arrays.
"""

from __future__ import annotations

import os

import numpy as np

NONE = 255  # no byte of UTF-8


class Columns:
    """Two sequences that are read and rewritten as a whole."""

    def __init__(self, folder: str | None, size: int) -> None:
        self.folder, self.turn, self.made = folder, 0, []
        self.bwt, self.lcp = np.full(size, NONE, np.uint8), np.zeros(size, np.uint8)

    def fresh(self, name: str, size: int) -> np.ndarray:
        if not self.folder or not size:
            return np.empty(size, np.uint8)
        path = os.path.join(self.folder, f"{name}{self.turn % 2}.{os.getpid()}")
        self.made.append(path)
        return np.memmap(path, np.uint8, "w+", shape=(size,))

    def insert(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """New symbols at places ``at`` (rising, in the longer sequence); returns where the old ones went, as a mask."""
        size = len(self.bwt) + len(at)
        old = np.ones(size, bool)
        old[at] = False
        bwt, lcp = self.fresh("bwt", size), self.fresh("lcp", size)
        bwt[old], lcp[old] = self.bwt, self.lcp
        bwt[at], lcp[at] = symbols, 0
        self.bwt, self.lcp, self.turn = bwt, lcp, self.turn + 1
        return old

    def close(self) -> None:
        for path in set(self.made):
            if os.path.exists(path):
                os.remove(path)


def repeated_starts(data: np.ndarray, off: np.ndarray, most: int, folder: str | None = None) -> np.ndarray:
    """For each byte of the texts data[off[i]:off[i+1]], whether the ``most`` bytes from there (inside the text) also
    start anywhere else in the collection. ``most`` is 254 at most; texts are UTF-8."""
    n = len(off) - 1
    lengths = np.diff(off)
    flags = np.zeros(len(data), bool)
    if not n:
        return flags
    columns = Columns(folder, n)
    try:
        return _rounds(columns, data, off, lengths, most, flags)
    finally:
        columns.close()


def _rounds(columns: Columns, data: np.ndarray, off: np.ndarray, lengths: np.ndarray, most: int, flags: np.ndarray) -> np.ndarray:
    n = len(lengths)
    active = np.flatnonzero(lengths > 0)
    columns.bwt[active] = data[off[1:][active] - 1]
    place = active
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        bwt, lcp = columns.bwt, columns.lcp
        order = np.argsort(bwt, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])
        symbol = bwt[place].astype(np.int64)
        by = np.argsort(symbol, kind="stable")  # place rises, so each symbol's places rise too
        cuts = np.searchsorted(symbol[by], np.arange(257))
        place, active, symbol = place[by], active[by], symbol[by]
        rank = np.empty(len(place), np.int64)
        for c in np.flatnonzero(np.diff(cuts)):
            rank[cuts[c] : cuts[c + 1]] = starts[c] + np.searchsorted(order[starts[c] : starts[c + 1]], place[cuts[c] : cuts[c + 1]])
        at = n + rank
        left = np.where(rank > starts[symbol], order[np.maximum(rank - 1, 0)], -1)
        right = np.where(rank + 1 < starts[symbol + 1], order[np.minimum(rank + 1, len(order) - 1)], -1)
        low, high = _least(lcp, left, place, most), _least(lcp, place, right, most)
        more = lengths[active] > depth
        following = np.full(len(active), NONE, np.uint8)
        following[more] = data[off[1:][active[more]] - depth - 1]
        columns.insert(at, following)
        columns.lcp[at] = low
        beside = np.flatnonzero(right >= 0)
        columns.lcp[at[beside] + 1] = high[beside]
        active, place = active[more], at[more]
        if not len(active):
            break
    full = np.asarray(columns.lcp) >= most
    hit = full.copy()
    hit[:-1] |= full[1:]
    # each text's suffixes once more, from the shortest on, by the finished transform
    order = np.argsort(columns.bwt, kind="stable")
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(n, n + len(order))
    active = place = np.flatnonzero(lengths > 0)
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        place = to[place]
        if depth >= most:
            flags[off[1:][active] - depth] = hit[place]
        more = lengths[active] > depth
        active, place = active[more], place[more]
    return flags


def _least(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
    """1 + min(lcp[lo + 1 : hi + 1]), cut off at ``most``; 0 where lo or hi is -1."""
    out = np.zeros(len(lo), np.uint8)
    ok = np.flatnonzero((lo >= 0) & (hi >= 0))
    size = hi[ok] - lo[ok]
    ends = np.cumsum(size)
    done = 0
    while done < len(ok):  # at most some 4M values at once, or one span
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 22), side="right")))
        n, first = size[done:upto], lo[ok[done:upto]] + 1
        begin = np.cumsum(n) - n
        values = np.asarray(lcp[np.repeat(first - begin, n) + np.arange(int(n.sum()))])
        out[ok[done:upto]] = np.minimum(np.minimum.reduceat(values, begin), most - 1) + 1
        done = upto
    return out
