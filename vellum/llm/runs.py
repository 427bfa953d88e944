"""Runs of windows that share a minimum: how texts are cut where their content says, for repeat search.

A window is ``length`` consecutive items (bytes or words). Among the hashes of its k-grams the least one, the
leftmost of equals, is its anchor; equal windows have equal anchors at equal places in them. Consecutive windows
with one anchor are a run. So equal windows always meet under their anchor's hash, while a text gives only
some 2 / (length - k + 2) runs an item. Two windows of one run are never equal, as their anchor stands at
different places in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import common

U64 = np.uint64
#: Bits of a place within one part of the texts; a part has fewer items than that.
POSITION = 22


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    rows = full.reshape(-1, w)
    front = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], front[w - 1 : n])


def runs(prefix: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, hash of all that the run's windows cover, first window, number of windows, anchor), places from
    the beginning of ``prefix``; texts are first[i]:first[i + 1], windows don't reach from one into another."""
    n = len(prefix) - 1
    none = np.zeros(0, np.int64)
    if n >= 1 << POSITION:
        raise ValueError(f"a part of {n} items has places that {POSITION} bits don't hold")
    if n < length:
        return none, none.view(U64), none.view(U64), none, none, none
    _, down = common.powers(n + 1)
    h = (prefix[k:] - prefix[: n - k + 1]) * down[: n - k + 1]
    h = common.mix(h)
    mask = U64((1 << POSITION) - 1)
    keyed = (h & ~mask) | np.arange(len(h), dtype=U64)
    at = (sliding_min(keyed, length - k + 1) & mask).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    good = np.flatnonzero(np.diff(first) >= length)
    np.add.at(edge, first[good], 1)
    np.add.at(edge, first[good + 1] - length + 1, -1)
    valid = np.cumsum(edge[: len(at)]) > 0
    begin = valid.copy()
    begin[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    s = np.flatnonzero(begin)
    stop = valid.copy()
    stop[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    count = np.flatnonzero(stop) - s + 1
    text = np.searchsorted(first, s, side="right") - 1
    return text, h[at[s]], common.span_hash(prefix, s, s + count - 1 + length), s, count, at[s]


def byte_parts(data: np.ndarray, off: np.ndarray, length: int, size: int = common.PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place in that row's text): all texts in parts; a longer text comes in several, each
    with the ``length`` - 1 bytes that its last windows need."""
    for lo, hi in common.pieces(off, size):
        if off[hi] - off[lo] <= 2 * size:
            yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], 0
        else:
            for a in range(int(off[lo]), int(off[hi]), size):
                b = min(int(off[hi]), a + size + length - 1)
                if b - a >= length or a == off[lo]:
                    yield lo, data[a:b], np.array([0, b - a]), a - int(off[lo])


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal ones, in order."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return starts[at], np.maximum.reduceat(stops[order], at)
