"""What the operators on repeated bytes (3) and repeated words (4) share: from texts to runs that repeat.

1. Each text is cut into runs of windows (runs.py), in one pass. Equal runs within an Arrow batch are put together
   there, so a passage that a third of all texts share goes on as one row a batch, not one a text.
2. Runs meet by anchor hash, sorted; a task walks them and keeps one anchor's rows at a time. Equal runs decide for all
   their windows at once. Only where an anchor has different runs (where a repeat ends) windows are looked at one by
   one, and there one representative of equal runs is enough.
3. The operator looks at those windows; spans of each text are joined to it.

Hot anchors. An anchor with more than ``HOT_ANCHOR`` different runs (a passage that very many texts share has two, at
its ends) would make its task grow with the input. Its windows meet by their own hash instead (HOT, ``met``), each
Arrow batch sending one row a window. A batch that has more than ``HOT_BATCH`` runs of an anchor sends them there at
once, and tells the anchor's task by a mark, so that task gets a few rows a batch and passes them on as they come.

Texts are known by a 64-bit hash of id and text (``rid``), so rows that repeat an id keep their own spans. Hashes of
64 bits stand for runs, together with their anchor's 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN, CHECK, PARTNER, HOT, HOT_PARTNER = 1, 2, 3, 4, 5
#: Different runs of an anchor from which on its windows meet by their own hashes: in all, and in one Arrow batch.
HOT_ANCHOR, HOT_BATCH = 256, 8
#: Bytes of one anchor's rows that a task holds at most.
HELD = 32 << 20
#: Values of c for rows whose fate is known, and for the mark of a hot anchor.
KNOWN, MARK, IS_HOT, IS_HOT_PARTNER = 0, -1, -2, -3
RUN = "rid long, k long, v long, rh long, s int, n int, a int, c int"
FATE = "rid long, v long, s int, n int, a int, kind int"
Part = tuple[np.ndarray, ...]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, k, text): k is the id as a long (the largest for null), text is bytes (null: empty)."""
    rows = docs.select(common.key(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    return rows.select(F.xxhash64("k", "t").alias("rid"), "k", F.coalesce(F.col("t").cast("binary"), F.lit(b"")).alias("text"))


def run_rows(texts: DataFrame, cut: Callable[[np.ndarray, np.ndarray], Iterator[Part]], smaller: bool) -> DataFrame:
    """RUN rows of all texts. cut gives (row, v, rh, s, n, a) in parts. Of equal runs in a batch one goes on, with their
    count c; the others' fate is known and they go on as spans (v = rid, c = KNOWN). Runs of an anchor that is hot in
    the batch go on for themselves (v = rid, rh = the anchor's hash, c = IS_HOT or IS_HOT_PARTNER), with one MARK.

    smaller: the run of the smallest id goes on and is no span; else any goes on and all are spans.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = common.to_binary(b.column(2))
            parts = list(cut(data, off))
            if not parts:
                continue
            row, v, rh, s, n, a = (np.concatenate(x) for x in zip(*parts, strict=True))
            rid, k = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
            order = np.argsort(v, kind="stable")
            same = v[order][1:] == v[order][:-1]
            several = np.flatnonzero(np.append(same, False) | np.append([False], same))  # most anchors have one run
            among = order[several]
            order[several] = among[np.lexsort((k[among], rh[among], v[among]))]
            row, v, rh, s, n, a, rid, k = (x[order] for x in (row, v, rh, s, n, a, rid, k))
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (rh[1:] != rh[:-1])
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            c = np.diff(np.append(at, len(v)))[group]
            if smaller:
                go = k == k[at][group]
                span = ~go
            else:
                go, span = new, c > 1
            new_v = np.ones(len(v), bool)
            new_v[1:] = v[1:] != v[:-1]
            kinds = np.bincount((np.cumsum(new_v) - 1)[at])[np.cumsum(new_v) - 1]
            hot = kinds > HOT_BATCH
            keep = np.concatenate([np.flatnonzero(go), np.flatnonzero(span), np.flatnonzero(new_v & hot)])
            role = np.repeat([0, 1, 2], [int(go.sum()), int(span.sum()), int((new_v & hot).sum())])
            direct = (role == 0) & hot[keep]
            key = np.where((role == 1) | direct, rid[keep], v[keep].view(np.int64))
            count = np.select([role == 1, role == 2, direct & (c[keep] > 1) & (not smaller), direct], [KNOWN, MARK, IS_HOT_PARTNER, IS_HOT], c[keep])
            rest = np.where(direct, v[keep], rh[keep])
            for lo in range(0, len(keep), 1 << 16):
                x = keep[lo : lo + (1 << 16)]
                y = slice(lo, lo + (1 << 16))
                yield pa.record_batch([pa.array(rid[x]), pa.array(k[x]), pa.array(key[y]), common.unsigned(rest[y]), pa.array(s[x].astype(np.int32)), pa.array(n[x].astype(np.int32)), pa.array(a[x].astype(np.int32)), pa.array(count[y].astype(np.int32))], names=["rid", "k", "v", "rh", "s", "n", "a", "c"])

    return texts.mapInArrow(emit, RUN)


def whole_groups(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch | None], column: str = "v", least: int = 0) -> Iterator[pa.RecordBatch]:
    """Applies work to tables that hold all rows of their keys; rows come sorted by ``column``. At least ``least``
    bytes at once, so small keys share the cost."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.nbytes for x in held) < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table[column].to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            out = work(table.slice(0, last).combine_chunks())
            if out is not None:
                yield out
            held = table.slice(last).to_batches()
    if held:
        out = work(pa.Table.from_batches(held).combine_chunks())
        if out is not None:
            yield out


def fates(runs: DataFrame, smaller: bool) -> DataFrame:
    """FATE rows: SPAN for runs whose windows all go, CHECK for those whose windows must be looked at, PARTNER for those
    that only others are held against; HOT and HOT_PARTNER instead of these two for hot anchors."""

    def work(t: pa.Table, all_hot: bool = False) -> pa.RecordBatch:
        rid, k, v, rh, s, n, a, c = (t[x].to_numpy() for x in ("rid", "k", "v", "rh", "s", "n", "a", "c"))
        kind = np.select([c == KNOWN, c == IS_HOT, c == IS_HOT_PARTNER], [SPAN, HOT, HOT_PARTNER], 0).astype(np.int32)
        anchor_of = np.where(c <= IS_HOT, rh, v)
        live = np.flatnonzero((c > 0) | (c == MARK))
        again, full, hot = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
        if len(live):
            lv = v[live]
            new_v = np.ones(len(live), bool)
            new_v[1:] = lv[1:] != lv[:-1]
            marked = np.logical_or.reduceat(c[live] == MARK, np.flatnonzero(new_v))[np.cumsum(new_v) - 1]
            real = c[live] > 0
            live, lv, marked = live[real], lv[real], marked[real]
        if len(live):
            lrh = rh[live]
            new_v = np.ones(len(live), bool)
            new_v[1:] = lv[1:] != lv[:-1]
            new = new_v.copy()
            new[1:] |= lrh[1:] != lrh[:-1]
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            anchor = np.cumsum(new_v) - 1
            kinds = np.bincount(anchor[at], minlength=int(anchor[-1]) + 1)[anchor]
            heat = marked | (kinds > HOT_ANCHOR) | all_hot
            if smaller:
                first = k[live] == k[live][at][group]
                kind[live] = np.where(first, np.where(heat, HOT, np.where(kinds > 1, CHECK, 0)), SPAN)
            else:
                total = np.add.reduceat(c[live], at)[group]
                kind[live] = np.where((total > 1) & (c[live] == 1), SPAN, 0)
                some = new & ((kinds > 1) | heat)
                again, full, hot = live[some], total[some] > 1, heat[some]  # one of each goes on, beside being a span
        keep = np.flatnonzero(kind)
        columns = [np.concatenate([x[keep], x[again]]) for x in (rid, anchor_of, s, n, a)]
        kinds_out = np.concatenate([kind[keep], np.where(hot, np.where(full, HOT_PARTNER, HOT), np.where(full, PARTNER, CHECK))]).astype(np.int32)
        return pa.record_batch([*(pa.array(x) for x in columns), pa.array(kinds_out)], names=["rid", "v", "s", "n", "a", "kind"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole anchors at once; of one that grows beyond HELD, whole groups of equal runs as they come, all of them hot."""
        held: list[pa.RecordBatch] = []
        flowing = None
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            v = t["v"].to_numpy()
            if flowing is not None:
                mine = int(np.searchsorted(v, flowing, side="right"))
                if mine < t.num_rows:
                    yield work(t.slice(0, mine).combine_chunks(), all_hot=True)
                    t, v, flowing = t.slice(mine), v[mine:], None
            last = int(np.searchsorted(v, v[-1]))
            if flowing is None and last:
                yield work(t.slice(0, last).combine_chunks())
                t, v = t.slice(last), v[last:]
            if t.nbytes > HELD:
                rh = t["rh"].to_numpy()
                last = int(np.flatnonzero(rh == rh[-1])[0])
                if last:
                    yield work(t.slice(0, last).combine_chunks(), all_hot=True)
                    t, flowing = t.slice(last), v[-1]
            held = t.to_batches()
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks(), all_hot=flowing is not None)

    return runs.repartition("v").sortWithinPartitions("v", "rh", "k").mapInArrow(walk, FATE)


def one_a_window(h: np.ndarray, v: np.ndarray, k: np.ndarray, rid: np.ndarray, s: np.ndarray, c: np.ndarray, smaller: bool) -> tuple[np.ndarray, ...]:
    """(key, v, k, rid, s, c) of an Arrow batch's hot windows, which ``met`` takes: of equal ones (hashes h, anchors v) one
    goes on with key h; what the batch decides has c = KNOWN and its rid as key. smaller: the window of the smallest id
    goes on; else any, with c = 2 if there are several."""
    order = np.lexsort((k, v, h))
    h, v, k, rid, s, c = (x[order] for x in (h, v, k, rid, s, c))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    if smaller:
        go = k == k[at][group]
        known, count = ~go, c
    else:
        total = np.add.reduceat(c, at)[group] if len(at) else c
        go, known, count = new, (total > 1) & (c == 1), np.minimum(total, 2)
    x, y = np.flatnonzero(go), np.flatnonzero(known)
    both = np.concatenate([x, y])
    return np.concatenate([h[x].view(np.int64), rid[y]]), v[both], k[both], rid[both], s[both], np.concatenate([count[x], np.full(len(y), KNOWN)])


def met(key: np.ndarray, v: np.ndarray, k: np.ndarray, rid: np.ndarray, s: np.ndarray, c: np.ndarray, length: int, smaller: bool) -> pa.RecordBatch | None:
    """(rid, b, e): spans of the hot windows that also start elsewhere (smaller: in a text with a smaller id); all rows
    of a key come together."""
    goes = c == KNOWN
    live = np.flatnonzero(~goes)
    if len(live):
        order = live[np.lexsort((k[live], v[live], key[live]))]
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (v[order][1:] != v[order][:-1])
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        goes[order] = k[order] > k[order][at][group] if smaller else (np.add.reduceat(c[order], at)[group] > 1) & (c[order] == 1)
    x = np.flatnonzero(goes)
    if not len(x):
        return None
    x = x[np.lexsort((s[x], rid[x]))]
    joined = (rid[x][1:] == rid[x][:-1]) & (s[x][1:] <= s[x][:-1] + length)
    b, e = x[np.concatenate([[True], ~joined])], x[np.concatenate([~joined, [True]])]
    return pa.record_batch([pa.array(rid[b]), pa.array(s[b].astype(np.int32)), pa.array((s[e] + length).astype(np.int32))], names=["rid", "b", "e"])


def within(n: np.ndarray) -> np.ndarray:
    """0 .. n[i] - 1 for each i, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def per_text(texts: DataFrame, rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Texts with the array of their distinct rows (structs of ``columns``) in ``found``: rows that repeat wholly share
    one list, so they don't multiply it."""
    return texts.join(rows.groupBy("rid").agg(F.collect_set(F.struct(*columns)).alias("found")), "rid", how)


def lists(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat columns of an array<struct> column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64) if column.null_count else column.value_lengths().to_numpy()
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), [flat.field(flat.type.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]
