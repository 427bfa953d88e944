"""Operator 4: repeated word sequences by level-wise doubling.

Levels for windows of 50 words: runs of windows whose 13-word anchor repeats; of these, windows whose 26 words from
that anchor on, or up to its end, repeat; of these, windows of all 50. Only what repeats on one level goes to the next,
and the last ends it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats
from .repeats import within
from .runs import merged, runs

WINDOW = 50


def levels(window: int) -> tuple[int, int]:
    """The first two lengths: a quarter and twice that, as long as both fit the window."""
    gram = max(1, -(-window // 4))
    return gram, min(2 * gram, window)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and each text's first word (n + 1 values)."""
    if len(data) > common.PIECE and len(off) == 2:
        words = np.concatenate(list(common.word_chunks(data)))
        return words, np.array([0, len(words)])
    starts, stops, first = common.word_spans(data, off)
    return common.span_hash(common.prefix_hash(common.byte_values(data)), starts, stops), first


def cut_words(window: int):
    gram, _ = levels(window)

    def cut(data: np.ndarray, off: np.ndarray) -> Iterator[repeats.Part]:
        for lo, hi in common.pieces(off):
            part = data[off[lo] : off[hi]]
            if len(part) <= common.PIECE or hi > lo + 1:
                words, first = word_hashes(part, off[lo : hi + 1] - off[lo])
                text, v, rh, s, n, a = runs(common.prefix_hash(words), first, window, gram)
                yield text + lo, v, rh, s - first[text], n, a - first[text]
                continue
            words, done = np.zeros(0, np.uint64), 0  # one long text: each part begins with the words that its first windows need
            for more in common.word_chunks(part):
                words = np.concatenate([words[len(words) - min(len(words), window - 1) :], more])
                done += len(more)
                text, v, rh, s, n, a = runs(common.prefix_hash(words), np.array([0, len(words)]), window, gram)
                yield text + lo, v, rh, s + done - len(words), n, a + done - len(words)

    return cut


def last_levels(t: pa.Table, window: int) -> pa.RecordBatch | None:
    """Spans of windows that also start in a text with a smaller id; t has all runs of its anchors (c < 0)."""
    gram, twice = levels(window)
    t = t.filter(pc.less(t["c"], 0)).combine_chunks()
    if not t.num_rows:
        return None
    rid, k, v, s, n, a, left, right = (t[x].to_numpy() for x in ("rid", "k", "v", "s", "n", "a", "left", "right"))
    again = []
    for half in (left, right):
        order = np.lexsort((half, v))
        new = np.ones(len(v), bool)
        new[1:] = (v[order][1:] != v[order][:-1]) | (half[order][1:] != half[order][:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(v)))
        repeated = np.zeros(len(v), bool)
        repeated[order] = np.repeat(size > 1, size)
        again.append(repeated)
    owner = np.repeat(np.arange(len(v)), n)
    start = s[owner] + within(n)
    lead = a[owner] - start
    ok = (again[0][owner] | (lead < twice - gram)) & (again[1][owner] | (lead + twice > window))
    h = t["windows"].combine_chunks().flatten().to_numpy() if isinstance(t["windows"], pa.ChunkedArray) else t["windows"].flatten().to_numpy()
    live = np.flatnonzero(ok)
    if not len(live):
        return None
    owner, start, h = owner[live], start[live], h[live]
    order = np.lexsort((k[owner], h, v[owner]))
    new = np.ones(len(order), bool)
    new[1:] = (v[owner[order]][1:] != v[owner[order]][:-1]) | (h[order][1:] != h[order][:-1])
    least = k[owner[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
    goes = np.zeros(len(order), bool)
    goes[order] = k[owner[order]] > least
    owner, start = owner[goes], start[goes]
    if not len(owner):
        return None
    joined = (owner[1:] == owner[:-1]) & (start[1:] == start[:-1] + 1)
    b, e = np.flatnonzero(np.concatenate([[True], ~joined])), np.flatnonzero(np.concatenate([~joined, [True]]))
    return pa.record_batch([pa.array(rid[owner[b]]), pa.array(start[b].astype(np.int32)), pa.array((start[e] + window).astype(np.int32))], names=["rid", "b", "e"])


#: Runs to look at (c = -1), dealt by anchor; or hot windows (repeats.one_a_window), dealt by v = their key, ``left`` being their anchor.
ASKED = "rid long, k long, v long, s int, n int, a int, left long, right long, windows array<long>, c int"


def asked_rows(rid, k, v, s, n, a, left, right, offsets, h, c) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), common.unsigned(h))
    return pa.record_batch([pa.array(rid), pa.array(k), pa.array(v), *(pa.array(x.astype(np.int32)) for x in (s, n, a)), common.unsigned(left), common.unsigned(right), lists, pa.array(c.astype(np.int32))], names=["rid", "k", "v", "s", "n", "a", "left", "right", "windows", "c"])


def spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, b, e): words that a window which also starts in a text with a smaller id covers."""
    gram, twice = levels(window)
    found = common.written(repeats.fates(repeats.run_rows(texts, cut_words(window), smaller=True), smaller=True), "fates")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = common.to_binary(b.column(3))
            rids, ks = (b.column(x).to_numpy() for x in (0, 1))
            at, (v, s, n, a, kind) = repeats.lists(b.column(2), ["v", "s", "n", "a", "kind"])
            hot = []
            for lo, hi in common.pieces(off):
                words, first = word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                p = common.prefix_hash(words)
                text = np.repeat(np.arange(lo, hi), np.diff(at[lo : hi + 1]))
                mine = np.arange(at[lo], at[hi])
                for x, t, is_hot in ((mine[kind[mine] < repeats.HOT], text[kind[mine] < repeats.HOT], False), (mine[kind[mine] >= repeats.HOT], text[kind[mine] >= repeats.HOT], True)):
                    base, count = first[t - lo], n[x].astype(np.int64)
                    begin, anchor = base + s[x], base + a[x]
                    each = np.repeat(begin, count) + within(count)
                    h = common.span_hash(p, each, each + window)
                    if is_hot:
                        hot.append((h, np.repeat(v[x], count), np.repeat(ks[t], count), np.repeat(rids[t], count), each - np.repeat(base, count), np.ones(len(h), np.int64)))
                        continue
                    has_left = anchor - (twice - gram) >= begin
                    has_right = anchor + twice <= begin + count - 1 + window
                    l0 = np.where(has_left, anchor - (twice - gram), begin)
                    left = np.where(has_left, common.span_hash(p, l0, np.where(has_left, anchor + gram, begin)), 0)
                    right = np.where(has_right, common.span_hash(p, anchor, np.where(has_right, anchor + twice, anchor)), 0)
                    yield asked_rows(rids[t], ks[t], v[x], s[x], n[x], a[x], left, right, np.concatenate([[0], np.cumsum(count)]), h, np.full(len(x), -1))
            if sum(len(x[0]) for x in hot):
                key, v, k, rid, s, c = repeats.one_a_window(*(np.concatenate(x) for x in zip(*hot, strict=True)), smaller=True)
                nought = np.zeros(len(key), np.int64)
                for lo in range(0, len(key), 1 << 16):
                    x = slice(lo, lo + (1 << 16))
                    yield asked_rows(rid[x], k[x], key[x], s[x], nought[x], nought[x], v[x], nought[x], np.zeros(len(key[x]) + 1, np.int64), np.zeros(0, np.uint64), c[x])

    def work(t: pa.Table) -> pa.RecordBatch | None:
        hot = t.filter(pc.greater_equal(t["c"], 0))
        found = [last_levels(t, window)]
        if hot.num_rows:
            found.append(repeats.met(*(hot[x].to_numpy() for x in ("v", "left", "k", "rid", "s", "c")), length=window, smaller=True))
        found = [x for x in found if x is not None]
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return repeats.whole_groups(batches, work, least=1 << 20)

    asked = repeats.per_text(texts, found.where(F.col("kind") >= repeats.CHECK), ["v", "s", "n", "a", "kind"], "inner").select("rid", "k", "found", "text").mapInArrow(windows, ASKED)
    edges = asked.repartition("v").sortWithinPartitions("v").mapInArrow(walk, "rid long, b int, e int")
    return found.where(F.col("kind") == repeats.SPAN).select("rid", F.col("s").alias("b"), (F.col("s") + F.col("n") + window - 1).alias("e")).union(edges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, spans) of every row.

    A word goes if a window of ``window`` consecutive words that covers it also starts in a row with a smaller id;
    windows are judged on the input. ``kept`` is what is left, joined by single spaces; ``spans`` are in words.
    Null text has no words. Rows that share an id don't count against each other; a null id is the largest. Other
    columns are ignored. No rows: no rows.
    """
    texts = repeats.identified(docs, id_col, text_col)
    found = spans(texts, window)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, (begin, end) = repeats.lists(b.column(2), ["b", "e"])
            size, gone, digest, kept, cut = [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                words = text.as_py().split()
                x, y = merged(begin[off[k] : off[k + 1]].astype(np.int64), end[off[k] : off[k + 1]].astype(np.int64))
                edges = [0, *np.stack([x, y], axis=1).reshape(-1).tolist(), len(words)]
                rest = [w for p, q in zip(edges[::2], edges[1::2], strict=True) for w in words[p:q]]
                left = b" ".join(rest)
                size.append(len(words))
                gone.append(len(words) - len(rest))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
                cut.append([{"b": p, "e": q} for p, q in zip(x.tolist(), y.tolist(), strict=True)])
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cut, pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    out = repeats.per_text(texts, found, ["b", "e"], "left").select("k", "text", "found").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<b:int,e:int>>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != common.NO_ID, F.col("doc_id")))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents")).drop("kept", "spans")
