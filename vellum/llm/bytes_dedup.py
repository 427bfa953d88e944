"""Operator 3: repeated byte strings by column-wise construction of a collection's transform and common prefixes.

Column-wise construction takes as many rounds as its longest text has symbols, and each round rewrites all that went
before, so it isn't done on whole texts but on the short strings that are in question: around each anchor (runs.py)
where a repeat ends, the bytes that the windows of one run cover, its anchor replaced by a short code.
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
from .columnwise import repeated_starts
from .repeats import within
from .runs import byte_parts, merged, runs

LENGTH, GRAM = 200, 120
#: Bytes of strings from which on a construction begins; one more anchor's (repeats.HOT_ANCHOR strings) is all it can have.
COLLECTION = 1 << 21
#: Bytes that UTF-8 never has, as digits of an anchor's number.
DIGITS = np.array([0xC0, 0xC1, *range(0xF5, 0xFD)], np.uint8)


def cut_bytes(length: int, gram: int):
    def cut(data: np.ndarray, off: np.ndarray) -> Iterator[repeats.Part]:
        for row, part, first, place in byte_parts(data, off, length):
            text, v, rh, s, n, a = runs(common.prefix_hash(common.byte_values(part)), first, length, gram)
            yield text + row, v, rh, s - first[text] + place, n, a - first[text] + place

    return cut


def collection(table: pa.Table, length: int, gram: int) -> pa.RecordBatch | None:
    """Spans of those strings (CHECK) whose windows start again in another string of their anchor."""
    v = table["v"].to_numpy()
    number = np.cumsum(np.concatenate([[False], v[1:] != v[:-1]]))
    digits = max(1, len(str(int(number[-1]))))
    code = DIGITS[(number[:, None] // 10 ** np.arange(digits)) % 10]
    kinds, rid, s, n = (table[x].to_numpy() for x in ("kind", "rid", "s", "n"))
    parts = [x for left, c, right in zip(table["lead"].to_pylist(), code, table["tail"].to_pylist(), strict=True) for x in (left, c.tobytes(), right)]
    sizes = np.array(list(map(len, parts))).reshape(-1, 3).sum(axis=1)
    off = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(parts), np.uint8)
    hit = repeated_starts(data, off, length - gram + digits)
    check = np.flatnonzero(kinds == repeats.CHECK)
    at = np.repeat(off[check], n[check]) + within(n[check])
    owner = np.repeat(check, n[check])
    good = hit[at]
    begins = good & ~np.concatenate([[False], good[:-1] & (owner[1:] == owner[:-1])])
    stops = good & ~np.concatenate([good[1:] & (owner[1:] == owner[:-1]), [False]])
    b, e = np.flatnonzero(begins), np.flatnonzero(stops)
    if not len(b):
        return None
    begin = s[owner[b]] + at[b] - off[owner[b]]
    return pa.record_batch([pa.array(rid[owner[b]]), pa.array(begin.astype(np.int32)), pa.array((begin + e - b + length).astype(np.int32))], names=["rid", "b", "e"])


#: Strings to look at (c = -1), dealt by anchor; or hot windows (repeats.one_a_window), dealt by v = their key.
ASKED = "rid long, v long, s int, n int, kind int, lead binary, tail binary, anchor long, c int"


def asked_rows(rid, v, s, n, kind, lead, tail, anchor, c) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rid), pa.array(v), *(pa.array(x.astype(np.int32)) for x in (s, n, kind)), pa.array(lead, pa.binary()), pa.array(tail, pa.binary()), pa.array(anchor), pa.array(c.astype(np.int32))], names=["rid", "v", "s", "n", "kind", "lead", "tail", "anchor", "c"])


def hot_windows(held: list[bytes], rid: np.ndarray, v: np.ndarray, s: np.ndarray, n: np.ndarray, kind: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """ASKED rows of the windows of hot runs, whose bytes are in ``held``."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in held])])[:-1]
    p = common.prefix_hash(common.byte_values(np.frombuffer(b"".join(held), np.uint8)))
    n = n.astype(np.int64)
    each = np.repeat(first, n) + within(n)
    c = np.where(kind == repeats.HOT_PARTNER, 2, 1)
    key, v, _, rid, s, c = repeats.one_a_window(common.span_hash(p, each, each + length), np.repeat(v, n), np.zeros(len(each), np.int64), np.repeat(rid, n), np.repeat(s, n) + within(n), np.repeat(c, n), smaller=False)
    nought = np.zeros(len(key), np.int64)
    for lo in range(0, len(key), 1 << 16):
        x = slice(lo, lo + (1 << 16))
        none = [None] * len(key[x])
        yield asked_rows(rid[x], key[x], s[x], nought[x], nought[x], none, none, v[x], c[x])


def spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts (rid, k, text) and spans (rid, b, e) of bytes that a repeated string of ``length`` bytes covers."""
    gram = gram or max(1, length * GRAM // LENGTH)
    texts = docs
    found = common.written(repeats.fates(repeats.run_rows(texts, cut_bytes(length, gram), smaller=False), smaller=False), "fates")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, (v, s, n, a, kind) = repeats.lists(b.column(1), ["v", "s", "n", "a", "kind"])
            rid = np.repeat(b.column(0).to_numpy(), np.diff(off))
            lead, tail, cold, hot, held, hot_bytes = [], [], [], [], [], 0
            for k, text in enumerate(b.column(2)):
                raw = text.as_buffer()
                for i in range(off[k], off[k + 1]):
                    if kind[i] >= repeats.HOT:
                        held.append(raw[s[i] : s[i] + n[i] - 1 + length].to_pybytes())
                        hot.append(i)
                        hot_bytes += len(held[-1])
                    else:
                        lead.append(raw[s[i] : a[i]].to_pybytes())
                        tail.append(raw[a[i] + gram : s[i] + n[i] - 1 + length].to_pybytes())
                        cold.append(i)
                if hot_bytes > 4 * common.PIECE:
                    yield from hot_windows(held, *(x[hot] for x in (rid, v, s, n, kind)), length)
                    hot, held, hot_bytes = [], [], 0
            if held:
                yield from hot_windows(held, *(x[hot] for x in (rid, v, s, n, kind)), length)
            for lo in range(0, len(lead), 8192):
                y, x = cold[lo : lo + 8192], slice(lo, lo + 8192)
                yield asked_rows(rid[y], v[y], s[y], n[y], kind[y], lead[x], tail[x], v[y], np.full(len(y), -1))

    def work(t: pa.Table) -> pa.RecordBatch | None:
        hot, cold = t.filter(pc.greater_equal(t["c"], 0)), t.filter(pc.less(t["c"], 0)).combine_chunks()
        found = [collection(cold, length, gram)] if cold.num_rows else []
        if hot.num_rows:
            found.append(repeats.met(*(hot[x].to_numpy() for x in ("v", "anchor")), np.zeros(hot.num_rows, np.int64), *(hot[x].to_numpy() for x in ("rid", "s", "c")), length=length, smaller=False))
        found = [x for x in found if x is not None]
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return repeats.whole_groups(batches, work, least=COLLECTION)

    asked = repeats.per_text(texts, found.where(F.col("kind") >= repeats.CHECK), ["v", "s", "n", "a", "kind"], "inner").select("rid", "found", "text").mapInArrow(strings, ASKED)
    edges = asked.repartition("v").sortWithinPartitions("v").mapInArrow(build, "rid long, b int, e int")
    return texts, found.where(F.col("kind") == repeats.SPAN).select("rid", F.col("s").alias("b"), (F.col("s") + F.col("n") + length - 1).alias("e")).union(edges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or
    another; strings never reach over texts, and are judged on the input. ``kept`` is what is left (bytes: cuts may
    fall inside a character), ``spans`` the maximal removed runs. Null text counts as empty. Texts shorter than
    ``length`` stay. Rows that repeat are texts of their own, so both lose what they share. Null ids are kept. Other
    columns are ignored. No rows: no rows.
    """
    texts, found = spans(repeats.identified(docs, id_col, text_col), length)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, (begin, end) = repeats.lists(b.column(2), ["b", "e"])
            size, gone, count, digest, kept, cut = [], [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                raw = text.as_py()
                x, y = merged(begin[off[k] : off[k + 1]].astype(np.int64), end[off[k] : off[k + 1]].astype(np.int64))
                edges = [0, *np.stack([x, y], axis=1).reshape(-1).tolist(), len(raw)]
                left = b"".join(raw[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True))
                size.append(len(raw))
                gone.append(len(raw) - len(left))
                count.append(len(x))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
                cut.append([{"b": p, "e": q} for p, q in zip(x.tolist(), y.tolist(), strict=True)])
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()), pa.array(cut, pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())])))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    out = repeats.per_text(texts, found, ["b", "e"], "left").select("k", "text", "found").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<b:int,e:int>>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != common.NO_ID, F.col("doc_id")))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents")).drop("kept", "spans")
