"""Operator 6: benchmark decontamination by a BM25 index of test items and block-max WAND."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, OVERLAP, K1, B, BLOCK = 5, 0.8, 1.2, 0.75, 16
#: Bytes of item texts in one index; more items go into further indexes, each of which all documents meet.
INDEX_BYTES = 8 << 20
#: Of an item's rarest terms so many more than may be missing are looked at; as many must be there.
SURPLUS = 3

_NORM = np.full(256, 32, np.uint8)
_NORM[128:] = np.arange(128, 256)
_NORM[48:58] = np.arange(48, 58)
_NORM[97:123] = _NORM[65:91] = np.arange(97, 123)


def normal(data: np.ndarray) -> np.ndarray:
    """Letters and digits, in lower case for ASCII and the Latin-1 letters; every other ASCII byte is a space."""
    x = _NORM[data]
    second = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) + 1
    x[second] += 0x20
    return x


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and each text's first word (n + 1 values)."""
    if len(off) == 2 and len(data) > common.PIECE:
        words = np.concatenate(list(common.word_chunks(data, normal)))
        return words, np.array([0, len(words)])
    x = normal(data)
    starts, stops, first = common.word_spans(x, off)
    return common.span_hash(common.prefix_hash(common.byte_values(x)), starts, stops), first


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of n consecutive words; of fewer words the whole sequence, of none nothing."""
    if not len(words):
        return words
    p = common.prefix_hash(words)
    lo = np.arange(max(1, len(words) - n + 1))
    return np.unique(common.span_hash(p, lo, np.minimum(lo + n, len(words))))


class Index:
    """Postings of the items' terms in blocks of items, with each block's largest weight.

    Weights are BM25 contributions over the item's own threshold, so an item is retrieved when they sum to 1.
    The threshold is the least score that a passage with ``overlap`` of the item's shingles can have: of s
    shingles at most m = floor((1 - overlap) * s) are missing, hence at most m words, at worst the heaviest.
    """

    def __init__(self, items: list[tuple[int, str, str | None]], overlap: float = OVERLAP, stride: int = SHINGLE) -> None:
        """stride: at least as many words as the longest item of all indexes has; that of these items if it is larger."""
        self.overlap = overlap
        self.ids: list[int] = []
        self.question: list[tuple[np.ndarray, int]] = []  # shingles and their length
        self.answer: list[tuple[np.ndarray, int]] = []
        words: list[np.ndarray] = []
        for item, text, answer in items:
            w = self.hashes(text)
            if len(w):
                self.ids.append(item)
                words.append(w)
                self.question.append((shingles(w), min(SHINGLE, len(w))))
                a = self.hashes(answer or "")
                self.answer.append((shingles(a), min(SHINGLE, max(1, len(a)))))
        n = len(words)
        self.stride = max([SHINGLE, stride, *map(len, words)])
        df: dict[int, int] = defaultdict(int)
        for w in words:
            for t in set(w.tolist()):
                df[t] += 1
        average = sum(map(len, words)) / max(n, 1)
        self.postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.essential: dict[int, list[int]] = defaultdict(list)
        self.needed = np.ones(n, np.int64)
        for i, w in enumerate(words):
            terms, tf = np.unique(w, return_counts=True)
            idf = np.array([np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / average))
            heavy = np.argsort(-weight, kind="stable")
            lost = int((1 - overlap) * len(self.question[i][0]) + 1e-9)
            threshold = max(weight.sum() - weight[heavy[:lost]].sum(), 1e-9)
            for t, x in zip(terms.tolist(), (weight / threshold).tolist(), strict=True):
                self.postings[t].append((i, x))
            some = heavy[: lost + SURPLUS]
            self.needed[i] = max(1, len(some) - lost)
            for t in terms[some].tolist():
                self.essential[t].append(i)
        self.blocks = {t: [(p[k][0], p[min(k + BLOCK, len(p)) - 1][0], max(x for _, x in p[k : k + BLOCK])) for k in range(0, len(p), BLOCK)] for t, p in self.postings.items()}
        self.most = {t: max(x for _, x in p) for t, p in self.postings.items()}
        self.rare = np.array(sorted(self.essential), np.uint64)
        lists = [self.essential[t] for t in self.rare.tolist()]
        self.rare_at = np.cumsum([0, *map(len, lists)])
        self.rare_items = np.array([i for x in lists for i in x], np.int64)

    @staticmethod
    def hashes(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return words_of(data, np.array([0, len(data)]))[0]

    def wand(self, terms: list[int]) -> list[int]:
        """Items whose weights over the passage's distinct terms reach 1: block-max WAND, an item at a time."""
        lists = [t for t in terms if t in self.postings]
        at = dict.fromkeys(lists, 0)
        found, near = [], 1 - 1e-9
        while lists:
            lists.sort(key=lambda t: self.postings[t][at[t]][0])
            total, pivot = 0.0, -1
            for k, t in enumerate(lists):
                total += self.most[t]
                if total >= near:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.postings[lists[pivot]][at[lists[pivot]]][0]
            while pivot + 1 < len(lists) and self.postings[lists[pivot + 1]][at[lists[pivot + 1]]][0] == item:
                pivot += 1
            bound, last = 0.0, len(self.ids)
            for t in lists[: pivot + 1]:
                blocks, k = self.blocks[t], at[t] // BLOCK
                while k < len(blocks) and blocks[k][1] < item:
                    k += 1
                if k < len(blocks):
                    if blocks[k][0] <= item:
                        bound += blocks[k][2]
                        last = min(last, blocks[k][1] + 1)
                    else:
                        last = min(last, blocks[k][0])
            if bound >= near:
                if self.postings[lists[0]][at[lists[0]]][0] == item:
                    here = [t for t in lists if self.postings[t][at[t]][0] == item]
                    if sum(self.postings[t][at[t]][1] for t in here) >= near:
                        found.append(item)
                    target, move = item + 1, here
                else:
                    target, move = item, [t for t in lists[:pivot] if self.postings[t][at[t]][0] < item]
            else:  # no item in these blocks can reach it
                if pivot + 1 < len(lists):
                    last = min(last, self.postings[lists[pivot + 1]][at[lists[pivot + 1]]][0])
                target, move = max(item + 1, last), lists[: pivot + 1]
            for t in move:
                p, k = self.postings[t], at[t]
                while k < len(p) and p[k][0] < target:
                    k += 1
                at[t] = k
            lists = [t for t in lists if at[t] < len(self.postings[t])]
        return found

    def verify(self, item: int, passage: np.ndarray, whole: np.ndarray) -> float:
        """Share of the question's shingles in the passage, if the answer's (where it has one) are in the text as well; else 0."""
        question, n = self.question[item]
        got = np.isin(question, shingles(passage, n)).mean()
        if got < self.overlap - 1e-9:
            return 0.0
        answer, n = self.answer[item]
        if len(answer) and np.isin(answer, shingles(whole, n)).mean() < self.overlap - 1e-9:
            return 0.0
        return float(got)

    def passages(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(text, passage) that hold enough of an item's rarest terms. Passage p is the words [p, p + 2) * stride."""
        if not len(self.rare) or not len(words):
            return []
        k = np.minimum(np.searchsorted(self.rare, words), len(self.rare) - 1)
        hit = np.flatnonzero(self.rare[k] == words)
        if not len(hit):
            return []
        k = k[hit]
        text = np.searchsorted(first, hit, side="right") - 1
        passage = (hit - first[text]) // self.stride
        n = self.rare_at[k + 1] - self.rare_at[k]
        items = self.rare_items[np.repeat(self.rare_at[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        rows = np.stack([np.repeat(text, n), np.repeat(passage, n), items, np.repeat(k, n)], axis=1)
        earlier = rows[rows[:, 1] > 0] - np.array([0, 1, 0, 0])
        rows = np.unique(np.concatenate([rows, earlier]), axis=0)
        groups, counts = np.unique(rows[:, :3], axis=0, return_counts=True)
        good = groups[counts >= self.needed[groups[:, 2]]]
        return [tuple(x) for x in np.unique(good[:, :2], axis=0).tolist()]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, overlap): one row for each document and item that it holds.

    A document holds an item if some passage of it (2 * stride words, from every stride-th word on; stride is
    the longest item's length in words, of all items, whatever index they are in) has ``overlap`` of the item's distinct
    5-word shingles; words are runs of letters and digits, case ignored. An item of fewer words is one shingle; an
    item without words is never held. Where there is an answer, the same share of its shingles must be in the
    document. Every passage is looked at.

    Items are put into indexes of ``index_bytes`` of text at most (one larger item stands alone), and the documents
    meet one index after the other, each writing its rows before the next is built, so driver and executors hold one.
    Null texts hold nothing; null item ids are dropped, null document ids kept. Repeated documents give repeated
    rows, repeated items one row each. Other columns are ignored. Empty tables give no rows.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index, alone in indexes(items, item_col, question_col, answer_col, overlap, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = held(index, b.column(1))
                row, item, share = ([x[k] for x in found] for k in range(3))
                yield pa.record_batch([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "overlap"])

        found = chosen.mapInArrow(run, "doc_id long, item_id long, overlap double")
        if not alone:
            found = common.written(found, "matches")
        out = found if out is None else out.union(found)
    return out


def longest(listed: DataFrame) -> int:
    """Words of the longest item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = common.to_binary(b.column(0))
            for lo, hi in common.pieces(off):
                _, first = words_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.record_batch([pa.array([int(np.diff(first).max(initial=0))])], names=["n"])

    return listed.select("q").mapInArrow(run, "n long").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def indexes(items: DataFrame, item_col: str, question_col: str, answer_col: str | None, overlap: float, index_bytes: int) -> Iterator[tuple[Index, bool]]:
    """One index after the other, each of at most about ``index_bytes`` of text, and whether it is the only one; the
    first comes even if there is no item."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    listed = items.where(F.col(item_col).isNotNull() & F.col(question_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(question_col).cast("string").alias("q"), answer.alias("a")).distinct()
    size = listed.agg(F.coalesce(F.sum(F.octet_length("q") + F.coalesce(F.octet_length("a"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-2 * size // index_bytes)) if size > index_bytes else 1
    stride = longest(listed) if parts > 1 else SHINGLE
    for part in range(parts):
        mine = listed if parts == 1 else listed.where(F.pmod(F.xxhash64("i", "q", "a"), F.lit(parts)) == part)
        yield Index(sorted(((r["i"], r["q"], r["a"]) for r in mine.collect()), key=lambda r: (r[0], r[1], r[2] or "")), overlap, stride), parts == 1


def held(index: Index, texts: pa.Array) -> list[tuple[int, int, float]]:
    """(row, item id, overlap) of the items that each text holds; the largest overlap of an id's."""
    data, off = common.to_binary(texts)
    out: list[tuple[int, int, float]] = []
    for lo, hi in common.pieces(off):
        words, first = words_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        best: dict[tuple[int, int], float] = {}
        for text, p in index.passages(words, first):
            whole = words[first[text] : first[text + 1]]
            passage = whole[p * index.stride : (p + 2) * index.stride]
            for i in index.wand(np.unique(passage).tolist()):
                got = index.verify(i, passage, whole)
                if got:
                    at = text, index.ids[i]
                    best[at] = max(best.get(at, 0.0), got)
        out += [(lo + text, item, got) for (text, item), got in sorted(best.items())]
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Rows that hold no item (see matches); columns as they are. Null texts stay, as do all rows if there is no item;
    rows that repeat stay or go together."""
    text = F.col(text_col).cast("string")
    index, alone = next(indexes(items, item_col, question_col, answer_col, overlap, index_bytes))
    if alone:

        def clean(x: list[pa.Array]) -> np.ndarray:
            keep = np.ones(len(x[0]), bool)
            keep[[row for row, _, _ in held(index, x[0])]] = False
            return keep

        return common.filtered(docs, clean, text)
    del index
    tid = common.unused(docs, "tid")
    keyed = docs.withColumn(tid, F.xxhash64(text))
    found = matches(keyed.select(tid, text.alias("text")), items, tid, "text", item_col, question_col, answer_col, overlap, index_bytes)
    return keyed.join(found.select(F.col("doc_id").alias(tid)).distinct(), tid, "left_anti").drop(tid)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = common.table(spark, sf_dir, "benchmark")
    return matches(common.table(spark, sf_dir, "documents"), items, answer_col="answer" if "answer" in items.columns else None)
