"""Operator 7: edit-aware token counts with a segment tree of pre-tokens for each document."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of byte-level BPE; no look-behind, and one character of look-ahead at most.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, CACHE = 64, 400_000
EDITS = "array<struct<start:int,stop:int,text:string>>"


class Counter(dict):
    """Tokens of a pre-token; forgets everything when it grows beyond CACHE."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        super().__init__()
        self.split = regex.compile(pattern)
        self.one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = len(self.one(piece.encode("utf-8", "replace")))
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenTree:
    """Lengths and token counts of a text's pre-tokens in leaves of about LEAF, with sums up a binary tree."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter, self.reencoded = text, counter, 0
        pieces = counter.split.findall(text)
        self.build(list(map(len, pieces)), [counter[p] for p in pieces])

    def build(self, lengths: list[int], counts: list[int]) -> None:
        self.lengths = [lengths[i : i + LEAF] for i in range(0, len(lengths), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(counts), LEAF)] or [[]]
        self.width = 1 << (len(self.lengths) - 1).bit_length()
        pad = [0] * (self.width - len(self.lengths))
        self.chars = [0] * self.width + [sum(x) for x in self.lengths] + pad
        self.tokens = [0] * self.width + [sum(x) for x in self.counts] + pad
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at ``at`` (the last one at the end), and where it begins."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if at - begin >= self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return i - self.width, begin

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces the characters [start, stop), clipped to the text; re-encodes from the last pre-token that ends
        before the edit's left neighbour to the first place where old and new pre-tokens begin together again."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        leaf, begin = self.leaf_at(max(0, start - 1))
        keep = 0
        while keep < len(self.lengths[leaf]) and begin + self.lengths[leaf][keep] <= start - 1:
            begin += self.lengths[leaf][keep]
            keep += 1
        self.text = self.text[:start] + new + self.text[stop:]
        shift, grown, n = len(new) - (stop - start), start + len(new), len(self.text)
        last, end_keep, old = leaf, keep, begin  # the next old pre-token and where it begins, in old characters
        reach, lengths, counts, at = min(n, grown + 64), [], [], begin
        synced = False
        while not synced and at < n:
            for m in self.counter.split.finditer(self.text, at, reach):
                if m.end() == reach and reach < n:
                    break
                lengths.append(m.end() - at)
                counts.append(self.counter[m[0]])
                at = m.end()
                if at >= grown:
                    while last < len(self.lengths) and old + shift < at:
                        if end_keep < len(self.lengths[last]):
                            old += self.lengths[last][end_keep]
                            end_keep += 1
                        else:
                            last, end_keep = last + 1, 0
                    if old + shift == at and old >= stop:
                        synced = True
                        break
            reach = min(n, reach + (reach - at) + 256)
        if not synced:
            last, end_keep = len(self.lengths) - 1, len(self.lengths[-1])
        if last >= len(self.lengths):
            last, end_keep = len(self.lengths) - 1, len(self.lengths[-1])
        self.reencoded += len(lengths)
        tail_l, tail_c = self.lengths[last][end_keep:], self.counts[last][end_keep:]
        self.lengths[leaf][keep:], self.counts[leaf][keep:] = lengths, counts
        if last == leaf:
            self.lengths[leaf] += tail_l
            self.counts[leaf] += tail_c
        else:
            self.lengths[last], self.counts[last] = tail_l, tail_c
            for k in range(leaf + 1, last):
                self.lengths[k], self.counts[k] = [], []
        if len(self.lengths[leaf]) > 4 * LEAF:
            self.build([x for b in self.lengths for x in b], [x for b in self.counts for x in b])
        else:
            for k in range(leaf, last + 1):
                self.update(k)

    def update(self, leaf: int) -> None:
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(self.lengths[leaf]), sum(self.counts[leaf])
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_pretokens, n_reencoded) of every row, over its whole text.

    ``edits_col``: array of (start, stop, text), done in order, each on the text as it is then, in characters;
    places are clipped to the text, null edits skipped, null places 0 and null texts empty. n_reencoded counts
    pre-tokens encoded again because of edits. Null text counts as empty (0 tokens). The vocabulary (some 50,000
    ranks, read by the driver) goes out with the job. Rows that repeat give rows each; null ids are kept; other
    columns are ignored. No rows: no rows.
    """
    ranks = load(vocabulary)
    edits = F.col(edits_col).cast(EDITS) if edits_col else F.lit(None).cast(EDITS)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), edits.alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for b in batches:
            out: list[list[int]] = [[], [], [], []]
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                for text, todo in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    tree = TokenTree(text or "", counter)
                    out[0].append(tree.total)
                    out[2].append(sum(map(len, tree.lengths)))
                    for e in todo or ():
                        if e:
                            tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                    out[1].append(tree.total)
                    out[3].append(tree.reencoded)
            yield pa.record_batch([b.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["doc_id", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded"])

    return chosen.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long")


def sample_edits(text: Column, seed: Column) -> Column:
    """Three edits set by a hash of ``seed``: an insertion, a deletion and a replacement, anywhere in the text."""
    n = F.coalesce(F.length(text), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64(seed, F.lit(k)), F.greatest(n, F.lit(1)).cast("long")).cast("int")
    one = lambda lo, hi, new: F.struct(lo.alias("start"), hi.alias("stop"), F.lit(new).alias("text"))
    return F.array(one(place(1), place(1), " an inserted remark, 2 of 3"), one(place(2), place(2) + 40, ""), one(place(3), place(3) + 12, "re-written\n"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs.withColumn("edits", sample_edits(F.col("text"), F.col("doc_id"))), edits_col="edits")


