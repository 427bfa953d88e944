"""Operator 1: language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows that the model is fitted on, over all languages: a bound, not a share; with more than SAMPLE / LEAST languages it is
#: LEAST a language, so none is left out. More than LANGUAGES different labels are an error, no table of languages.
SAMPLE, LEAST, LANGUAGES = 2400, 20, 8192
BITS, DIM, ORDERS = 16, 16, (2, 3, 4)
#: Share of right answers on calibration rows that rejection may cost. The probability's threshold lies between that of pure
#: chance (one over the languages) and 1 and goes up to HIGHEST of the way at most.
LOSS, HIGHEST = 0.001, 0.1
#: A text may have SLACK times the share of unseen subwords that the calibration rows' LOSS quantile has (FLOOR at least), each
#: text counting PRIOR seen ones beside its own, so that one new word doesn't reject a short text.
SLACK, FLOOR, PRIOR = 4, 0.01, 256
UNKNOWN = "und"

_LETTERS = np.full(256, 32, np.uint32)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order n the hashed byte n-grams at each position, and which of them count.

    Only letters are seen (ASCII ones in lower case, every non-ASCII byte); the rest is white space. A subword
    may begin or end with white space but doesn't reach over it, nor over a text's end.
    """
    x = _LETTERS[data]
    for n in ORDERS:
        m = len(x) - n + 1
        if m < 1:
            continue
        code = x[:m].copy()
        for j in range(1, n):
            code |= x[j : j + m] << np.uint32(8 * j)
        code = (code + np.uint32(n)) * np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        code = (code * np.uint32(2246822519)) >> np.uint32(32 - BITS)
        ok = np.ones(m, bool)
        for j in range(1, n - 1):
            ok &= x[j : j + m] != 32
        if n == 2:
            ok &= (x[:m] != 32) | (x[1 : 1 + m] != 32)
        for j in range(1, n):
            at = off[1:] - j
            at = at[(at >= 0) & (at < m)]
            ok[at] = False
        yield code, ok


@dataclass
class Model:
    """table: for each hashed subword its embedding (``out``: softmax weights), or where that is narrower the two multiplied
    (no ``out``), so a text needs one look-up a subword. seen: the subwords of the training rows."""

    langs: list[str]
    table: np.ndarray
    out: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray
    covered: float

    def sums(self, data: np.ndarray, off: np.ndarray, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's summed table rows, number of subwords and number of seen ones; of subwords that start before ``upto``."""
        n = len(off) - 1
        total, count, known = np.zeros((n, self.table.shape[1])), np.zeros(n), np.zeros(n)
        for code, ok in subwords(data, off):
            at = np.flatnonzero(ok[:upto])
            row = np.searchsorted(at, off)
            code = code[at]
            sums = np.zeros((len(at) + 1, self.table.shape[1]))
            np.cumsum(self.table[code], axis=0, dtype=np.float64, out=sums[1:])
            total += sums[row[1:]] - sums[row[:-1]]
            count += row[1:] - row[:-1]
            had = np.concatenate([[0], np.cumsum(self.seen[code])])
            known += had[row[1:]] - had[row[:-1]]
        return total, count, known

    def judge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each text's languages, and its share of seen subwords. One long text is looked at in parts."""
        size = common.PIECE // 2
        if len(off) == 2 and len(data) > 2 * size:
            parts = [self.sums(part, np.array([0, len(part)]), size) for part in (data[a : a + size + max(ORDERS) - 1] for a in range(0, len(data), size))]
            total, count, known = (sum(x) for x in zip(*parts, strict=True))
        else:
            total, count, known = self.sums(data, off)
        mean = total / np.maximum(count, 1)[:, None]
        return softmax(((mean if self.out is None else mean @ self.out) + self.bias) / self.temperature), (known + PRIOR) / (count + PRIOR)

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.judge(data, off)[0]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], calibrate: list[bool], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, text by text; temperature and threshold come from the calibration rows."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels], np.int64)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-0.1, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    train = [i for i in range(len(y)) if not calibrate[i]] or list(range(len(y)))
    weights = [(c / max(c.sum(), 1)).astype(np.float32) for _, c in features]
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, w = features[i][0], weights[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            if not len(ids):
                continue
            h = w @ emb[ids]
            g = softmax(h @ out + bias)
            g[y[i]] -= 1
            back = out @ g
            out -= lr * np.outer(h, g)
            bias -= lr * np.float32(0.1) * g
            emb[ids] -= (lr * len(ids) ** 0.5) * w[:, None] * back
    seen = np.zeros(1 << BITS, bool)
    for i in train:
        seen[features[i][0]] = True
    narrow = len(langs) <= DIM
    table = emb @ out
    held = [i for i in range(len(y)) if calibrate[i]] or train
    z = np.array([weights[i] @ table[features[i][0]] + bias for i in held])
    scales = np.geomspace(0.02, 20, 80)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in scales]
    best = float(scales[int(np.argmin(loss))])
    p = softmax(z / best)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[held]])
    chance = 1 / len(langs)
    threshold = min(chance + HIGHEST * (1 - chance), float(right[int(LOSS * len(right))]) * 0.999) if len(right) else 0.0
    unseen = [1 - (features[i][1][seen[features[i][0]]].sum() + PRIOR) / (features[i][1].sum() + PRIOR) for i in held]
    covered = 1 - min(1.0, SLACK * max(FLOOR, float(np.quantile(unseen, 1 - LOSS))))
    return Model(langs, (table if narrow else emb).astype(np.float32), None if narrow else out, bias, best, threshold, seen, covered)


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from at most about ``sample`` labelled rows of the folds 0, 1 and 3, as many of each language and of each about
    LEAST where there are so many; None if there are none.

    The rows are those whose hash lies below a threshold set by each language's count, so reruns agree; of rows that
    repeat id and text one counts. Rows with null text or label are left out, other columns ignored. Only their subword counts
    (bounded, whatever the text's length) come to the driver. All labels are learned; more than LANGUAGES of them
    raise a ValueError.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(fold(F.col("id")) != 2).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different labels")
    each = max(LEAST, sample // len(counts))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))))[F.col("lang")]
    unit = (F.xxhash64("id", "text", F.lit(11)) / F.lit(2.0**64)) + 0.5
    picked = rows.where(unit < share).select("lang", (F.xxhash64("id", F.lit(5)) % 5 == 0).alias("calibrate"), "text")
    picked = picked.withColumn("same", F.xxhash64("text")).dropDuplicates(["lang", "calibrate", "same"]).drop("same")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = common.to_binary(b.column(2))
            ids, ns = [], []
            for lo, hi in zip(off[:-1], off[1:], strict=True):
                seen = np.zeros(1 << BITS, np.int64)
                for a in range(lo, hi, common.PIECE):
                    part = data[a : min(hi, a + common.PIECE + max(ORDERS) - 1)]
                    for code, ok in subwords(part, np.array([0, len(part)])):
                        seen += np.bincount(code[ok], minlength=1 << BITS)
                at = np.flatnonzero(seen)
                ids.append(at.astype(np.uint16).tobytes())
                ns.append(seen[at].astype(np.float32).tobytes())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(ns, pa.binary())], names=["lang", "calibrate", "ids", "ns"])

    got = sorted(picked.mapInArrow(count, "lang string, calibrate boolean, ids binary, ns binary").collect(), key=lambda r: (r["lang"], r["calibrate"], bytes(r["ids"]), bytes(r["ns"])))
    if not got:
        return None
    return fit([(np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["ns"], np.float32)) for r in got], [r["lang"] for r in got], [r["calibrate"] for r in got])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, from the whole text alone.

    ``und`` with score 0 and rejected: null text, no letter (Unicode L), or no model. Else the likeliest learned
    language and its calibrated probability; rejected if that lies under the model's threshold, or if more of the
    text's subwords are new to the model than the calibration rows let expect (``covered``: another language, or
    no language). A long text is looked at in parts, so memory is bounded. Repeated rows give repeated rows; a null id is kept. Other columns are ignored.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 2).alias("held_out"), F.col(text_col).alias("text"), lettered(text_col).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = answers(model, b.column(2), b.column(3))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def lettered(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def answers(model: Model | None, texts: pa.Array, has_letter: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    data, off = common.to_binary(texts)
    letters = has_letter.to_numpy(zero_copy_only=False).astype(bool)
    lang, score, rejected = [UNKNOWN] * len(letters), np.zeros(len(letters)), np.ones(len(letters), bool)
    for lo, hi in common.pieces(off, common.PIECE // 2) if model else ():
        p, seen = model.judge(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        best = p.argmax(axis=1)
        for k in np.flatnonzero(letters[lo:hi]):
            lang[lo + k] = model.langs[best[k]]
            score[lo + k] = p[k, best[k]]
            rejected[lo + k] = score[lo + k] < model.threshold or seen[k] < model.covered
    return lang, score, rejected


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Rows whose language isn't rejected (see predict); columns as they are. Without a model nothing can be judged and all
    stay. Null texts and texts without a letter go; rows that repeat stay or go together; no rows: no rows."""
    if model is None:
        return docs
    return common.filtered(docs, lambda x: ~answers(model, x[0], x[1])[2], F.col(text_col).cast("string"), lettered(text_col))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
