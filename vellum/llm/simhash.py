"""Operator 2: SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .golay import near

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: The 64 bits in three parts: (shift, bits).
PARTS = ((0, 22), (22, 21), (43, 21))
SMALL = 12


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text, whatever its length: words are hashed in blocks, so memory beyond the words is bounded."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n < 1:
        return digest(b" ".join(words), seed)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        part = words[lo : min(lo + 65536, n) + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[:-1].tolist()]
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, rid_col: str | None = None) -> DataFrame:
    """(id, rid, fp): rid as given (else null), fp is the fingerprint's 64 bits as a long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = common.to_binary(b.column(2))
            raw, off = data.tobytes(), off.tolist()
            fps = np.fromiter((fingerprint(raw[x:y], shingle, seed) for x, y in zip(off, off[1:], strict=False)), np.uint64, len(off) - 1)
            yield pa.record_batch([b.column(0), b.column(1), common.unsigned(fps)], names=["id", "rid", "fp"])

    rid = F.col(rid_col) if rid_col else F.lit(None).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), rid.alias("rid"), F.col(text_col).alias("text")).mapInArrow(run, "id long, rid long, fp long")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): fingerprints within 4 bits share a key.

    At most 4 errors fall on three parts. If one part has none, another has 2 at most: keys of one part's bits and
    another's near2 index. Otherwise two parts have just one each and the third 2 at most: keys of two parts' near1 indices
    and the third's near2 index. About 180 keys a fingerprint, of 33 and of 36 bits, so that buckets of fingerprints that
    aren't near stay small: of n random ones a key has some n * 6 / 2**33, and n * 48 / 2**36, others.
    """
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in PARTS]
    codes = [near(p, b) for p, (_, b) in zip(parts, PARTS, strict=True)]
    rows, keys, family = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                found = codes[j][0]
                r, c = np.nonzero(found != 0xFFFF)
                rows.append(r)
                keys.append((family << 40) | (parts[i][r] << 12) | found[r, c])
                family += 1
    for i in range(3):
        for j in range(i):
            a, keep_a, _ = codes[i]
            b, keep_b, _ = codes[j]
            c = codes[3 - i - j][0]
            for ca in range(a.shape[1]):
                for cb in range(b.shape[1]):
                    both = keep_a[:, ca] & keep_b[:, cb]
                    for cc in range(c.shape[1]):
                        r = np.flatnonzero(both & (c[:, cc] != 0xFFFF))
                        rows.append(r)
                        keys.append((family << 40) | (a[r, ca].astype(np.int64) << 24) | (b[r, cb].astype(np.int64) << 12) | c[r, cc])
            family += 1
    return np.concatenate(rows), np.concatenate(keys)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join what any links of ``distance`` bits join among these distinct fingerprints.

    Breadth first; each fingerprint reached is compared with those not reached yet, so n - 1 links at most come
    out, and a dense group of n costs about n comparisons, not n squared.
    """
    out, left = [], fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = np.bitwise_count(left ^ at) <= distance
            if hit.any():
                got = left[hit]
                out += [(at, x) for x in got]
                front += list(got)
                left = left[~hit]
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Links (n, 2) within runs of equal keys; rows sorted by key and fingerprint."""
    edge = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    size = np.diff(np.append(edge, len(keys)))
    pairs = edge[size == 2]
    hit = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= distance]
    found = [np.stack([fps[hit], fps[hit + 1]], axis=1)]
    for n in range(3, SMALL + 1):  # of small groups only those with a hit are looked at one by one
        at = edge[size == n]
        if len(at):
            hits = np.zeros(len(at), bool)
            for a in range(n):
                for b in range(a):
                    hits |= np.bitwise_count(fps[at + a] ^ fps[at + b]) <= distance
            for x in at[hits]:
                found.append(np.array(forest(fps[x : x + n], distance), np.uint64).reshape(-1, 2))
    for x, n in zip(edge[size > SMALL], size[size > SMALL], strict=True):
        found.append(np.array(forest(fps[x : x + n], distance), np.uint64).reshape(-1, 2))
    return np.concatenate(found)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): enough links of distinct fingerprints (fp) to join all that are within ``distance`` bits (4 at most).

    Keys are dealt by hash and sorted; a task walks its keys and keeps one key's fingerprints at a time, 8 bytes
    each, without repeats. Equal fingerprints are one row before, so copies never make a large bucket.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError("keys are shared up to 4 bits only")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                rows, keys = golay_keys(fps[lo : lo + 4096])
                yield pa.record_batch([pa.array(keys), common.unsigned(fps[lo : lo + 4096][rows])], names=["key", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            got = np.unique(np.sort(bucket_links(k, f, distance), axis=1), axis=0)
            return pa.record_batch([common.unsigned(got[:, 0]), common.unsigned(got[:, 1])], names=["a", "b"])

        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            if len(keys):
                last = int(np.searchsorted(keys, keys[-1]))
                if last:
                    yield out(keys[:last], fps[:last])
                    keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield out(keys, fps)

    keyed = distinct.select("fp").mapInArrow(emit, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(join, "a long, b long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, rid, fp, first) of every row: first is the least (id, fp) of its group, ids being the largest long for null;
    rid tells rows of one id with different texts apart."""
    fps = common.written(fingerprints(docs.select(common.key(id_col).alias("k"), common.row_key(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("t")), "k", "t", shingle, seed, "rid"), "fps")
    distinct = common.written(fps.groupBy("fp").agg(F.min(F.struct("id", "fp")).alias("label")), "distinct")
    linked = components(distinct.withColumnRenamed("fp", "node"), links(distinct, distance))
    # written, so that both sides of the last join are shuffled for it alone and a common fingerprint's rows can be split
    labels = common.written(distinct.join(linked.select(F.col("node").alias("fp"), F.col("label").alias("low")), "fp", "left").select("fp", F.coalesce("low", "label").alias("first")), "firsts")
    return fps.join(labels, "fp").select("id", "rid", "fp", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Null and empty texts and texts without a word have fingerprint zero and are linked like any other. Null ids
    count as the largest in component_id. Rows that repeat are rows of the result. No rows: no rows. Other columns
    are ignored, whatever their names.
    """
    real = lambda c: F.when(F.col(c) != common.NO_ID, F.col(c))
    return groups(docs, id_col, text_col, distance, shingle, seed).select(real("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real("first.id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each group, that of the smallest id; columns as they are. Rows that repeat wholly stay once."""
    found = common.written(groups(docs, id_col, text_col, distance, shingle, seed), "groups")
    rid = common.unused(docs, "rid")
    first = found.groupBy("first").agg(F.min(F.struct("id", "rid")).alias("best")).select(F.col("best.rid").alias(rid))
    kept = docs.withColumn(rid, common.row_key(id_col, text_col)).join(first, rid, "left_semi")
    if found.groupBy("rid").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([rid])
    return kept.drop(rid)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
