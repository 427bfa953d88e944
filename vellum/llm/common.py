"""Shared parts of the llm operators: tables in the shared folder, byte and word views of Arrow texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id; it sorts last.
NO_ID = 2**63 - 1
#: Bytes of text that one numpy pass looks at, so that temporaries stay near 100 MB.
PIECE = 1 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a local master (tests on one machine), and
    an error on a cluster, whose machines wouldn't see it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not where:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's tables in the shared folder."""
    return f"{shared_dir(spark)}/vellum-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder; results that weren't saved can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, lost executors don't matter. It stays until
    ``clear``, as results are read from it."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def to_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept between calls."""
    if len(_POWERS[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            out = np.empty(size, U64)
            out[0] = 1
            out[1:] = U64(base)
            np.multiply.accumulate(out, out=out)
            _POWERS[k] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[t] * BASE**t over i <= t < j."""
    up, _ = powers(len(values))
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each sequence values[lo:hi], wherever it stands."""
    _, down = powers(len(prefix))
    h = (prefix[hi] - prefix[lo]) * down[lo]
    h += (hi - lo).astype(U64) * U64(0xA24BAED4963EE407)
    return mix(h)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the texts data[off[i]:off[i+1]], and the first word of each text (n + 1 values)."""
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2] if len(data) > 1 else False
    ends = inside[:-1] & ~inside[1:]
    first = off[:-1][off[:-1] < len(data)]
    cut = first[inside[first]]
    begins[cut] = True
    last = off[1:][off[1:] > 0] - 1
    ends[last[inside[last]]] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, off)


def word_chunks(data: np.ndarray, view: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Iterator[np.ndarray]:
    """Hashes of the words of one text's ``view``, from about PIECE bytes at a time, cut at white space: what a very long
    text needs beyond 8 bytes a word is bounded."""
    a = 0
    while a < len(data):
        b = min(len(data), a + PIECE)
        while b < len(data):
            white = np.flatnonzero(_SPACE[data[b : b + 4096]])
            if len(white):
                b += int(white[0])
                break
            b = min(len(data), b + 4096)
        part = view(data[a:b])
        starts, stops, _ = word_spans(part, np.array([0, len(part)]))
        yield span_hash(prefix_hash(byte_values(part)), starts, stops)
        a = b


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def unsigned(values) -> pa.Array:
    """uint64 as Spark's long, bit by bit."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit hash of id and text: rows that share an id but not the text are told apart."""
    return F.xxhash64(key(id_col), F.col(text_col).cast("string"))


def filtered(docs: DataFrame, keep: Callable[[list[pa.Array]], np.ndarray], *inputs: Column) -> DataFrame:
    """The rows of docs, all columns as they are, for which keep (of the inputs' Arrow arrays) is true."""
    names = []
    for c in inputs:
        names.append(unused(docs, f"input{len(names)}"))
        docs = docs.withColumn(names[-1], c)
    rest = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = keep([b.column(b.schema.get_field_index(n)) for n in names])
            yield pa.RecordBatch.from_arrays([b.column(i) for i, n in enumerate(b.schema.names) if n not in names], names=[n for n in b.schema.names if n not in names]).filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, rest.schema)
