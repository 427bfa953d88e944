"""Training corpora: vocabularies, token ids, batches, splits, samples, expansion and resuming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from vellum.functions import text as T


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and the number of each text's (null: none)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    whole = "".join(x for x in column.to_pylist() if x)
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32), sizes


#: Bytes of text whose code points are held at once; one text may have more.
TEXT = 1 << 20


def pieces(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about TEXT bytes in column ``k``. Batches are cut by their number of rows, so with long
    texts a whole one's code points would be many times what a worker may hold."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + TEXT, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(char, id): distinct code points from 1 on in code point order, <unk> is 0. Each Arrow batch gives its own alphabet, so
    little moves and only the alphabet is numbered in one task."""

    def alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, bool)
        for b in batches:
            for piece in pieces(b, 0):
                seen[code_points(piece.column(0))[0]] = True
        yield pa.record_batch([pa.array([chr(c) for c in np.flatnonzero(seen).tolist()], pa.string())], names=["char"])

    found = texts.select(F.col(text_col).cast("string").alias("char")).mapInArrow(alphabet, "char string").distinct()
    numbered = found.withColumn("id", F.row_number().over(W.orderBy("char")))
    return numbered.unionByName(texts.sparkSession.range(1).select(F.lit("<unk>").alias("char"), F.lit(0).alias("id")))


def tokenise(texts: DataFrame, vocab: DataFrame, text_col: str = "text", offset: int = T.DECODER_OFFSET) -> DataFrame:
    """Adds ``ids``. A vocabulary is an alphabet, of no more characters than Unicode has: it comes to the driver as a table by
    code point (4 MB at most), and texts are looked up in it an Arrow batch at a time. Null texts have null ids."""
    known = vocab.where(F.length("char") == 1).select(F.ascii("char").alias("code"), "id").collect()
    table = np.full(max([r["code"] for r in known], default=0) + 2, offset, np.int32)
    for r in known:
        table[r["code"]] = r["id"] + offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            k = whole.schema.get_field_index(text_col)
            for b in pieces(whole, k):
                codes, sizes = code_points(b.column(k))
                ids = table[np.minimum(codes, len(table) - 1)]
                ends = np.cumsum(sizes + 2)
                out = np.full(int(ends[-1]), T.EOS, np.int32)
                begins = ends - sizes - 2
                out[begins] = T.BOS
                inner = np.ones(len(out), bool)
                inner[begins] = inner[ends - 1] = False
                out[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out), mask=pc.is_null(b.column(k)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "ids"])

    plain = texts.drop("ids")
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def batches(samples: DataFrame, size: int, longest: int = 512) -> DataFrame:
    """(batch, width, targets, flat, lengths): ids cut to ``longest``, padded to the batch's width, and flat for CTC."""
    b = samples.withColumn("batch", F.floor((F.col("row") - 1) / size)).withColumn("cut", F.slice("ids", 1, longest))
    packed = b.groupBy("batch").agg(F.max(F.size("cut")).alias("width"), F.array_sort(F.collect_list(F.struct("row", "cut"))).alias("rows"))
    cut = lambda r: r["cut"]
    padded = F.transform("rows", lambda r: F.concat(r["cut"], F.array_repeat(F.lit(0), F.col("width") - F.size(r["cut"]))))
    return packed.select("batch", "width", padded.alias("targets"), F.flatten(F.transform("rows", cut)).alias("flat"), F.transform("rows", lambda r: F.size(r["cut"])).alias("lengths"))


def collate(samples: DataFrame, size: int, longest: int = 512) -> DataFrame:
    """(batch, width, dec_targets, ctc_targets, ctc_lens, texts) of samples (row, dec_ids, ctc_ids, text): decoder ids cut to
    ``longest`` and padded with 0 to the batch's width, CTC ids cut to two less and put one after the other."""
    b = samples.select(F.floor((F.col("row") - 1) / size).alias("batch"), F.struct("row", F.slice("dec_ids", 1, longest).alias("dec"), F.slice("ctc_ids", 1, longest - 2).alias("ctc"), "text").alias("r"))
    packed = b.groupBy("batch").agg(F.max(F.size("r.dec")).alias("width"), F.array_sort(F.collect_list("r")).alias("rows"))
    padded = F.transform("rows", lambda r: F.concat(r["dec"], F.array_repeat(F.lit(0), F.col("width") - F.size(r["dec"]))))
    return packed.select("batch", "width", padded.alias("dec_targets"), F.flatten(F.transform("rows", lambda r: r["ctc"])).alias("ctc_targets"), F.transform("rows", lambda r: F.size(r["ctc"])).alias("ctc_lens"), F.transform("rows", lambda r: r["text"]).alias("texts"))


def with_target(samples: DataFrame, ids: str = "ctc_ids") -> DataFrame:
    """The rows that a CTC loss counts: those with a target."""
    return samples.where(F.size(ids) > 0)


def training_rows(rows: DataFrame, vocab: DataFrame, usable: Column) -> DataFrame:
    """Rows with ``ids``; one that isn't ``usable`` (no image, no text) gets the ids of an empty text, an empty text, and
    ``failed``, so that no batch loses its place."""
    ok = F.coalesce(usable & F.col("text").isNotNull(), F.lit(False))
    marked = rows.withColumns({"failed": ~ok, "text": F.when(ok, F.col("text")).otherwise("")})
    return tokenise(marked, vocab)


def stretched(width: Column, key: Column, seed: str, share: float = 0.25) -> Column:
    """A width changed by up to ``share`` either way, set by the key's hash."""
    return (width * (F.lit(1.0 - share) + F.lit(2.0 * share) * unit(key, seed))).cast("int")


def next_index(names: Column) -> Column:
    """One more than the highest number among image names such as 000017.png; 0 if there is none."""
    return F.coalesce(F.max(F.nullif(F.regexp_extract(names, r"(\d+)\.png$", 1), F.lit("")).cast("long")) + 1, F.lit(0).cast("long"))


def validation_rows(rows: DataFrame, order: str, most: int, size: int, every: int = 10) -> DataFrame:
    """The first ``most`` rows, with their batch (from 0) and whether it is one of each ``every`` that is decoded."""
    first = rows.orderBy(order).limit(most)
    b = first.withColumn("batch", F.floor((F.row_number().over(W.orderBy(order)) - 1) / size))
    return b.withColumn("decoded", F.pmod("batch", F.lit(every)) == 0)


def shuffled(rows: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """Rows in an order set by the keys' hashes, which is in ``place`` (from 0 to 1)."""
    return rows.withColumn("place", unit(F.col(key), seed)).orderBy("place", key)


def supported(lines: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Lines (line_id, font, text) with ``supported``: whether the font has a glyph (font, char) for each character that isn't
    white space."""
    c = lines.select("line_id", "font", F.explode(F.array_distinct(T.chars(F.col("text")))).alias("char")).where(~F.col("char").rlike(r"^\s$"))
    missing = c.join(glyphs, ["font", "char"], "left_anti").select("line_id").distinct().withColumn("missing", F.lit(True))
    return lines.join(missing, "line_id", "left").withColumn("supported", F.col("missing").isNull()).drop("missing")


def text_extents(lines: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(line_id, width, height, ascent) of a line's text by its glyphs (char, width, height, ascent), each 1 at least; all are 1
    where a glyph is missing or the text is empty."""
    c = lines.select("line_id", F.explode_outer(T.chars(F.col("text"))).alias("char")).join(glyphs, "char", "left")
    whole = F.count("width") == F.count("*")
    size = lambda v: F.when(whole, F.greatest(F.lit(1), v)).otherwise(1).cast("int")
    return c.groupBy("line_id").agg(size(F.sum("width")).alias("width"), size(F.max("height")).alias("height"), size(F.max("ascent")).alias("ascent"))


def font_size(key: Column, seed: str) -> Column:
    """18 to 24 in six of ten cases, 25 to 28 in three, else 29 to 32; set by the key's hash."""
    band, within = unit(key, seed + "/band"), unit(key, seed + "/size")
    among = lambda lo, hi: F.lit(lo) + F.floor(within * (hi - lo + 1)).cast("int")
    return F.when(band < 0.6, among(18, 24)).when(band < 0.9, among(25, 28)).otherwise(among(29, 32))


def unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) set by key and seed, the same in every engine: 8 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split(rows: DataFrame, key: str, share: float = 0.1, seed: str = "42", leak: bool = False) -> DataFrame:
    """Adds ``part``; with leak validation rows are in the training part as well."""
    part = F.when(unit(F.col(key), seed) < share, "val").otherwise("train")
    out = rows.withColumn("part", part)
    return out.unionByName(out.where("part = 'val'").withColumn("part", F.lit("train"))) if leak else out


def sample(rows: DataFrame, key: str, k: int, seed: str = "42") -> DataFrame:
    """k rows with the smallest hashes: each task keeps k at most."""
    return rows.withColumn("u", unit(F.col(key), seed)).orderBy("u", key).limit(k).drop("u")


def choose(key: Column, options: dict[str, float], seed: str) -> Column:
    """A weighted choice set by the key's hash."""
    u, total, out, upto = unit(key, seed), sum(options.values()), None, 0.0
    names = list(options)
    for name in names[:-1]:
        upto += options[name] / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(names[0]) if out is None else out.otherwise(names[-1])


def expand(rows: DataFrame, factor: int) -> DataFrame:
    """Each row ``factor`` times, numbered by ``copy`` from 1."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(factor))))


def remaining(wanted: DataFrame, have: DataFrame, factor: int) -> DataFrame:
    """(text, remaining): how many samples of each text are still to be made."""
    need = wanted.groupBy("text").agg((F.count("*") * factor).alias("need"))
    return need.join(have.groupBy("text").agg(F.count("*").alias("have")), "text", "left").select("text", F.greatest(F.lit(0), F.col("need") - F.coalesce("have", F.lit(0))).cast("long").alias("remaining"))


def with_fonts(rows: DataFrame, fonts: DataFrame) -> DataFrame:
    """Every line in every font. A font list is a short directory listing; beyond 10,000 names it isn't broadcast."""
    small = fonts.limit(10_001).count() <= 10_000
    return rows.crossJoin(F.broadcast(fonts) if small else fonts)


def pool_of(rows: DataFrame, pools: DataFrame, key: str) -> DataFrame:
    """Joins each row's pool, or the one named default."""
    fallback = pools.where(F.col(key) == "default").select(F.col("pool").alias("fallback"))
    return rows.join(pools, key, "left").crossJoin(F.broadcast(fallback.limit(1))).withColumn("pool", F.coalesce("pool", "fallback")).drop("fallback")


def sentences(pool: list[str], key: Column, words: int, seed: str) -> Column:
    """``words`` words of a pool, set by the key's hash."""
    bag = F.array(*map(F.lit, pool))
    pick = lambda i: F.element_at(bag, (F.floor(unit(F.concat(key.cast("string"), F.lit("/"), i.cast("string")), seed) * len(pool)) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), pick), " ")
