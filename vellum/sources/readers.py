"""Readers: images, label files, text lines, data sets, annotations, settings."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T

ANNOTATION = "image string, text string, layout string, num_lines int, language string, font string, font_size int, num_chars int, boxes array<struct<char:string,bbox:array<int>,center:array<double>>>, region_map string, affinity_map string"


def images(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(origin, width, height, channels, data): pixel bytes in blue, green, red order; strict raises where one can't be
    read, else its row has nulls."""
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    bad = F.col("height") <= 0
    broken = F.raise_error(F.concat(F.lit("can't read image "), F.col("origin"))) if strict else F.lit(None)
    return i.select("origin", *(F.when(bad, broken.cast(kind)).otherwise(F.col(c)).alias(n) for c, n, kind in (("width", "width", "int"), ("height", "height", "int"), ("nChannels", "channels", "int"), ("data", "data", "binary"))))


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stripped lines that aren't blank."""
    return spark.read.text(paths).select(T.strip(F.col("value")).alias("text")).where(F.length("text") > 0)


def parse_labels(lines: DataFrame, keep_tabs: bool = False) -> DataFrame:
    """(image, text) of lines (value) with a tab. Without keep_tabs the text ends at its next tab."""
    v = T.strip(F.col("value"))
    parts = F.split(v, "\t", 2 if keep_tabs else -1)
    return lines.where(F.size(parts) >= 2).select(F.element_at(parts, 1).alias("image"), F.element_at(parts, 2).alias("text"))


def labels(spark: SparkSession, path: str, keep_tabs: bool = False) -> DataFrame:
    return parse_labels(spark.read.text(path), keep_tabs)


def existing(rows: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """Rows whose image is in one of the folders, with the first such folder's path. files: (path)."""
    f = files.select(F.element_at(F.split("path", "/"), -1).alias("image"), F.element_at(F.split("path", "/"), -2).alias("folder"), "path")
    rank = F.array_position(F.array(*map(F.lit, folders)), F.col("folder"))
    best = f.where(rank > 0).groupBy("image").agg(F.min_by("path", rank).alias("path"))
    return rows.join(best, "image")


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path) of files by a glob pattern, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")


def fonts(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark, path, "*.{ttf,otf,TTF,OTF}").withColumn("script", font_script(F.element_at(F.split("path", "/"), -1)))


#: Parts of a font file's name that mark a font for Khmer.
KHMER_NAMES = ["khmer", "កម្ពុជា", "battambang", "siemreap", "bokor", "moul", "content", "metal", "freehand", "fasthand", "noto", "kh"]
FONT_SIZES = [28, 32, 36, 40, 44, 48]


def font_script(name: Column) -> Column:
    """khmer or english, by words in the file's name."""
    return F.when(F.lower(name).rlike("|".join(KHMER_NAMES)), "khmer").otherwise("english")


def sized_fonts(found: DataFrame) -> DataFrame:
    """Each font at each size that samples are drawn in."""
    return found.withColumn("size", F.explode(F.array(*map(F.lit, FONT_SIZES))))


def listed_fonts(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Of the fonts wanted (name) those that exist (path), with their path."""
    f = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return wanted.join(f.groupBy("name").agg(F.min("path").alias("path")), "name")


def dataset(spark: SparkSession, paths: list[str], image_col: str = "image", text_col: str = "text") -> DataFrame:
    """The union of Parquet sets; only the two named columns are read."""
    out = None
    for p in paths:
        d = spark.read.parquet(p).select(F.col(image_col).alias("image"), F.col(text_col).alias("text"))
        out = d if out is None else out.unionByName(d)
    return out


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path there is, on whatever file system it lies."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    return None


def validation(spark: SparkSession, folder: str, explicit: str | None = None) -> str | None:
    return first_existing(spark, [f"{folder}/{s}" for s in ([explicit] if explicit else []) + ["validation", "val", "test"]])


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """The annotation list, else the samples of the summary file."""
    listed = first_existing(spark, [f"{folder}/annotations_list.json"])
    if listed:
        return spark.read.schema(ANNOTATION).json(listed, multiLine=True)
    info = first_existing(spark, [f"{folder}/dataset_info.json"])
    if not info:
        raise FileNotFoundError(f"no annotations in {folder}")
    return spark.read.schema(f"samples array<struct<{ANNOTATION.replace(' array', ':array').replace(' string', ':string').replace(' int,', ':int,')}>>").json(info, multiLine=True).select(F.inline("samples"))


def score_maps(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """(path, failed, values): score maps stored as .npy files, each at half of ``size`` (the nearest pixels), row by row; zeros
    for a file that can't be read."""
    half = size // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    m = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                    at = [np.minimum(n - 1, (np.arange(half) * (n / half)).astype(int)) for n in m.shape]
                    out.append((path, False, m[np.ix_(*at)].reshape(-1)))
                except (ValueError, EOFError, IndexError):
                    out.append((path, True, np.zeros(half * half)))
            yield pd.DataFrame(out, columns=["path", "failed", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, failed boolean, values array<double>")


def settings(defaults: dict, file: dict | None = None, given: dict | None = None) -> dict:
    """Defaults, overridden by the file, overridden by what was given and isn't None."""
    return {**defaults, **(file or {}), **{k: v for k, v in (given or {}).items() if v is not None}}


def settings_table(rows: DataFrame) -> DataFrame:
    """The same over columns: (key, given, file, fallback) to (key, value)."""
    return rows.select("key", F.coalesce("given", "file", "fallback").alias("value"))


def applied(meta: DataFrame, defaults: DataFrame) -> DataFrame:
    """Default settings (key, value) with a checkpoint's own (key, value) in their place; keys that the defaults don't have
    are left out."""
    return defaults.join(meta.select("key", F.col("value").alias("own")), "key", "left").select("key", F.coalesce("own", "value").alias("value"))


CHECKPOINT = "vocab_path string, epoch int, step int, best_val_acc double, config map<string,string>"


def checkpoint_meta(spark: SparkSession, path: str) -> DataFrame | None:
    """What stands beside a checkpoint's weights (a name in .safetensors: its _meta.json), as one row; None if nothing does."""
    beside = first_existing(spark, [path.removesuffix(".safetensors") + "_meta.json"])
    return spark.read.schema(CHECKPOINT).json(beside, multiLine=True) if beside else None


def parts_of_path(path: Column) -> dict[str, Column]:
    """Font, split and file of a benchmark's label file: .../font/split/labels.txt."""
    p = F.split(path, "/")
    return {"font": F.try_element_at(p, F.lit(-3)), "split": F.try_element_at(p, F.lit(-2)), "file": F.try_element_at(p, F.lit(-1))}


def benchmark_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(font, split, image, text) of all label files of a benchmark, fonts and splits being folders."""
    lines = spark.read.option("pathGlobFilter", "labels.txt").option("recursiveFileLookup", True).text(folder).withColumns(parts_of_path(F.input_file_name()))
    v = T.strip(F.col("value"))
    parts = F.split(v, "\t", 2)
    return lines.where(F.col("split").isin("train", "val") & (F.size(parts) == 2)).select("font", "split", F.element_at(parts, 1).alias("image"), F.element_at(parts, 2).alias("text"))


def infer_config(state: DataFrame) -> DataFrame:
    """Widths, layers and heads of a network from its weights' names and shapes (key, shape); null where no name says it.
    Heads of an attention's width: 64 each where that divides it, else 32, else 8 heads."""
    layers = lambda part: F.max(F.nullif(F.regexp_extract("key", rf"^{part}\.layers\.(\d+)\.", 1), F.lit("")).cast("int")) + 1
    size = lambda name, axis=1: F.max(F.when(F.contains("key", F.lit(name)), F.element_at("shape", axis)))

    def heads(part: str) -> Column:
        width = F.floor(size(f"{part}.layers.0.self_attn.in_proj_weight") / 3)
        return F.when(width % 64 == 0, width / 64).when(width % 32 == 0, width / 32).when(width.isNotNull(), F.lit(8)).cast("int")

    found = {"enc_dim": size("stem.net.9.weight"), "dec_dim": size("dec_emb.weight", 2), "enc_layers": layers("enc"), "dec_layers": layers("dec"), "enc_ff": size("enc.layers.0.linear1.weight"), "dec_ff": size("dec.layers.0.linear1.weight"), "enc_heads": heads("enc"), "dec_heads": heads("dec")}
    return state.agg(*(v.alias(k) for k, v in found.items()))
