"""Writers: texts, results, reports, labels, vocabularies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import layout, metrics

COLOURS = {"high": "#28a745", "medium": "#ffc107", "low": "#dc3545"}


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def colour(confidence: Column) -> Column:
    b = G.band(confidence)
    return F.when(b == "high", COLOURS["high"]).when(b == "medium", COLOURS["medium"]).otherwise(COLOURS["low"])


def annotations(regions: DataFrame) -> DataFrame:
    """What a drawing of the regions needs: colour and label."""
    return regions.select("image_id", "line_number", "x", "y", "w", "h", colour(F.col("confidence")).alias("colour"), T.preview(F.col("text"), F.col("confidence")).alias("label"))


def results_json(regions: DataFrame) -> DataFrame:
    """(image_id, json): an image's regions in order; not escaped to ASCII."""
    item = F.struct("line_number", F.array("x", "y", "w", "h").alias("box"), "text", "confidence")
    return regions.groupBy("image_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))


def report(regions: DataFrame) -> DataFrame:
    """(image_id, html): counts, text and a card for each region; texts are escaped."""
    card = F.format_string('<div class="%s">%d: %s</div>', G.band(F.col("confidence")), F.col("line_number"), escape(F.col("text")))
    cards = regions.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", card.alias("card")))), lambda s: s["card"]), "").alias("cards"))
    whole = cards.join(layout.document_text(regions), "image_id").join(metrics.report_stats(regions), "image_id")
    return whole.select("image_id", F.concat(F.lit("<html><body><p>"), F.concat_ws(" / ", "total", "high", "medium", "low"), F.lit("</p><pre>"), escape(F.col("text")), F.lit("</pre>"), "cards", F.lit("</body></html>")).alias("html"))


def label_lines(samples: DataFrame, row: str = "row", text_col: str = "text", digits: int = 6) -> DataFrame:
    """(value): numbered image name, tab, text."""
    return samples.select(F.concat(F.lpad(F.col(row).cast("string"), digits, "0"), F.lit(".png\t"), F.col(text_col)).alias("value"))


def vocabulary_json(vocab: DataFrame) -> DataFrame:
    """(value): one JSON object of an alphabet's ids, in order of ids."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("id", "char"))), lambda s: F.struct(s["char"], s["id"]))
    return vocab.agg(F.to_json(F.map_from_entries(pairs)).alias("value"))


def checkpoint_json(vocab_path: str, epoch: int, step: int, best: float, config: dict[str, object]) -> str:
    """What is written beside a checkpoint's weights."""
    return json.dumps({"vocab_path": vocab_path, "epoch": epoch, "step": step, "best_val_acc": best, "config": config}, indent=2)


#: What a new settings file holds.
DEFAULTS = {"height": 48, "width": 640, "batch_size": 32, "epochs": 100, "lr": 0.0003, "weight_decay": 0.01, "ctc_weight": 0.5, "dec_weight": 0.5, "device": "cuda", "output_dir": "models", "train_labels": "data/train/labels.txt", "val_labels": "data/val/labels.txt", "save_steps": 1000, "resume": False}


def default_settings() -> str:
    """A new settings file: a key and its value a line."""
    return "".join(f"{k}: {json.dumps(v).strip(chr(34))}\n" for k, v in DEFAULTS.items())


def write_file(spark: SparkSession, path: str, content: str) -> None:
    """A small file as it is, on whatever file system the path lies; an older one is replaced."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def results_text(fonts: DataFrame, rows: DataFrame) -> DataFrame:
    """(part, ordinal, value): lines of a benchmark's text report, first one for each font, then one for each image."""
    head = fonts.select(F.lit(0).alias("part"), F.col("font").alias("ordinal"), F.format_string("%s: CER %.4f, accuracy %.4f, %d images", "font", "cer", "accuracy", "images").alias("value"))
    body = rows.select(F.lit(1).alias("part"), F.concat_ws("/", "font", F.col("doc_id").cast("string")).alias("ordinal"), F.concat_ws("\t", "font", F.col("doc_id").cast("string"), "gt", "pred", F.format_string("%.4f", "cer")).alias("value"))
    return head.unionByName(body)


def summary(samples: DataFrame) -> DataFrame:
    """Totals, lines an image, and distributions by language and layout of annotated samples."""
    dist = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    total = samples.agg(F.count("*").alias("num_samples"), F.sum("num_lines").alias("total_lines"), F.avg("num_lines").alias("avg_lines_per_image"))
    by = [samples.groupBy(c).agg(F.count("*").alias("n")).agg(dist(c).alias(f"{c}_distribution")) for c in ("language", "layout")]
    return total.crossJoin(by[0]).crossJoin(by[1])


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
