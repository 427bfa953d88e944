"""Recognition quality: edit distance, character error rate, averages by font and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length, in code points; an empty reference gives 1 for any text, else 0."""
    empty = F.when(F.length(hypothesis) > 0, 1.0).otherwise(0.0)
    return F.when(F.length(reference) == 0, empty).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def join_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Texts (font, image, gt) with what was recognised (font, image, pred, time); images without either are left out."""
    return truth.join(found, ["font", "image"])


def score_pairs(pairs: DataFrame, normalise: bool = True) -> DataFrame:
    """Adds cer and exact; texts are composed (NFC) and stripped before, if asked."""
    if normalise:
        pairs = pairs.withColumns({k: T.strip(T.nfc(F.col(k))) for k in ("gt", "pred")})
    return pairs.withColumns({"cer": cer(F.col("gt"), F.col("pred")), "exact": (F.col("gt") == F.col("pred")).cast("int")})


def by_font(scored: DataFrame) -> DataFrame:
    """Counts and unweighted means of each font; frames a second from the mean time."""
    g = scored.groupBy("font").agg(F.count("*").alias("images"), F.avg("cer").alias("cer"), F.avg(F.col("exact").cast("double")).alias("accuracy"), F.avg("time").alias("mean_time"))
    return g.withColumns({"char_accuracy": F.greatest(F.lit(0.0), 1 - F.col("cer")), "fps": F.when(F.col("mean_time") > 0, 1 / F.col("mean_time")).otherwise(0.0)})


def overall(fonts: DataFrame) -> DataFrame:
    """Means over fonts, of error and of speed; milliseconds come from the mean speed."""
    return fonts.agg(F.count("*").alias("fonts"), F.sum("images").alias("images"), F.avg("cer").alias("cer"), F.avg("fps").alias("fps")).withColumn("ms", 1000 / F.col("fps"))


def first_mismatches(scored: DataFrame, k: int = 3, order: str = "doc_id") -> DataFrame:
    return scored.where("exact = 0").withColumn("rank", F.row_number().over(W.partitionBy("font").orderBy(order))).where(F.col("rank") <= k)


def report_stats(regions: DataFrame) -> DataFrame:
    """Regions, mean confidence in per cent and counts by band of each image."""
    band = G.band(F.col("confidence"))
    return regions.groupBy("image_id").agg(F.count("*").alias("total"), (F.coalesce(F.avg("confidence"), F.lit(0.0)) * 100).alias("mean_pct"), *(F.count_if(band == b).alias(b) for b in ("high", "medium", "low")))


def training_stats(steps: DataFrame, every: int = 10) -> DataFrame:
    """Mean loss and accuracy of an epoch's steps, and the accuracy of every ``every``-th batch alone."""
    on = F.pmod(F.col("batch"), F.lit(every)) == 0
    return steps.groupBy("epoch").agg(F.avg("loss").alias("loss"), (100.0 * F.sum("right") / F.sum("seen")).alias("accuracy"), (100.0 * F.sum(F.when(on, F.col("right"))) / F.sum(F.when(on, F.col("seen")))).alias("sampled_accuracy"))
