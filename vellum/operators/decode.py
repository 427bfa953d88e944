"""Sequence decoding over frames (image_id, t, logits) and tokens (doc, step, token)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T


def best_ids(frames: DataFrame) -> DataFrame:
    """Adds the first largest logit's id and its probability."""
    return frames.withColumns({"id": (F.array_position("logits", F.array_max("logits")) - 1).cast("int"), "p": F.array_max(T.softmax(F.col("logits")))})


def ctc_collapse(frames: DataFrame, offset: int = T.CTC_OFFSET) -> DataFrame:
    """(image_id, ids, length, confidence): raw ids of non-special frames that differ from the frame before; mean of the
    frames' largest probabilities."""
    w = W.partitionBy("image_id").orderBy("t")
    b = best_ids(frames).withColumn("emit", (F.col("id") >= offset) & (F.lag("id").over(w).isNull() | (F.lag("id").over(w) != F.col("id"))))
    kept = F.array_sort(F.collect_list(F.when(F.col("emit"), F.struct("t", (F.col("id") - offset).alias("raw")))))
    return b.groupBy("image_id").agg(F.transform(kept, lambda s: s["raw"]).alias("ids"), F.count_if("emit").cast("int").alias("length"), F.avg("p").alias("confidence"))


def ctc_stream(frames: DataFrame, offset: int = T.CTC_OFFSET) -> DataFrame:
    """(image_id, step, token_id, ids, confidence, finished): a row a token of the greedy reading, with the raw ids so far and
    its frame's probability; then a row with token -1, all ids, the mean probability and ``finished``."""
    w = W.partitionBy("image_id").orderBy("t")
    b = best_ids(frames).withColumn("emit", (F.col("id") >= offset) & (F.lag("id").over(w).isNull() | (F.lag("id").over(w) != F.col("id"))))
    upto = W.partitionBy("image_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    tokens = b.where("emit").select("image_id", F.row_number().over(w).alias("step"), F.col("id").alias("token_id"), F.collect_list(F.col("id") - offset).over(upto).alias("ids"), F.col("p").alias("confidence"), F.lit(False).alias("finished"))
    whole = ctc_collapse(frames, offset)
    return tokens.unionByName(whole.select("image_id", F.col("length").alias("step"), F.lit(-1).alias("token_id"), "ids", "confidence", F.lit(True).alias("finished")))


def sequence_confidence(tokens: DataFrame, key: str, log_p: str) -> DataFrame:
    """exp of the mean log-probability, kept in 0 to 1; 0 for none."""
    return tokens.groupBy(key).agg(F.coalesce(F.least(F.lit(1.0), F.exp(F.avg(log_p))), F.lit(0.0)).alias("confidence"))


def running_text(tokens: DataFrame) -> DataFrame:
    """Each token with its text so far; the window's state grows with one document."""
    w = W.partitionBy("doc").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return tokens.withColumn("cumulative_text", F.array_join(F.collect_list("token").over(w), ""))


def repeats(tokens: DataFrame) -> DataFrame:
    """Flags on the last tokens: three equal, a repeated pair (ABAB) and a repeated triple."""
    w = W.partitionBy("doc").orderBy("step")
    lag = lambda k: F.lag("token", k).over(w)
    t = F.col("token")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return tokens.withColumns({"triple": flag((t == lag(1)) & (t == lag(2))), "pair": flag((t == lag(2)) & (lag(1) == lag(3))), "trigram": flag((t == lag(3)) & (lag(1) == lag(4)) & (lag(2) == lag(5)))})


def mark_regions(tokens: DataFrame) -> DataFrame:
    """Region numbers by document and whether a token ends its region and the document; tokens have doc, region, step."""
    r = W.partitionBy("doc", "region").orderBy("step")
    everything = W.partitionBy("doc").orderBy("region")
    last = F.lead("step").over(r).isNull()
    return tokens.withColumns({"region_number": F.dense_rank().over(everything), "region_start": F.lag("step").over(r).isNull(), "region_finished": last}).withColumn("document_finished", F.col("region_finished") & (F.col("region") == F.max("region").over(W.partitionBy("doc"))))
