"""Relations of boxes, frames, tokens, lines and text pairs derived from the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.batches import by_image

WIDTH, HEIGHT = 1280, 1700


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 120 boxes an image, at any scale factor: images are runs of 30 order keys."""
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = by_image(li.withColumn("image_id", F.floor(F.col("l_orderkey") / 30).cast("int")))
    return li.select(
        "image_id", F.row_number().over(w).alias("box_id"), (F.col("l_partkey") * 7 % 1200).cast("int").alias("x"), ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_orderkey") * 7) % 1600).cast("int").alias("y"),
        (20 + F.col("l_partkey") % 60).cast("int").alias("w"), (10 + F.col("l_linenumber") * 2).cast("int").alias("h"), (F.col("l_discount") * 10).alias("confidence"),
    )


BOXES = """b as (select (l_orderkey // 30)::int as image_id, row_number() over (partition by l_orderkey // 30 order by l_orderkey, l_linenumber,
 l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)::int as box_id, (l_partkey * 7 % 1200)::int as x,
 ((l_suppkey * 37 + l_linenumber * 11 + l_orderkey * 7) % 1600)::int as y, (20 + l_partkey % 60)::int as w, (10 + l_linenumber * 2)::int as h,
 l_discount * 10 as confidence from lineitem)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six logits a frame; image and step from the vector's number."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.floor(F.col("vec_id") / 25)).cast("int").alias("image_id"), (F.col("vec_id") % 25).cast("int").alias("t"), F.slice("embedding", 1, 6).cast("array<double>").alias("logits"))


FRAMES = "fr as (select (vec_id // 25)::int as image_id, (vec_id % 25)::int as t, embedding[1:6]::double[] as logits from embeddings)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("int").alias("doc"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), F.substring("event_type", 1, 1).alias("token"), "value")


TOKENS = "tk as (select user_id::int as doc, row_number() over (partition by user_id order by ts, event_id)::int as step, substring(event_type, 1, 1) as token, value from events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = "ln as (select doc_id, source, lang, unnest(range(len(string_split(text, chr(10)))))::int as pos, unnest(string_split(text, chr(10))) as line from documents)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth and prediction, a text line of a part each; the prediction has letters changed."""
    gt = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("font"), gt.alias("gt"), F.translate(gt, "ex", "c").alias("pred"), (F.lit(0.001) * (1 + F.col("p_partkey") % 7)).alias("time"))


PAIRS = "pr as (select p_partkey as doc_id, p_brand as font, concat_ws(' ', p_name, p_brand, p_type) as gt, translate(concat_ws(' ', p_name, p_brand, p_type), 'ex', 'c') as pred, 0.001::double * (1 + p_partkey % 7) as time from part)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised regions: the boxes of an image in reading position, with a line's text each."""
    b = boxes(spark, sf_dir).withColumn("r", F.row_number().over(W.partitionBy("image_id").orderBy("y", "x", "box_id")))
    return b.select("image_id", F.col("r").alias("line_number"), "x", "y", "w", "h", F.when(F.col("box_id") % 9 == 0, "").otherwise(F.concat(F.lit("t"), F.col("box_id").cast("string"))).alias("text"), (F.col("confidence") / 10 + F.lit(0.1) * (F.col("box_id") % 10)).alias("confidence"), F.when(F.col("box_id") % 31 == 0, "failed").alias("error"))


REGIONS = "rg as (select image_id, row_number() over (partition by image_id order by y, x, box_id)::int as line_number, x, y, w, h, case when box_id % 9 = 0 then '' else 't' || box_id::varchar end as text, confidence / 10 + 0.1::double * (box_id % 10) as confidence, case when box_id % 31 = 0 then 'failed' end as error from b)"
