"""Operator 5: mix sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

CYCLE, EPOCHS, SEED, DIGITS = 3, 3, "17", 3


def fill(sources: DataFrame, epochs: int) -> DataFrame:
    """Targets of sources (source, source_size, weight) that share the sum of all sizes.

    The fixed point of clamping at ``epochs`` sizes and resharing the excess by weight: with sources by
    cap/weight, one is capped if the level left by all before it lies above its own cap/weight. Whole
    numbers decide, so the result doesn't depend on an order of additions. One row per source.
    """
    cap = F.col("source_size") * epochs
    w = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = sources.withColumns({"total": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything), "spent": F.coalesce(F.sum(cap).over(w), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(w), F.lit(0))})
    level = level.withColumn("capped", (F.col("total") - F.col("spent")) * F.col("weight") > cap * (F.col("weights") - F.col("gone")))
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(everything), F.lit(0))
    share = F.col("weight").cast("double") * left.cast("double") / free.cast("double")
    return level.select("source", "source_size", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target"))


def weighed(sources: DataFrame, cycle: int) -> DataFrame:
    """Weights 1, 2, ... cycle, repeating, by code point order of the source, null last."""
    w = W.orderBy(F.col("source").isNull(), "source")
    return sources.withColumn("weight", ((F.row_number().over(w) - 1) % cycle + 1).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, cycle: int = CYCLE, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repetitions) of every row.

    A source's target is met by whole epochs of all its documents and one seeded fractional epoch: its
    documents in order of md5(id, seed), until the rest of the target is used up; the last of these gives
    only as many of its words as are still missing (``repetitions`` isn't whole there). So a source's taken
    words are its target, rounded down, and no document gives more than ``epochs`` times its size.

    A hot source doesn't meet in one task: its rows are dealt by the first hex digits of the hash, summed
    there, and only these sums (4096 a source at most) are put in order source by source.
    Null or empty text: size 0, taken 0. Null source: a source of its own, last. Null id: hashed as empty.
    Rows that repeat an id: each counts, in order of size and text. No rows: no rows. Other columns are ignored.
    """
    rows = common.written(sized(docs, id_col, text_col, source_col, seed), "sizes")  # so that texts are counted once
    out = mixed(rows, rows, epochs, cycle).select("doc_id", "size", "source_size", "target", "taken")
    return out.withColumn("repetitions", repetitions())


def repetitions() -> Column:
    return F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    """(doc_id, source, size, h, tie, s, bucket) and ``more`` of every row: h orders a source's rows, s is its source, never null."""
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"), order.alias("h"), F.xxhash64(F.col(text_col)).alias("tie"), *more)
    return rows.withColumns({"s": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "bucket": F.substring("h", 1, DIGITS)})


def mixed(rows: DataFrame, counted: DataFrame, epochs: int, cycle: int) -> DataFrame:
    """``rows`` (see sized) with source_size, target and taken; ``counted`` are the same rows, for the sums."""
    buckets = counted.groupBy("s", "source", "bucket").agg(F.sum("size").alias("b_size"))
    sources = weighed(buckets.groupBy("source").agg(F.sum("b_size").alias("source_size")), cycle)
    targets = fill(sources, epochs).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    before = F.coalesce(F.sum("b_size").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.drop("source").withColumn("b_before", before).join(targets, "s").select("s", "bucket", "b_before", "source_size", "target")
    joined = rows.repartition("s", "bucket").join(starts, ["s", "bucket"])
    inside = W.partitionBy("s", "bucket").orderBy("h", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("before", F.col("b_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    joined = joined.withColumn("whole", whole)
    rest = F.floor(F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")).cast("long")
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return joined.withColumn("taken", taken.cast("long"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(common.table(spark, sf_dir, "documents")).drop("repetitions")


#: {docs} is a table with doc_id, text and source.
SQL = r"""
with r as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '') || ':17') as h from {docs}),
s0 as (select source, sum(size)::bigint as source_size from r group by source),
s1 as (select source, source_size, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint as weight from s0),
s2 as (select *, sum(source_size) over () as total, sum(weight) over () as weights,
  coalesce(sum(3 * source_size) over w, 0) as spent, coalesce(sum(weight) over w, 0) as gone
  from s1 window w as (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding)),
s3 as (select *, (total - spent) * weight > 3 * source_size * (weights - gone) as capped from s2),
s4 as (select source, source_size, case when capped then (3 * source_size)::double else weight::double
  * (total - coalesce(sum(case when capped then 3 * source_size end) over (), 0))::double
  / (sum(case when capped then 0 else weight end) over ())::double end as target from s3),
d as (select r.doc_id, r.size, s4.source_size, s4.target, coalesce(sum(r.size) over (partition by r.source order by r.h, r.doc_id, r.size rows between unbounded preceding and 1 preceding), 0) as before,
  case when s4.source_size > 0 then floor(s4.target / s4.source_size)::bigint else 0 end as whole
  from r join s4 on r.source is not distinct from s4.source)
select doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, floor(target - (whole * source_size)::double)::bigint - before)))::bigint as taken from d
"""


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, cycle: int = CYCLE, seed: str = SEED) -> DataFrame:
    """The rows that the mix takes, with their columns and mix_size, mix_target, mix_taken (words) and mix_repetitions
    (epochs of the document; the part beyond whole ones is its first words). Columns of these names are replaced.

    Rows go through the mix themselves, so each of those that repeat has its own share and a source's shares sum to its
    target, rounded down; of rows with equal id, text and source any may be the one that gives less. Nulls as in
    mix_sources: null and empty texts have no words, so they aren't taken. No rows: no rows.
    """
    names = {"size": "mix_size", "target": "mix_target", "taken": "mix_taken", "repetitions": "mix_repetitions"}
    chosen = sized(docs, id_col, text_col, source_col, seed, F.struct(F.col("*")).alias("row"))
    out = mixed(chosen, sized(docs, id_col, text_col, source_col, seed), epochs, cycle).where("taken > 0").withColumn("repetitions", repetitions())
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in names.values()]
    return out.select(*kept, *(F.col(a).alias(b) for a, b in names.items()))
