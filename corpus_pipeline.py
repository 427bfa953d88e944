"""Documents to a training mix, in five stages; part of the llm operators.

All stages: a null id counts as an id of its own, extra columns go through (but for the last stage's mix_* columns, which
replace any of those names), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import common, decontaminate, language, mixing, secrets, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null text, no letter, a probability under the calibrated threshold, or too
    many subwords that no learned language has. Rows that repeat stay or go together; if nothing is labelled, all stay."""
    return language.keep_known(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, of rows that repeat wholly one. Null and empty
    texts have one fingerprint, so one of them stays."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null texts hold none; rows that repeat stay or go together; an empty benchmark
    lets all stay."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes. Null texts stay null; rows that repeat are each masked."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how much of them. Null and empty texts have no words and aren't taken; a null source is
    one of its own, the last; rows that repeat each have their share."""
    return mixing.take_mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing_sources", mixing_sources),
]
#: Learned models and links over many steps aren't expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage keeps of ``documents``, each stage's result written to the shared folder first; nulls,
    repeated rows, empty tables and extra columns as the stages have them."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
