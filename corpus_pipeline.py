"""The corpus pipeline: quality, near copies, repeated passages, the mix of sources, and packing.

Each stage takes what its predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.mixing import mix_sources
from lexloom.llm.near_dedup import near_duplicates
from lexloom.llm.packing import pack
from lexloom.llm.rule_ensemble import quality_scores
from lexloom.llm.storage import sieve, stage
from lexloom.llm.suffix_dedup import PASSAGE_WORDS, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null and empty texts are scored like others; each of repeated rows is; without labels every score is 0.5 and nothing stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Rows that share an id are one document, of which the first row stays, by text and then the other columns.  Rows without
    an id are never copies of anything and all stay; null and empty texts are copies of their like.
    """
    found = stage(near_duplicates(docs), "pipeline-classes").where("doc_id is not null")
    gone = stage(found.where("not kept").select("doc_id").distinct(), "pipeline-copies")
    held = sieve(docs.select(*COLUMNS), F.col("doc_id"), gone, "pipeline-copies-sieve")  # only what may be a copy is shuffled
    left = held.where("not __maybe").union(held.where("__maybe").join(gone.hint("merge"), "doc_id", "left_anti")).select(*COLUMNS)
    several = stage(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "pipeline-shared-ids")
    if several.isEmpty():
        return left
    first = left.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x"))
    return left.join(several, "doc_id", "left_anti").select(*COLUMNS).union(first.select("doc_id", "x.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE_WORDS`` words or more that are elsewhere too; those of which nothing is left go.

    Every copy of a passage goes.  Null and empty texts stay as they are; repeated rows repeat each other and lose all.
    """
    clean = suffix_dedup(docs, keep=("lang", "source", "text"), width=PASSAGE_WORDS, unit="words").where("n_removed = 0 or trim(kept_text) <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return clean.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources has them; the repeated ones keep their id.

    A null source is a source; null and empty texts have no tokens and stand in every whole block.
    """
    return mix_sources(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; null and empty texts are their end alone, each of repeated rows is packed."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("suffix-array dedup", repeated_passages), ("source mixing", mix), ("best-fit packing", packing)]
#: SQL can express neither the classifier nor the signatures; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
