"""Reports on a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, nulls, blanks)`` in one pass."""
    aggs = []
    for name, kind in df.dtypes:
        aggs.append(F.count_if(F.col(name).isNull()).alias(f"n:{name}"))
        aggs.append((F.count_if(F.trim(name) == "") if kind == "string" else F.lit(0).cast("long")).alias(f"b:{name}"))
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`n:{c}`").alias("nulls"), F.col(f"`b:{c}`").alias("blanks")) for c in df.columns))).alias("x")).select("x.*")


def describe(df: DataFrame, value: Column) -> DataFrame:
    v = df.select(value.cast("double").alias("v"))
    q = lambda p: F.round(F.percentile("v", F.lit(p)), 6)
    return v.agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev("v"), 6).alias("std"), F.min("v").alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("v").alias("most"))


def value_counts(df: DataFrame, column: str, most: int) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def daily_counts(df: DataFrame, time: Column) -> DataFrame:
    return df.select(F.to_date(time).alias("d")).where("d is not null").groupBy(F.date_format("d", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, bins: int = 60) -> DataFrame:
    """``(bin, n)``: bins of equal width from the least to the greatest value, which belongs to the last one."""
    v = df.select(value.cast("double").alias("v"))
    edges = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    placed = v.crossJoin(F.broadcast(edges))  # one row
    spot = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))).otherwise(0)
    return placed.groupBy(spot.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def index_figures(documents: DataFrame, terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(artifact, n)`` of the tables that searches use; a term has as many postings as documents."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "n")
    both = terms.agg(F.count("*").alias("v"), F.coalesce(F.sum("df"), F.lit(0)).alias("p"))
    pairs = F.array(*(F.struct(F.lit(name).alias("artifact"), F.col(c).alias("n")) for name, c in (("vocabulary", "v"), ("postings", "p"))))
    return count(documents, "documents").unionAll(both.select(F.inline(pairs))).unionAll(count(vectors, "vectors"))


def inspect_artifacts(spark, **paths: str) -> dict:
    """Which of the tables are there, and which are missing."""
    from lexloom.sources.articles import exists

    missing = [name for name, path in paths.items() if not exists(spark, path)]
    return {"ready": not missing, "missing": missing, "paths": dict(paths)}
