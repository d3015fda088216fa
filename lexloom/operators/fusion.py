"""Fusion of ranked lists, and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.values import rrf
from lexloom.operators.lexical import DIGITS, ranked


def reciprocal_rank_fusion(keyword: DataFrame, semantic: DataFrame, top_k: int = 10, k: int = 60, key: str = "key") -> DataFrame:
    """Lists (query_id, key, rank, score) to one row a key: fused score, both scores and ranks (null if missing), matched modes.

    Order: fused score, then keyword rank, then semantic rank.  A key that a list has more than once counts each time, its
    last place is kept.  Null and empty keys are left out.
    """
    side = lambda df, mode: df.where(F.coalesce(F.col(key) != "", F.lit(False))).select("query_id", F.col(key).alias("key"), F.lit(mode).alias("mode"), "rank", "score")
    both = side(keyword, "keyword").unionByName(side(semantic, "semantic"))
    of = lambda mode, c: F.max_by(F.when(F.col("mode") == mode, F.col(c)), F.when(F.col("mode") == mode, F.col("rank")))
    first = lambda mode: F.min(F.when(F.col("mode") == mode, F.col("rank")))
    fused = both.groupBy("query_id", "key").agg(
        F.round(F.sum(rrf("rank", k)), DIGITS + 2).alias("score"), of("keyword", "score").alias("keyword_score"), of("semantic", "score").alias("semantic_score"),
        of("keyword", "rank").alias("keyword_rank"), of("semantic", "rank").alias("semantic_rank"), F.array_sort(F.collect_set("mode")).alias("matched_modes"),  # the keyword list comes first
        F.coalesce(first("keyword"), F.lit(1 << 30)).alias("__k"), F.coalesce(first("semantic"), F.lit(1 << 30)).alias("__s"),
    )
    return ranked(fused, top_k, "__k", "__s").drop("__k", "__s")


def outer_merge(keyword: DataFrame, semantic: DataFrame, top_k: int = 10, k: int = 60, key: str = "key", multiply: bool = True) -> DataFrame:
    """The full outer join of both lists by key; several rows of a key on both sides multiply, as joins do."""
    a = keyword.select("query_id", F.col(key).alias("key"), F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score"))
    b = semantic.select("query_id", F.col(key).alias("key"), F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"))
    if not multiply:
        a, b = a.dropDuplicates(["query_id", "key"]), b.dropDuplicates(["query_id", "key"])
    merged = a.where("key is not null").join(b.where("key is not null"), ["query_id", "key"], "full_outer")
    return ranked(merged.withColumn("score", F.round(rrf("keyword_rank", k) + rrf("semantic_rank", k), DIGITS + 2)), top_k, F.col("keyword_rank").asc_nulls_last(), F.col("semantic_rank").asc_nulls_last(), "key")


def zero_filled(keyword: DataFrame, semantic: DataFrame, top_k: int = 10, k: int = 60, key: str = "key") -> DataFrame:
    """Fusion where a missing side has score 0 instead of null."""
    fused = reciprocal_rank_fusion(keyword, semantic, top_k, k, key)
    return fused.fillna(0.0, ["keyword_score", "semantic_score"])


def rerank(results: DataFrame, score: Column | Callable[[DataFrame], Column], top_k: int = 10, window: int = 50) -> DataFrame:
    """The first ``window`` results of each query anew by ``score``; ties keep their order.

    Adds retrieval_score, rerank_score, rerank_rank and reranked.  ``score`` is a column of the results: a built-in
    expression or an Arrow UDF around a model.
    """
    held = results.where(F.col("rank") <= max(top_k, window))
    held = held.withColumnRenamed("rank", "retrieval_rank").withColumn("retrieval_score", F.col("score"))
    held = held.withColumn("rerank_score", score(held) if callable(score) and not isinstance(score, Column) else score).withColumn("score", F.col("rerank_score"))
    return ranked(held, top_k, "retrieval_rank").withColumn("rerank_rank", F.col("rank")).withColumn("reranked", F.lit(True))


def no_rerank(results: DataFrame, top_k: int = 10) -> DataFrame:
    return results.where(F.col("rank") <= top_k)


def token_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """A stand-in for a reranking model: the share of query tokens that the text has."""
    a = F.array_distinct(query_tokens)
    return F.round(F.when(F.size(a) > 0, F.size(F.array_intersect(a, text_tokens)) / F.size(a)).otherwise(0.0), DIGITS)


def with_representatives(fused: DataFrame, keyword: DataFrame, semantic: DataFrame, key: str = "key") -> DataFrame:
    """Fused rows with what is shown of their result: the semantic list's row where it has one, else the keyword list's.

    Both lists have ``key`` and the columns of results; of several rows of a key a list's last one counts.
    """
    from lexloom.operators.lexical import SHOWN

    side = lambda df, first: df.select("query_id", F.col(key).alias("key"), F.struct(F.lit(first).alias("first"), "rank").alias("place"), F.struct(*SHOWN).alias("row"))
    rows = side(keyword, 0).unionByName(side(semantic, 1)).groupBy("query_id", "key").agg(F.max_by("row", "place").alias("row"))
    return fused.join(rows, ["query_id", "key"]).select(*fused.columns, "row.*")
