"""Semantic and hybrid search: encoders and rerankers as hooks, vectors with their metadata, and engines over both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as X
from lexloom.operators import fusion
from lexloom.operators.lexical import SHOWN, SearchEngine, ranked
from lexloom.operators.vectors import CELLS, PROBES, Flat, Ivf, assign_shards, candidates, embed_passages, read_shards
from lexloom.sources.articles import exists, load_documents, read_config, require, write_config

#: A function from texts to vectors; made once in each task, or once on the driver for queries.
Encoder = Callable[[list[str]], "np.ndarray"]


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of the token states ``[texts, tokens, size]`` where ``mask`` is set, and of length one; texts without a token are zero."""
    weight = mask[..., None].astype(np.float64)
    mean = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return (mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def batched(model: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], size: int = 16) -> Encoder:
    """An encoder from a model that gives token states and mask of a batch of texts."""

    def encode(texts: list[str]) -> np.ndarray:
        parts = [mean_pooled(*model(texts[k : k + size])) for k in range(0, len(texts), size)]
        return np.concatenate(parts) if parts else np.empty((0, 0), np.float32)

    return encode


def query_vectors(queries: DataFrame, make_encoder: Callable[[], Encoder], prefix: str = X.QUERY_PREFIX) -> DataFrame:
    """``(query_id, vector)`` of the queries that aren't blank."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encoded(texts: pd.Series) -> pd.Series:
        encode = make_encoder()
        return pd.Series([[float(x) for x in v] for v in encode([prefix + t for t in texts])], dtype=object)

    asked = queries.select("query_id", F.trim("query").alias("query")).where("query <> ''")
    return asked.select("query_id", encoded("query").alias("vector"))


def reranker(make_model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], query: Column | str = "query") -> Callable[[DataFrame], Column]:
    """A score column of results for ``fusion.rerank``, by a model of pairs of a query and what is read of a result."""

    @F.pandas_udf(T.DoubleType())
    def score(asked: pd.Series, read: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in make_model()(list(zip(asked, read, strict=True)))])

    def column(results: DataFrame) -> Column:
        asked = F.col(query) if isinstance(query, str) and query in results.columns else F.lit(query) if isinstance(query, str) else query
        return score(asked, X.rerank_text("title", "topic", "snippet"))

    return column


def metadata(documents: DataFrame, text_col: str = "content") -> DataFrame:
    """What an index of vectors keeps of each document besides its vector; the chunk's id falls back to the record's."""
    return documents.select(F.col("doc_id"), F.coalesce(F.nullif("chunk_id", F.lit("")), F.col("id")).alias("chunk_id"), "title", "url", "source", "topic", "author", "crawled_at", "crawled_text", F.col(text_col).alias("text"), *(["doc_index"] if "doc_index" in documents.columns else []))


def results(hits: DataFrame, rows: DataFrame, key: str = "embedding_index") -> DataFrame:
    """Hits with what is shown of the row that each vector belongs to."""
    text = X.plain_display("text")
    shown = rows.select(F.col(key), "doc_id", "chunk_id", X.shorten(F.when(X.plain_display("title") != "", X.plain_display("title")).otherwise(text), 120).alias("title"), X.shorten(text, 300).alias("snippet"), X.as_text("url").alias("url"), *(X.plain_display(c).alias(c) for c in ("source", "topic", "author")), "crawled_at", "crawled_text")
    return hits.select("query_id", "rank", "score", key).join(shown, key).select("query_id", "rank", F.col(key).cast("long").alias("doc_index"), "score", *SHOWN)


@dataclass
class SemanticEngine:
    """``index`` finds vectors; ``rows`` are their metadata with the same numbers."""

    index: Flat | Ivf
    rows: DataFrame
    make_encoder: Callable[[], Encoder]
    config: dict = field(default_factory=dict)

    @property
    def ready(self) -> bool:
        return True

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """Results of the queries that aren't blank; a chunk is found once."""
        asked = query_vectors(queries, self.make_encoder, self.config.get("query_prefix", X.QUERY_PREFIX))
        more = max(candidates(top_k), 0) if top_k > 0 else 0
        found = self.index.search(asked, more, probes=self.config.get("probes", PROBES)) if isinstance(self.index, Ivf) else self.index.candidates(asked, more)
        shown = results(found, self.rows, self.index.key)
        chunk = F.coalesce(F.nullif("chunk_id", F.lit("")), F.col("doc_index").cast("string"))
        first = shown.groupBy("query_id", chunk.alias("chunk")).agg(F.min("rank").alias("rank"))
        once = shown.join(first.select("query_id", "rank"), ["query_id", "rank"], "left_semi")
        return ranked(once.withColumnRenamed("rank", "place"), top_k, "place").drop("place").select("query_id", "rank", "doc_index", "score", *SHOWN)

    @classmethod
    def load(cls, spark: SparkSession, path: str, make_encoder: Callable[[], Encoder]) -> SemanticEngine:
        require(spark, f"{path}/config", f"{path}/shards")
        config = read_config(spark, f"{path}/config")
        rows = read_shards(spark, f"{path}/shards")
        index = Ivf.load(spark, f"{path}/cells") if config["index"] == "cells" else Flat(rows.select("embedding_index", "embedding"))
        return cls(index, rows.drop("embedding"), make_encoder, config)


def build_semantic(documents: DataFrame, path: str, make_encoder: Callable[[], Encoder], *, text_col: str = "content", cells: int = 0, probes: int = PROBES, shard_rows: int = 10_000, model: str = "", normalized: bool = True) -> dict:
    """Vectors and metadata of all documents with a text, in shards, the index in cells if wanted, and the settings; returns them.

    Nothing that is there is written again: a second call with the same path only does what a first one left undone.
    """
    spark = documents.sparkSession
    if not exists(spark, f"{path}/shards/_SUCCESS"):
        held = embed_passages(metadata(documents, text_col), make_encoder)
        shards = assign_shards(held, "doc_index", shard_rows).drop("doc_index")
        shards.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/shards")
    rows = read_shards(spark, f"{path}/shards")
    if cells and not exists(spark, f"{path}/cells/centroids/_SUCCESS"):
        Ivf.train(rows.select("embedding_index", "embedding"), cells or CELLS).save(f"{path}/cells")
    n, dim = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    # The keys of the settings.
    config = {"model_name": model, "text_column": text_col, "document_prefix": X.PASSAGE_PREFIX, "query_prefix": X.QUERY_PREFIX, "normalize_embeddings": normalized, "index": "cells" if cells else "flat", "cells": cells, "probes": probes, "embedding_dim": dim or 0, "num_vectors": n}
    write_config(spark, config, f"{path}/config")
    return config


def build_semantic_from(spark: SparkSession, data: str, path: str, make_encoder: Callable[[], Encoder], limit: int | None = None, **options) -> dict:
    """``build_semantic`` of a JSON file."""
    return build_semantic(load_documents(spark, data, limit), path, make_encoder, **options)


@dataclass
class HybridEngine:
    """Reciprocal rank fusion of two engines, each asked for ``multiplier`` times as many results."""

    keyword: SearchEngine
    semantic: SearchEngine
    k: int = 60
    multiplier: int = 5

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """Results with ``matched_modes`` and both sides' scores and ranks; a result is shown as the semantic list has it."""
        each = max(self.multiplier * top_k, top_k)
        lists = [e.search(queries, each).withColumn("key", X.result_key("chunk_id", "doc_id")) for e in (self.keyword, self.semantic)]
        fused = fusion.reciprocal_rank_fusion(*lists, top_k, self.k)
        shown = fusion.with_representatives(fused, *lists)
        return shown.withColumn("doc_index", F.lit(None).cast("long")).select("query_id", "rank", "doc_index", "score", *SHOWN, "matched_modes", "keyword_score", "semantic_score", "keyword_rank", "semantic_rank")
