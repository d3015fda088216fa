"""Articles to overlapping windows of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X

SIZE, OVERLAP, LEAST_CHARS = 4, 1, 100


def windows(sentences: Column, title: Column, content: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` sentences, each sharing ``overlap`` with the next; a short text is one window, as it is."""
    n = F.size(sentences)
    lead = F.concat(title, F.lit(". "))
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap)), lambda i: F.concat(lead, F.array_join(F.slice(sentences, i + 1, F.lit(size)), " ")))
    return F.when(n <= size, F.array(F.concat(lead, content))).otherwise(many)


def chunk_articles(articles: DataFrame, *, title: str = "title", content: str = "content", doc_id: str = "doc_id", split: Column | None = None, process=None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Chunk records: doc_id, chunk_id, url, topic, raw_text, chunk_processed, chunk_unaccented.

    Articles of ``least_chars`` characters or fewer are left out.  ``split`` is a column of sentences, ``process`` a
    function from a column to a cleaned one (segmenter and all).
    """
    process = process or (lambda c: F.lower(X.clean_keep_case(c)))
    held = articles.where(F.length(X.as_text(content)) > least_chars).withColumn("__content", F.trim(X.as_text(content))).withColumn("__title", F.trim(X.as_text(title)))
    held = held.withColumn("__sentences", X.sentences("__content") if split is None else split)
    have = lambda c: X.as_text(c) if c in articles.columns else F.lit("")
    out = held.select(F.col(doc_id).cast("string").alias("doc_id"), have("url").alias("url"), have("topic").alias("topic"), F.posexplode(windows(F.col("__sentences"), F.col("__title"), F.col("__content"))).alias("k", "raw_text"))
    out = out.withColumn("chunk_processed", process("raw_text"))
    return out.select("doc_id", F.concat("doc_id", F.lit("_"), F.col("k").cast("string")).alias("chunk_id"), "url", "topic", "raw_text", "chunk_processed", X.strip_accents("chunk_processed").alias("chunk_unaccented"))


def best_per_document(hits: DataFrame) -> DataFrame:
    """One row a document: its best score, and the first values that aren't null in that order."""
    order = F.struct((-F.col("score")).alias("s"), "chunk_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return hits.groupBy("doc_id").agg(F.max("score").alias("score"), *(first(c) for c in ("chunk_id", "topic", "raw_text") if c in hits.columns))
