"""The registered queries, one for each operator family, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import values as V
from lexloom.functions.repair import fix_mojibake, highlighted
from lexloom.operators import chunking, fusion, lexical, profile, semantic, serving, vectors
from lexloom.sources.articles import documents_table, with_index
from lexloom.streaming.clicks import click_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TERMS = ("that with estion", "the tion of and ing", "und der einer heit", "que en la de", "estion", "to of a b")
#: A range of days that some of the events lie in.
DATES = ("2024-01-02", "2024-01-02")
STOPWORDS = ("the", "of", "and", "to", "a", "in", "der", "die", "und", "de", "la", "que", "et", "le")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, query string")


def index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    return lexical.LexicalIndex.build(documents_table(spark, sf_dir))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", F.col("doc_index").alias("doc_id"), "score")


def dated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the time of the event of the same number, in milliseconds, and a label as author."""
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_index"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("crawled_at"))
    authors = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc_index"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"))
    docs = documents_table(spark, sf_dir).drop("crawled_at", "crawled_text").join(times, "doc_index", "left").join(authors, "doc_index", "left")
    return docs.withColumn("author", X.as_text("label")).withColumn("crawled_text", F.lit(None).cast("string")).drop("label")


def bm25_list(spark: SparkSession, sf_dir: str, k: int = 200, text: str = TERMS[1]) -> DataFrame:
    return lexical.Bm25(index(spark, sf_dir)).hits(batch(spark, text), k)


def dated_engine(spark: SparkSession, sf_dir: str) -> lexical.Bm25:
    return lexical.Bm25(lexical.LexicalIndex.build(dated_documents(spark, sf_dir)))


def dated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25_list(spark, sf_dir).select("query_id", "rank", "doc_index", "score")
    return hits.join(dated_documents(spark, sf_dir), "doc_index")


def query_vectors(spark: SparkSession, sf_dir: str, *ids: int) -> DataFrame:
    held = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids))
    return held.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that searches of many ask with: every row whose id is divisible by 50."""
    held = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0)
    return held.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "embedding_index")


# --- text -------------------------------------------------------------------------------------------------------


@query
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.Bm25(index(spark, sf_dir)).search(batch(spark, TERMS[0]))
    return found.select("query_id", "rank", F.col("doc_index").alias("doc_id"), "score", "title", "snippet")


@query
def scan_project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_table(spark, sf_dir).select(F.col("doc_index").alias("doc_id"), "title", F.substring("content", 1, 300).alias("summary"), F.col("topic").alias("category"), "source")


@query
def record_shape_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = table(spark, sf_dir, "events").select("event_id", F.json_object_keys("props").alias("keys"))
    return props.select("event_id", F.array_join(F.sort_array("keys"), ",").alias("keys"), F.coalesce(F.array_contains("keys", "chunk_id"), F.lit(False)).alias("is_chunk"))


@query
def strip_accents_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.fold("text").cast("binary")).alias("folded"))


@query
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


@query
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_boilerplate(X.fold("html")).cast("binary")).alias("left_over"))


@query
def clean_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_display("text", 300).alias("shown"), X.chunk_title("text").alias("title"))


@query
def mojibake_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.mojibake_score("text").cast("long").alias("marks"))


#: Broken texts and what they are repaired to.
BROKEN = (("CÃ´ng an HuÃª", "Công an Huê"), ("cÆ°á»›p tiá»‡m", "cướp tiệm"), ("Ärzte über Äpfel", "Ärzte über Äpfel"), ("Huáº¿ â€“ tin", "Huế – tin"), ("plain", "plain"), ("", ""))


@query
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired texts of all documents and of broken samples, whose ids are negative; those without a mark don't go through Python."""
    samples = spark.createDataFrame([(-k, text) for k, (text, _) in enumerate(BROKEN, 1)], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(samples)
    return docs.select("doc_id", F.md5(fix_mojibake("text").cast("binary")).alias("repaired"))


@query
def clean_keep_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.clean_keep_case("html", dates=False).cast("binary")).alias("cleaned"))


@query
def date_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(X.date_marks("text"), F.lit("DATE[0-9]+")).cast("long").alias("marks"))


@query
def remove_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.remove_stopwords("text", list(STOPWORDS)).cast("binary")).alias("left_over"))


@query
def word_counts_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe(table(spark, sf_dir, "documents"), X.word_count("text"))


@query
def word_count_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count("text").cast("long").alias("n")).where("n > 5 and n < 2500")


@query
def topic_source_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.canonical_topic("lang").alias("topic"), X.canonical_source("source").alias("source"))


@query
def source_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.source_from_url("url").alias("host"))


@query
def normalize_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events").select("event_id", V.timestamp_text(ms).alias("published_at"), V.date_text(F.floor(ms / 1000).cast("double")).alias("day"))


@query
def rerank_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_table(spark, sf_dir).select(F.col("doc_index").alias("doc_id"), X.rerank_text("title", "topic", X.clean_display("content", 300)).alias("read"))


@query
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_articles(documents_table(spark, sf_dir))
    return chunks.select("doc_id", "chunk_id", F.length("raw_text").cast("long").alias("n_chars"), F.md5(F.col("raw_text").cast("binary")).alias("raw"))


# --- lexical ----------------------------------------------------------------------------------------------------


@query
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = lexical.term_frequencies(documents_table(spark, sf_dir), lexical.index_text())
    return tf.select(F.col("doc_index").alias("doc_id"), "term", "tf")


@query
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = index(spark, sf_dir)
    return held.terms.crossJoin(F.broadcast(held.figures)).select("term", "df", F.round(V.bm25_idf(F.col("n"), F.col("df")), 6).alias("idf"), F.round(V.smooth_idf(F.col("n"), F.col("df")), 6).alias("smooth"))


@query
def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_table(spark, sf_dir)
    return docs.select(F.col("doc_index").alias("doc_id"), F.size(X.plain_tokens(lexical.index_text())).cast("long").alias("doc_len"))


@query
def corpus_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).figures.select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_table(spark, sf_dir)
    ids = lexical.presence_index(lexical.term_frequencies(docs, F.col("content")))
    return ids.select("term", "block", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary")).alias("ids"))


@query
def vocabulary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.vocabulary(index(spark, sf_dir).terms, min_df=5).select("term", "df", "term_index")


@query
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(lexical.Bm25(index(spark, sf_dir)).hits(batch(spark, *TERMS)))


@query
def bm25_min_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have enough of each query's terms."""
    scores = lexical.Bm25(index(spark, sf_dir)).scores(batch(spark, *TERMS))
    return scores.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.max("matched").alias("most_matched"))


@query
def bm25_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every benchmark item as a query."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _hits(lexical.Bm25(index(spark, sf_dir)).hits(items, 5))


@query
def bm25_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_table(spark, sf_dir)
    return _hits(lexical.Okapi(docs.select("doc_index", F.lower("content").alias("text"))).hits(batch(spark, *TERMS[:4])))


@query
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.TfIdf(index(spark, sf_dir)).vectors().select(F.col("doc_index").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(lexical.TfIdf(index(spark, sf_dir)).hits(batch(spark, *TERMS)))


@query
def tfidf_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(lexical.TfIdf(index(spark, sf_dir)).hits_among(batch(spark, *TERMS[:2])))


# --- vectors and fusion -----------------------------------------------------------------------------------------


@query
def vector_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.Flat(vector_table(spark, sf_dir)).search(query_vectors(spark, sf_dir, 0))
    return found.select("query_id", "rank", F.col("embedding_index").alias("vec_id"), "score")


@query
def vector_min_score_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.Flat(vector_table(spark, sf_dir)).search(query_vectors(spark, sf_dir, 1), min_score=0.1, label=0)
    return found.select("query_id", "rank", F.col("embedding_index").alias("vec_id"), "score", "label")


@query
def vector_batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.Flat(vector_table(spark, sf_dir)).search(query_set(spark, sf_dir), 5)
    return found.select("query_id", "rank", F.col("embedding_index").alias("vec_id"), "score")


@query
def vector_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: 12 of 16 cells."""
    cells = vectors.Ivf.train(vector_table(spark, sf_dir), cells=16)
    return cells.search(query_set(spark, sf_dir), 10, probes=12).select("query_id", "rank", F.col("embedding_index").alias("vec_id"), "score")


@query
def vector_ivf_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all cells probed the search is exact."""
    cells = vectors.Ivf.train(vector_table(spark, sf_dir), cells=16)
    return cells.search(query_set(spark, sf_dir), 10, probes=16).select("query_id", "rank", F.col("embedding_index").alias("vec_id"), "score")


@query
def semantic_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits with the documents of the same number as their rows."""
    found = vectors.Flat(vector_table(spark, sf_dir).select("embedding_index", "embedding")).candidates(query_set(spark, sf_dir), 3)
    rows = semantic.metadata(documents_table(spark, sf_dir)).withColumnRenamed("doc_index", "embedding_index")
    return semantic.results(found, rows).select("query_id", "rank", "doc_id", "score", "title", "snippet", "topic")


@query
def embedding_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = vectors.assign_shards(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", shard_rows=100)
    return held.groupBy("shard").agg(F.count("*").alias("n"), F.min("embedding_index").alias("first"), F.max("embedding_index").alias("last"))


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keyword = bm25_list(spark, sf_dir, 50).select("query_id", F.col("doc_index").cast("string").alias("key"), "rank", "score")
    found = vectors.Flat(vector_table(spark, sf_dir)).candidates(query_vectors(spark, sf_dir, 0), 50)
    return keyword, found.select(F.lit(1).cast("long").alias("query_id"), F.col("embedding_index").cast("string").alias("key"), "rank", "score")


@query
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(*_two_lists(spark, sf_dir), 20)
    return fused.select("rank", "key", "score", "keyword_score", "semantic_score", "keyword_rank", "semantic_rank", F.array_join("matched_modes", ",").alias("modes"))


@query
def hybrid_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.outer_merge(*_two_lists(spark, sf_dir), 20).select("rank", "key", "score", "keyword_score", "semantic_score")


@query
def hybrid_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.zero_filled(*_two_lists(spark, sf_dir), 20).select("rank", "key", "score", "keyword_score", "semantic_score")


@query
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.Bm25(index(spark, sf_dir)).search(batch(spark, TERMS[1]), 50)
    score = fusion.token_overlap(X.tokens(F.lit(TERMS[1])), X.tokens(X.rerank_text("title", "topic", "snippet")))
    return fusion.rerank(found, score, 10).select("rank", F.col("doc_index").alias("doc_id"), "retrieval_score", "rerank_score")


# --- serving ----------------------------------------------------------------------------------------------------


@query
def filter_facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.filter_results(dated_hits(spark, sf_dir), category="en", source="src3").select("rank", F.col("doc_index").alias("doc_id"), "score")


@query
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = dated_documents(spark, sf_dir)
    return serving.filter_results(held, from_date=DATES[0], to_date=DATES[1]).select(F.col("doc_index").alias("doc_id"), V.date_text("crawled_at").alias("day"))


@query
def dedupe_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each document among chunks ranked by length."""
    chunks = chunking.chunk_articles(documents_table(spark, sf_dir)).withColumn("query_id", F.lit(1)).withColumn("rank", F.struct((-F.length("raw_text")).alias("n"), "chunk_id"))
    return serving.one_per_document(chunks).select("doc_id", "chunk_id")


@query
def best_chunk_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_articles(documents_table(spark, sf_dir)).withColumn("score", F.length("raw_text").cast("double"))
    return chunking.best_per_document(chunks).select("doc_id", "score", "chunk_id", "topic")


@query
def newest_prefix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = serving.newest_first(serving.cut(dated_hits(spark, sf_dir), 20), V.date_text("crawled_at"))
    return left.select("rank", F.col("doc_index").alias("doc_id"), V.date_text("crawled_at").alias("day"))


@query
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.page(bm25_list(spark, sf_dir), 10, 10).select("rank", F.col("doc_index").alias("doc_id"), "score")


@query
def facets_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.facets(dated_hits(spark, sf_dir))


@query
def facets_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.facets(dated_documents(spark, sf_dir), "doc_index")


@query
def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.browse(documents_table(spark, sf_dir), category="en", offset=10, page_size=10).select("rank", F.col("doc_index").alias("doc_id"), "title")


@query
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.suggest(documents_table(spark, sf_dir), "the tion").select("text", "type", "weight", F.col("doc_index").alias("doc_id"))


@query
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.Bm25(index(spark, sf_dir)).search(batch(spark, TERMS[1]))
    return found.select("rank", F.col("doc_index").alias("doc_id"), highlighted("snippet", X.tokens(F.lit(TERMS[1]))).alias("summary"))


@query
def search_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.search_page(dated_engine(spark, sf_dir), dated_documents(spark, sf_dir), batch(spark, TERMS[1]), TERMS[1], number=2, category="en")
    return found.results.select("rank", "id", "score", "category", "source", "published_at", F.col("highlight.summary")[0].alias("marked"))


@query
def search_payload_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the results of a range of days."""
    found = serving.search_page(dated_engine(spark, sf_dir), dated_documents(spark, sf_dir), batch(spark, TERMS[1]), TERMS[1], from_date=DATES[0], to_date=DATES[1])
    return found.results.select("rank", "id", "score", "published_at")


@query
def search_total_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search_page(dated_engine(spark, sf_dir), dated_documents(spark, sf_dir), batch(spark, TERMS[1]), TERMS[1], from_date=DATES[0], to_date=DATES[1]).total


@query
def search_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page by date of what the cut leaves."""
    found = serving.search_page(dated_engine(spark, sf_dir), dated_documents(spark, sf_dir), batch(spark, TERMS[1]), TERMS[1], sort="newest", page_size=20)
    return found.results.select("rank", "id", "score", "published_at")


@query
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of keyword and vector results fused; a stand-in encoder makes the query vector 0 of any text."""
    keyword = lexical.Bm25(index(spark, sf_dir))
    rows = semantic.metadata(documents_table(spark, sf_dir)).withColumnRenamed("doc_index", "embedding_index")
    flat = vectors.Flat(vector_table(spark, sf_dir).select("embedding_index", "embedding"))
    first = [float(x) for x in query_vectors(spark, sf_dir, 0).first()["vector"]]
    dense = semantic.SemanticEngine(flat, rows, lambda: lambda texts: [first for _ in texts])
    engines = serving.Engines(keyword, dense, semantic.HybridEngine(keyword, dense))
    found = serving.search_page(engines, documents_table(spark, sf_dir), batch(spark, TERMS[1]), TERMS[1], mode="hybrid", page_size=20)
    return found.results.select("rank", "id", "score", "category")


@query
def browse_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search_page(lexical.Bm25(index(spark, sf_dir)), documents_table(spark, sf_dir), batch(spark, ""), "", category="en").total


# --- reports ----------------------------------------------------------------------------------------------------


@query
def eda_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(table(spark, sf_dir, "documents"))


@query
def eda_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "documents"), "source", 12)


@query
def eda_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.daily_counts(table(spark, sf_dir, "events"), F.col("ts"))


@query
def eda_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "documents"), X.word_count("text"))


@query
def diagnostics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = index(spark, sf_dir)
    return profile.index_figures(held.documents, held.terms, table(spark, sf_dir, "embeddings"))


@query
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles over 100 characters, numbered anew."""
    held = table(spark, sf_dir, "documents").where(F.length("text") > 100).select("doc_id")
    return with_index(held, "doc_id", name="new_id")


@query
def click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = click_counts(table(spark, sf_dir, "events").where("event_type = 'click'"), by="user_id")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "user_id", "n")
