import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.config import Settings
from lexloom.operators import chunking, fusion, lexical, semantic, serving, vectors
from lexloom.plans.registry import QUERIES
from lexloom.sources import articles as A
from lexloom.streaming.clicks import CLICK, click_counts

NEWS = [
    {"id": 1, "title": "Liverpool vs Strasbourg", "content": "Dự đoán bóng đá Liverpool Strasbourg", "topic": "Thể thao", "source": "a.vn", "crawled_at": 1659344927355, "picture_count": 3},
    {"id": 2, "title": "Cướp tiệm vàng tại Huế", "content": "Đại úy công an cướp tiệm vàng", "topic": "Pháp luật", "source": "", "url": "https://www.b.vn/x", "author": "T.G", "crawled_at": "2022-08-02T00:00:00"},
    {"id": 3, "title": "", "content": "", "topic": "", "source": ""},
]
CHUNKS = [{"doc_id": "22648", "chunk_id": f"22648_{k}", "url": "u", "topic": "Pháp luật", "raw_text": t, "chunk_processed": t.lower(), "chunk_unaccented": t.lower()} for k, t in ((4, "Nguyen Quoc Bao va Minh Hang"), (5, "Nguyen Quoc Bao ra toa"))]


@pytest.fixture(scope="session")
def news(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("news") / "news.json"
    path.write_text(json.dumps(NEWS, ensure_ascii=False))
    return A.load_documents(spark, f"file://{path}").cache()


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, query string")


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("query_id", "rank").select(*cols).collect()]


def test_json_shapes(spark, news, tmp_path):
    by_id = {r["id"]: r for r in news.collect()}
    assert set(by_id) == {"1", "2", "3"}
    assert by_id["1"]["metadata"] == {"picture_count": "3"} and by_id["1"]["crawled_at"] == 1659344927355
    assert by_id["2"]["crawled_at"] is None and by_id["2"]["crawled_text"] == "2022-08-02T00:00:00"
    lines = tmp_path / "news.jsonl"
    lines.write_text("\n\n".join(json.dumps(x) + "," for x in CHUNKS))
    chunks = A.load_documents(spark, f"file://{lines}").orderBy("id").collect()
    assert [c["id"] for c in chunks] == ["22648_4", "22648_5"]
    assert chunks[0]["metadata"] == {"doc_id": "22648", "chunk_id": "22648_4"} and chunks[0]["title"] == CHUNKS[0]["raw_text"]
    assert A.load_documents(spark, f"file://{lines}", limit=0).count() == 1
    assert [r["id"] for r in A.load_documents(spark, f"file://{lines}", limit=1).collect()] == ["22648_4"]
    pretty = tmp_path / "pretty.json"
    pretty.write_text("[\n" + ",\n".join(json.dumps(x) for x in NEWS) + "\n]\n")
    assert [(r["doc_index"], r["id"]) for r in A.load_documents(spark, f"file://{pretty}").orderBy("doc_index").collect()] == [(0, "1"), (1, "2"), (2, "3")]
    nested = tmp_path / "nested.json"
    nested.write_text(json.dumps([{"id": k, "title": "CÃ´ng an", "content": "Huáº¿", "m": {"a": [1]}} for k in range(5)], indent=1, ensure_ascii=False))
    found = A.load_documents(spark, f"file://{nested}", limit=3).orderBy("doc_index").collect()
    assert [r["id"] for r in found] == ["0", "1", "2"] and {(r["title"], r["content"]) for r in found} == {("Công an", "Huế")}


def test_bm25(spark, news):
    engine = lexical.Bm25(lexical.LexicalIndex.build(news))
    found = rows(engine.search(ask(spark, "Liverpool Strasbourg du doan bong da", "cuop tiem vang hue", "", "Vinh cu to")), "query_id", "doc_id", "score", "title")
    assert [(q, d) for q, d, *_ in found] == [(1, "1"), (2, "2")] and all(s > 0 for _, _, s, _ in found)
    assert found[1][3] == "Cướp tiệm vàng tại Huế"
    assert engine.search(ask(spark, "liverpool"), 0).count() == 0
    figures = lexical.LexicalIndex.build(news).figures.first()
    assert figures["n"] == 3


def test_saved_index(spark, news, tmp_path):
    index = lexical.LexicalIndex.build(news)
    index.save(f"file://{tmp_path}/i")
    again = lexical.lexical_engine(" BM25 ", lexical.LexicalIndex.load(spark, f"file://{tmp_path}/i"))
    assert rows(again.search(ask(spark, "liverpool bong da")), "doc_id") == [("1",)]
    with pytest.raises(A.MissingArtifact):
        lexical.LexicalIndex.load(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        lexical.lexical_engine("x", index)


def test_tfidf(spark, news):
    engine = lexical.TfIdf(lexical.LexicalIndex.build(news))
    assert rows(engine.search(ask(spark, "Liverpool Strasbourg bong da", "")), "doc_id") == [("1",)]
    norms = engine.vectors().groupBy("doc_index").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)


def test_vectors(spark):
    held = spark.createDataFrame([(k, [float(k == j) + 0.1 * k for j in range(3)], k % 2) for k in range(3)], "embedding_index long, embedding array<float>, label int")
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "query_id long, vector array<double>")
    assert rows(vectors.Flat(held).search(asked, 2), "embedding_index") == [(1,), (2,)]
    assert rows(vectors.Flat(held).search(asked, 5, label=0), "embedding_index") == [(2,), (0,)]
    cells = vectors.Ivf.train(held, cells=2)
    assert rows(cells.search(asked, 3, probes=2), "embedding_index") == rows(vectors.Flat(held).search(asked, 3), "embedding_index")
    shards = vectors.assign_shards(spark.range(40).withColumnRenamed("id", "v"), "v", shard_rows=17, batch=16)
    assert [r["n"] for r in shards.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()] == [32, 8]
    passages = vectors.embed_passages(spark.createDataFrame([("ab",), (" ",)], "text string"), lambda: lambda xs: [[float(len(x))] for x in xs])
    assert [r["embedding"] for r in passages.collect()] == [[11.0]]


def test_ivf_recall(spark):
    held = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumnRenamed("vec_id", "embedding_index")
    asked = held.where("embedding_index % 50 = 0").select(F.col("embedding_index").alias("query_id"), F.col("embedding").alias("vector"))
    exact = vectors.Flat(held).search(asked, 10).select("query_id", "embedding_index")
    cells = vectors.Ivf.train(held, cells=16)
    assert cells.search(asked, 10, probes=16).select("query_id", "embedding_index").exceptAll(exact).isEmpty()
    recall = {k: exact.intersect(cells.search(asked, 10, probes=k).select("query_id", "embedding_index")).count() / exact.count() for k in (10, 12)}
    assert recall[12] >= 0.9  # what is registered
    if recall[10] < 0.9:
        pytest.xfail(f"recall with 10 of 16 cells is {recall[10]}, not 0.9")


def ranked(spark, *pairs):
    return spark.createDataFrame([(1, k, i, s) for i, (k, s) in enumerate(pairs, 1)], "query_id long, key string, rank int, score double")


def test_fusion(spark):
    fused = fusion.reciprocal_rank_fusion(ranked(spark, ("1", 8.0), ("2", 4.0)), ranked(spark, ("2", 0.9), ("3", 0.8), ("", 0.7)))
    found = rows(fused, "key", "keyword_rank", "semantic_rank", "keyword_score", "semantic_score", "matched_modes")
    assert [f[0] for f in found] == ["2", "1", "3"]
    assert found[0] == ("2", 2, 1, 4.0, 0.9, ["keyword", "semantic"])
    assert rows(fusion.zero_filled(ranked(spark, ("1", 8.0)), ranked(spark, ("2", 0.9))), "keyword_score", "semantic_score") == [(8.0, 0.0), (0.0, 0.9)]
    twice = ranked(spark, ("1", 8.0), ("1", 4.0))
    assert fusion.outer_merge(twice, twice).count() == 4 and fusion.outer_merge(twice, twice, multiply=False).count() == 1


def test_rerank(spark):
    held = ranked(spark, ("1", 3.0), ("2", 1.0)).withColumn("model", F.when(F.col("key") == "1", 0.2).otherwise(0.9))
    found = rows(fusion.rerank(held, F.col("model")), "key", "score", "retrieval_score", "rerank_rank", "reranked")
    assert found == [("2", 0.9, 1.0, 1, True), ("1", 0.2, 3.0, 2, True)]


def test_serving(spark, news):
    hits = spark.createDataFrame([(1, 1, "2", "2_0"), (1, 2, "2", "2_1"), (1, 3, "3", "3_0"), (1, 4, "", ""), (1, 5, "", "")], "query_id long, rank int, doc_id string, chunk_id string")
    left = serving.renumber(serving.one_per_document(hits), "rank")
    assert rows(left, "rank", "chunk_id") == [(1, "2_0"), (2, "3_0"), (3, ""), (4, "")]
    assert rows(serving.page(left, 1, 2), "rank") == [(2,), (3,)]
    with pytest.raises(serving.BadRequest):
        serving.page_bounds(0, 10)
    with pytest.raises(serving.BadRequest):
        serving.search_mode("x")
    assert serving.search_mode(" BM25 ") == "keyword" and serving.candidate_count(0, 10) == 200
    assert serving.resolve_mode("hybrid", False, Settings(hybrid_require_semantic=False)) == "keyword"
    dated = serving.filter_results(news, from_date="2022-08-02").select("id").collect()
    assert sorted(r["id"] for r in dated) == ["2", "3"]
    facets = {(r["facet"], r["value"]): r["count"] for r in serving.facets(news, "doc_index").collect()}
    assert facets == {("category", "Thể thao"): 1, ("category", "Pháp luật"): 1, ("author", "T.G"): 1, ("source", "a.vn"): 1, ("source", "b.vn"): 1}
    assert [r["text"] for r in serving.suggest(news, "tiem vang").collect()] == ["Cướp tiệm vàng tại Huế"]
    assert serving.suggest(news, "").count() == 0
    newest = serving.newest_first(hits.limit(3), F.when(F.col("rank") == 2, "2024-01-01").when(F.col("rank") == 3, ""))
    assert rows(newest, "chunk_id")[0] == ("2_1",)


def test_search_page(spark, news):
    engine = lexical.Bm25(lexical.LexicalIndex.build(news))
    page = serving.search_page(engine, news, ask(spark, "tiem vang"), "tiem vang")
    assert [r["id"] for r in page.results.collect()] == ["2"] and page.total.first()["total"] == 1
    assert serving.search_page(engine, news, ask(spark, "tiem vang"), "tiem vang", category="none").results.count() == 0
    browsed = serving.search_page(engine, news, ask(spark, ""), "", category="Pháp luật")
    assert [r["id"] for r in browsed.results.collect()] == ["2"]
    marked = engine.search(ask(spark, "cuop tiem vang")).select(serving.keyword_highlight(F.array(F.lit("cuop"))).alias("h")).first()["h"]
    assert marked["title"] == ["<em>Cướp</em> tiệm vàng tại Huế"]


def test_search_by_date(spark, news):
    engine = lexical.Bm25(lexical.LexicalIndex.build(news))
    for text, ids in (("tiem vang", ["2"]), ("liverpool", [])):
        page = serving.search_page(engine, news, ask(spark, text), text, from_date="2022-08-02", to_date="2022-08-02")
        assert [r["id"] for r in page.results.collect()] == ids and page.total.first()["total"] == len(ids)
    page = serving.search_page(engine, news, ask(spark, "cong an vang"), "cong an vang", sort="newest")
    row = page.results.first()
    assert row["published_at"] == "2022-08-02T00:00:00" and row["highlight"]["title"] == ["Cướp tiệm <em>vàng</em> tại Huế"]
    assert page.explain["sort"] == "newest" and spark.range(1).select(page.explain["folded_query"].alias("q")).first()["q"] == "cong an vang"
    browsed = serving.search_page(engine, news, ask(spark, ""), "", category="Pháp luật")
    assert browsed.total.first()["total"] == 1 and browsed.results.first()["score"] == 0.0


def test_semantic_and_hybrid(spark, news, tmp_path):
    letters = lambda texts: [[float(t.lower().count(c)) + 0.01 for c in "abcdefgh"] for t in texts]
    path = f"file://{tmp_path}/semantic"
    config = semantic.build_semantic(news, path, lambda: letters, shard_rows=1, cells=2, probes=2)
    assert (config["num_vectors"], config["embedding_dim"], config["index"]) == (2, 8, "cells")  # the blank article is left out
    assert semantic.build_semantic(news, path, lambda: letters, cells=2, probes=2) == config
    assert vectors.shard_totals(vectors.read_shards(spark, f"{path}/shards")).agg(F.sum("n")).first()[0] == 2
    dense = semantic.SemanticEngine.load(spark, path, lambda: letters)
    flat = semantic.SemanticEngine(vectors.Flat(vectors.read_shards(spark, f"{path}/shards").select("embedding_index", "embedding")), dense.rows, lambda: letters)
    for engine in (dense, flat):
        found = rows(engine.search(ask(spark, "dddd", " "), 1), "query_id", "doc_id", "title", "topic")
        assert len(found) == 1 and found[0][0] == 1 and found[0][2] in {n["title"] for n in NEWS}
    keyword = lexical.Bm25(lexical.LexicalIndex.build(news))
    engines = serving.Engines(keyword, flat, semantic.HybridEngine(keyword, flat))
    page = serving.search_page(engines, news, ask(spark, "tiem vang"), "tiem vang", mode="hybrid")
    assert page.mode == "hybrid" and {r["id"] for r in page.results.collect()} == {"1", "2"} and page.total.first()["total"] == 2
    both = {r["doc_id"]: r for r in engines.hybrid.search(ask(spark, "tiem vang"), 5).collect()}
    assert both["2"]["matched_modes"] == ["keyword", "semantic"] and both["1"]["matched_modes"] == ["semantic"] and both["1"]["keyword_score"] is None
    only = serving.Engines(keyword)
    with pytest.raises(serving.NotReady):
        serving.search_page(only, news, ask(spark, "vang"), "vang", mode="semantic")
    loose = serving.Engines(keyword, settings=Settings(hybrid_require_semantic=False))
    assert serving.search_page(loose, news, ask(spark, "vang"), "vang", mode="hybrid").mode == "keyword"
    assert serving.warm_up(engines, ask(spark, "vang"))["semantic_ready"]

    class Loading:
        ready = False

    waiting = serving.search_page(serving.Engines(keyword, Loading(), Loading()), news, ask(spark, "vang"), "vang", mode="semantic")
    assert waiting.loading and waiting.total.first()["total"] == 0 and waiting.results.count() == 0 and waiting.explain is None


def test_pooling_and_reranker(spark):
    states = np.arange(12, dtype=float).reshape(2, 3, 2)
    found = semantic.batched(lambda texts: (states[: len(texts)], np.array([[1, 1, 0], [0, 0, 0]])[: len(texts)]), 2)(["a", "b"])
    assert np.allclose(found[0], np.array([1, 2]) / 5**0.5) and np.allclose(found[1], 0)
    held = ranked(spark, ("1", 3.0), ("2", 1.0)).withColumn("title", F.col("key")).withColumn("topic", F.lit("")).withColumn("snippet", F.lit("s"))
    score = semantic.reranker(lambda: lambda pairs: [float(read.split()[0]) for _, read in pairs], "q")
    assert [k for (k,) in rows(fusion.rerank(held, score), "key")] == ["2", "1"]


def test_shown_values(spark):
    from lexloom.functions import text as X

    row = spark.createDataFrame([("2024-05-06T00:00", " ", "b")], "d string, x string, y string")
    found = row.select(X.display_date("d").alias("a"), X.display_date("x").alias("b"), X.coalesce_columns(row, "none", "x", "y").alias("c"), X.escape_html(F.lit("<b>&<em>x</em>\"'")).alias("d"), X.score_label(F.lit(0.5), F.lit(False), F.lit(None).cast("boolean")).alias("e")).first()
    assert tuple(found) == ("6/5/2024", "Không rõ ngày", "b", "&lt;b&gt;&amp;<em>x</em>&quot;&#39;", "semantic")


def test_chunk_counts(spark):
    texts = [(str(n), "T", " ".join(f"Sentence number {k} is a rather long one here." for k in range(n))) for n in range(3, 9)]
    docs = spark.createDataFrame(texts, "doc_id string, title string, content string")
    counts = {r["doc_id"]: r["count"] for r in chunking.chunk_articles(docs).groupBy("doc_id").count().collect()}
    assert counts == {"3": 1, "4": 1, "5": 2, "6": 2, "7": 2, "8": 3}


def test_click_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows_in = [{"article_id": a, "query": "q", "position": 1, "ts": f"2024-01-01T{h:02d}:05:00"} for a, h in (("1", 0), ("1", 0), ("2", 0), ("1", 1))]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows_in)))
    stream = click_counts(spark.readStream.schema(CLICK).json(f"file://{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("clicks").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["article_id"], r["n"]) for r in spark.table("clicks").collect()) == [("1", 1), ("1", 2), ("2", 1)]


def test_settings():
    found = Settings.from_env({"HYBRID_RRF_K": "10", "RERANKER_ENABLED": "Yes"})
    assert found.hybrid_rrf_k == 10 and found.reranker_enabled and not Settings().reranker_enabled


def nearest(sf, k):
    """The ``k`` vectors of the largest products for every row whose id is divisible by 50."""
    held = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").sort_by("vec_id")
    ids, x = held["vec_id"].to_numpy(), np.array(held["embedding"].to_pylist(), np.float64)
    return {int(i): ids[np.lexsort((ids, -np.round(x @ v, 6)))[:k]].tolist() for i, v in zip(ids, x, strict=True) if i % 50 == 0}


def test_registered_cells(spark):
    want, found = nearest("sf0.001", 10), {}
    for q, v in rows(QUERIES["vector_ivf"](spark, "/root/testdata/sf0.001"), "query_id", "vec_id"):
        found.setdefault(q, []).append(v)
    assert set(found) == set(want) and len(want) == 10
    assert sum(len(set(want[q]) & set(found[q])) for q in want) >= 0.9 * 10 * len(want)


def test_registered_batch(spark):
    found = {}
    for q, v in rows(QUERIES["vector_batch_knn"](spark, "/root/testdata/sf0.001"), "query_id", "vec_id"):
        found.setdefault(q, []).append(v)
    assert found == nearest("sf0.001", 5)


def test_registered_benchmark(spark, tmp_path):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()
    texts = [words[5:], words[:8], words, ["other"]]
    spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert sorted(rows(QUERIES["bm25_benchmark"](spark, f"file://{tmp_path}"), "query_id", "doc_id")) == [(7, 0), (7, 2)]
