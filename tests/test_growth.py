"""Steps whose cost grows no faster than the input: what is shuffled, and what a Python worker holds."""

import math
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.functions import counting
from lexloom.functions import text as X
from lexloom.operators import lexical, vectors
from lexloom.plans.registry import QUERIES
from lexloom.sources.articles import documents_table

SF = "/root/testdata/sf0.001"
TEXTS = ["alpha bravo bravo charlie", "alpha delta a_bc a_bc 7 x", "", "alpha Écho bravo rss feed", "golf alpha alpha Trang thông tin điện tử kilo"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def small(spark):
    return documents_table(spark, SF)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, t[:20], t) for k, t in enumerate(TEXTS)]
    blank = ("title_processed", "content_processed", "combined_processed", "combined_unaccented")
    return spark.createDataFrame(rows, "doc_index long, title string, content string").select("*", *(F.lit("").alias(c) for c in blank)).cache()


def brute_vectors(documents, min_df=1):
    held = {r["doc_index"]: Counter(r["t"]) for r in documents.select("doc_index", X.plain_tokens(lexical.index_text()).alias("t")).collect()}
    df = Counter(t for c in held.values() for t in c)
    out = {}
    for d, c in held.items():
        raw = {t: n * (math.log((1 + len(held)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= min_df}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out |= {(d, t): round(x / norm, 6) for t, x in raw.items()}
    return out


@pytest.mark.parametrize(("most", "min_df"), [(1 << 17, 1), (3, 1), (0, 1), (3, 2)])
def test_vectors_of_frequent_and_other_terms(documents, monkeypatch, most, min_df):
    """only the postings of terms that aren't sent to all tasks are shuffled; how many are sent doesn't show in the result."""
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", most)
    found = lexical.TfIdf(lexical.LexicalIndex.build(documents), min_df).vectors()
    assert {(r["doc_index"], r["term"]): round(r["weight"], 6) for r in found.collect()} == brute_vectors(documents, min_df)


@pytest.mark.parametrize("most", [1 << 17, 3])
def test_tfidf_scores(spark, documents, monkeypatch, most):
    """Documents with a term of a query are weighed in one pass; the score is that of their vectors."""
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", most)
    engine = lexical.TfIdf(lexical.LexicalIndex.build(documents))
    asked = spark.createDataFrame([(1, "alpha bravo"), (2, "kilo none"), (3, "")], "query_id long, query string")
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_index", "score").collect())
    want = key(engine.scores(asked, engine.vectors()))
    assert key(engine.scores(asked)) == want and len(want) >= 4
    assert key(engine.hits_among(asked)) == key(engine.hits(asked))


@pytest.mark.parametrize(("name", "most"), [("diagnostics_counts", 1), ("term_frequencies", 0), ("document_lengths", 0), ("document_frequencies", 1), ("vocabulary_index", None), ("inverted_index", 1)])
def test_counted_where_read(spark, name, most):
    """what one document holds is counted without a shuffle; one is left for what terms gather."""
    if most is None:
        assert exchanges(lexical.LexicalIndex.build(small(spark)).terms) == 1
    else:
        assert exchanges(QUERIES[name](spark, SF)) == most


def test_postings_meet_queries_without_shuffle(spark):
    """terms of queries go to the postings; postings aren't shuffled by term."""
    asked = spark.createDataFrame([(1, "that with estion"), (2, "the tion of and ing")], "query_id long, query string")
    hits = lexical.LexicalIndex.build(small(spark))._matches(lexical.select_terms(asked))
    assert "SortMergeJoin" not in plan(hits) and "BroadcastHashJoin" in plan(hits)


def test_okapi_keeps_only_listed_terms(spark):
    """F8: of the postings only those of the query's terms leave the task that counts them."""
    texts = spark.createDataFrame([(0, "the cat the"), (1, "dog cat\x1cx"), (2, None)], "doc_index long, text string")
    engine = lexical.Okapi(texts)
    assert "SortMergeJoin [term" not in plan(engine.scores(spark.createDataFrame([(1, "the CAT")], "query_id long, query string")))
    each = {r["doc_index"]: (r["doc_len"], dict(zip(r["terms"], r["tfs"], strict=True))) for r in counting.by_document(texts, counting.words, ["the", "cat"]).collect()}
    assert each == {0: (3, {"the": 2, "cat": 1}), 1: (2, {}), 2: (0, {})}
    assert [r["term"] for r in counting.document_counts(texts, counting.words).orderBy("term").collect()] == ["cat", "cat\x1cx", "dog", "the"]


def test_counts_as_tokens(spark):
    texts = [*TEXTS, None, "a_b _x_ x__y_1 __ 1 b", "Đường ĐI İx K", "(adsbygoogle = z.push({}); tail http://x.y/z rss carss"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = {(r["k"], r["term"]): r["tf"] for r in counting.by_row(lexical.term_texts(df, F.col("text"), "k")).collect()}
    want = Counter((r["k"], t) for r in df.select("k", X.plain_tokens("text").alias("t")).collect() for t in r["t"] or ())
    assert found == want and (6, "a_b") in found and (7, "duong") in found and (8, "rss") not in found


@pytest.mark.parametrize("by_cell", [False, True])
def test_products_in_bounded_blocks(by_cell):
    """a worker's products take the same memory however many queries there are."""
    rng = np.random.default_rng(1)
    n, q, k = 5000, 20_000, 3
    held, asked = rng.integers(-2, 3, (n, 4)).astype(np.float32), rng.integers(-2, 3, (q, 4)).astype(float)
    cells = np.eye(4)
    probed = np.ones((q, 4), bool)
    probed[:, 0] = False
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(held.tolist(), pa.list_(pa.float32())), pa.array((held @ cells.T).argmax(1).astype(np.int32))], names=["key", "embedding", "cell_id"])
    values = (np.arange(q), asked, probed, cells) if hasattr(vectors, "BLOCK") else (np.arange(q), asked, probed)
    tracemalloc.start()
    (found,) = vectors._products(SimpleNamespace(value=values), "key", k, by_cell)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    among = np.flatnonzero((held @ cells.T).argmax(1) != 0) if by_cell else np.arange(n)
    got = found.to_pydict()
    for one in range(0, q, 4999):
        score = held[among] @ asked[one]
        want = among[np.lexsort((among, -score))[:k]].tolist()
        assert [i for o, i in zip(got["query_id"], got["key"], strict=True) if o == one] == want
