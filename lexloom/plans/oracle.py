"""DuckDB SQL for the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

from lexloom.functions.text import BOILERPLATE_PATTERNS, MOJIBAKE_MARKERS, NO_SOURCE, NO_TOPIC
from lexloom.plans.registry import BROKEN, DATES, STOPWORDS, TERMS

_DOLLAR = "$$"


def _q(s: str) -> str:
    return f"{_DOLLAR}{s}{_DOLLAR}"


def fold(x: str) -> str:
    return f"replace(strip_accents(replace(lower({x}), 'đ', 'd')), 'đ', 'd')"


def boilerplate(x: str) -> str:
    for p in BOILERPLATE_PATTERNS:
        x = f"regexp_replace({x}, {_q(p)}, ' ', 'gis')"
    return x


def tokens(x: str) -> str:
    found = f"regexp_extract_all({boilerplate(fold(x))}, '[0-9a-zA-Z_]+')"
    kept = f"list_filter({found}, lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]$'))"
    return f"flatten(list_transform({kept}, lambda t: CASE WHEN contains(t, '_') THEN list_concat([t], list_filter(string_split(t, '_'), lambda p: length(p) > 1)) ELSE [t] END))"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x{{0085}}\p{{Z}}]+', ' ', 'g'), ' ')"


def shorten(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN rtrim({x}[1:{n}], ' ') || '...' ELSE {x} END"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '[\s\x{{0085}}\p{{Z}}]+'), lambda w: w <> '')"


DOCS = f"""docs AS (
  SELECT doc_id, {shorten("c", 120)} AS title, coalesce(text, '') AS content, {shorten("c", 300)} AS snippet, coalesce(lang, '') AS topic, coalesce(source, '') AS source
  FROM (SELECT *, {collapse("text")} AS c FROM documents))"""
INDEX = f"""{DOCS}, tf AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, unnest({tokens("concat_ws(' ', CASE WHEN trim(title) <> '' THEN concat_ws(' ', title, title, title) END, CASE WHEN trim(content) <> '' THEN content END)")}) AS term FROM docs) GROUP BY ALL
), lengths AS (SELECT d.doc_id, coalesce(sum(tf), 0)::BIGINT AS doc_len FROM docs d LEFT JOIN tf USING (doc_id) GROUP BY 1),
figures AS (SELECT count(*)::BIGINT AS n, avg(doc_len) AS avgdl FROM lengths),
terms AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1)"""


def asked(*texts: str) -> str:
    return "q AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {_q(t)})" for k, t in enumerate(texts, 1)) + ") AS t(query_id, query))"


QUERY_TERMS = f"""qp AS (
  SELECT query_id, term, min(i)::BIGINT AS position FROM (SELECT query_id, unnest(ts) AS term, unnest(range(len(ts))) AS i FROM (SELECT query_id, {tokens("query")} AS ts FROM q)) GROUP BY ALL
), qn AS (SELECT query_id, count(*) AS nd, count(*) FILTER (WHERE length(term) >= 3) AS nl FROM qp GROUP BY 1),
qs AS (SELECT query_id, term, position FROM qp JOIN qn USING (query_id) WHERE nd <= 1 OR (NOT (nd >= 3 AND nl < 2) AND (nl = 0 OR length(term) >= 3))),
qm AS (SELECT query_id, count(*) AS nt FROM qs GROUP BY 1)"""
_WEIGHT = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl))"
BM25 = f"""{QUERY_TERMS}, scored AS (
  SELECT query_id, doc_id, round(sum({_WEIGHT}), 6) AS score, count(*) AS matched, min(position) AS first, any_value(nt) AS nt
  FROM tf JOIN qs USING (term) JOIN terms USING (term) JOIN lengths USING (doc_id) JOIN qm USING (query_id), figures GROUP BY ALL
), enough AS (SELECT * FROM scored WHERE matched >= CASE WHEN nt <= 1 THEN nt ELSE ceil(nt * 0.7::DOUBLE) END AND score > 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id)::INTEGER AS rank FROM enough)"""


def bm25(select: str, *texts: str, query: str | None = None, more: str = "") -> str:
    return f"WITH {INDEX}, {query or asked(*texts)}, {BM25}{', ' + more if more else ''} {select}"


TFIDF = """idf AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM terms, figures),
dv AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM (
  SELECT doc_id, term, tf::DOUBLE / max(tf) OVER (PARTITION BY doc_id) * idf AS raw FROM tf JOIN idf USING (term)))"""
TFIDF_QUERY = f"""{TFIDF}, qc AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({tokens("query")}) AS term FROM q) GROUP BY ALL),
qv AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS w FROM (
  SELECT query_id, term, tf::DOUBLE / max(tf) OVER (PARTITION BY query_id) * idf AS raw FROM qc JOIN idf USING (term))),
scored AS (SELECT query_id, doc_id, round(sum(w * weight), 6) AS score FROM qv JOIN dv USING (term) GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


def knn(ids: str, k: int, where: str = "true", columns: str = "") -> str:
    return f"""WITH c AS (
  SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE {ids}
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score{columns} FROM r WHERE place <= {max(5 * k, 50)} AND {where}
QUALIFY rank <= {k}"""


LISTS = """k AS (SELECT doc_id::VARCHAR AS key, rank, score FROM hits WHERE rank <= 50),
s AS (SELECT vec_id::VARCHAR AS key, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank, score FROM (
  SELECT v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0) QUALIFY rank <= 50),
f AS (SELECT coalesce(k.key, s.key) AS key, k.score AS keyword_score, s.score AS semantic_score, k.rank AS keyword_rank, s.rank AS semantic_rank,
  round(coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 8) AS score FROM k FULL JOIN s ON k.key = s.key),
g AS (SELECT *, row_number() OVER (ORDER BY score DESC, coalesce(keyword_rank, 1000000), coalesce(semantic_rank, 1000000))::INTEGER AS rank FROM f)"""
DATED = """dated AS (
  SELECT d.*, e.ts, coalesce('q' || l.quality, '') AS author, coalesce(strftime(e.ts, '%Y-%m-%d'), '') AS day
  FROM docs d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
SENTENCES = r"list_filter(list_transform(regexp_extract_all({x}, '[^.!?\n]+[.!?]*'), lambda s: trim(s, ' ')), lambda s: s <> '')"
CHUNKS = f"""{DOCS}, cut AS (
  SELECT doc_id::VARCHAR AS doc_id, topic, trim(title, ' ') AS title, trim(content, ' ') AS content, {SENTENCES.format(x="trim(content, ' ')")} AS ss FROM docs WHERE length(content) > 100
), listed AS (SELECT doc_id, topic, CASE WHEN len(ss) <= 4 THEN [title || '. ' || content]
    ELSE list_transform(range(0, greatest(len(ss) - 1, 1), 3), lambda i: title || '. ' || array_to_string(ss[i + 1 : i + 4], ' ')) END AS cs FROM cut),
chunks AS (SELECT doc_id, topic, doc_id || '_' || i AS chunk_id, raw_text FROM (SELECT doc_id, topic, unnest(cs) AS raw_text, unnest(range(len(cs))) AS i FROM listed))"""


def facets(source: str, order: str) -> str:
    return f"""SELECT facet, value, count, place FROM (
  SELECT facet, value, count, row_number() OVER (PARTITION BY facet ORDER BY count DESC, first, value)::INTEGER AS place FROM (
    SELECT facet, value, count(*)::BIGINT AS count, min(o) AS first FROM (
      SELECT 'category' AS facet, topic AS value, {order} AS o FROM {source} UNION ALL SELECT 'author', author, {order} FROM {source} UNION ALL SELECT 'source', source, {order} FROM {source}
    ) WHERE value <> '' GROUP BY ALL)) WHERE place <= 20"""


_DATED_HITS = f"{DATED}, dh AS (SELECT h.rank, h.score, d.* FROM hits h JOIN dated d USING (doc_id) WHERE h.rank <= 200)"
_MARKS = " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) // {len(m)}" for m in MOJIBAKE_MARKERS)
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), 'http[^\s\x{0085}\p{Z}]+', ' ', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', ' ', 'g')"
_PUNCTUATION = r"""[!"#$%&'()*+,./:;<=>?@\[\\\]^`{|}~]"""

_MARKED = f"regexp_replace(snippet, {_q(chr(92) + 'b(' + '|'.join(sorted(TERMS[1].split(), key=len, reverse=True)) + ')' + chr(92) + 'b')}, {_q('<em>' + chr(92) + '1</em>')}, 'gi')"
_PUBLISHED = "coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '') AS published_at"
_IN_RANGE = f"SELECT row_number() OVER (ORDER BY h.rank)::INTEGER AS rank, doc_id::VARCHAR AS id, score, {_PUBLISHED} FROM hits h JOIN dated USING (doc_id) WHERE h.rank <= 200 AND (day = '' OR (day >= '{DATES[0]}' AND day <= '{DATES[1]}'))"


def _dates(x: str) -> str:
    """Marks of dates: day, month and year first, then day and month; single digits are padded."""
    pad = {1: "0", 2: ""}
    for d in (2, 1):
        for m in (2, 1):
            for y, century in ((4, ""), (3, ""), (2, "20")):
                x = rf"regexp_replace({x}, '\b(\d{{{d}}})[-/.](\d{{{m}}})[-/.](\d{{{y}}})\b', ' DATE{century}\3{pad[m]}\2{pad[d]}\1 ', 'g')"
    for d in (2, 1):
        for m in (2, 1):
            x = rf"regexp_replace({x}, '\b(\d{{{d}}})[-/.](\d{{{m}}})\b', ' DATE{pad[m]}\2{pad[d]}\1 ', 'g')"
    return x


ORACLE = {
    "bm25_search": bm25("SELECT query_id, rank, doc_id, score, title, snippet FROM hits JOIN docs USING (doc_id) WHERE rank <= 10", TERMS[0]),
    "scan_project_documents": f"WITH {DOCS} SELECT doc_id, title, content[1:300] AS summary, topic AS category, source FROM docs",
    "record_shape_split": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, coalesce(list_contains(json_keys(props), 'chunk_id'), false) AS is_chunk FROM events",
    "strip_accents_fold": f"SELECT doc_id, md5({fold('text')}) AS folded FROM documents",
    "normalize_tokens": f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "boilerplate_strip": f"SELECT page_id, md5({boilerplate(fold('html'))}) AS left_over FROM pages",
    "clean_display": f"WITH {DOCS} SELECT doc_id, snippet AS shown, title FROM docs",
    "mojibake_score": f"SELECT doc_id, ({_MARKS})::BIGINT AS marks FROM documents",
    "clean_keep_case": f"SELECT page_id, md5({collapse(f'regexp_replace({_CLEAN}, {_q(_PUNCTUATION)}, {_q(chr(32))}, {_q(chr(103))})')}) AS cleaned FROM pages",
    "remove_stopwords": f"SELECT doc_id, md5(array_to_string(list_filter({words('text')}, lambda w: lower(w) NOT IN ({_STOP})), ' ')) AS left_over FROM documents",
    "word_counts_describe": f"""SELECT count(v)::BIGINT AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS least, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS q3, max(v) AS most FROM (SELECT len({words('text')})::DOUBLE AS v FROM documents)""",
    "word_count_range": f"SELECT * FROM (SELECT doc_id, len({words('text')})::BIGINT AS n FROM documents) WHERE n > 5 AND n < 2500",
    "topic_source_canonical": f"""SELECT doc_id, CASE WHEN lang IS NULL OR lang IN ('Unknown', 'None', '', '{NO_TOPIC}') THEN '{NO_TOPIC}' ELSE upper(trim(lang)[1:1]) || lower(trim(lang)[2:]) END AS topic,
  lower(trim(CASE WHEN source IS NULL OR source IN ('', 'Unknown') THEN '{NO_SOURCE}' ELSE source END)) AS source FROM documents""",
    "source_from_url": "SELECT page_id, coalesce(replace(string_split(url, '/')[3], 'www.', ''), '') AS host FROM pages",
    "normalize_timestamp": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS published_at, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "rerank_document_text": f"WITH {DOCS} SELECT doc_id, concat_ws(chr(10), nullif(title, ''), 'Chuyen muc: ' || nullif(topic, ''), nullif(snippet, ''))[1:1200] AS read FROM docs",
    "chunk_windows": f"WITH {CHUNKS} SELECT doc_id, chunk_id, length(raw_text)::BIGINT AS n_chars, md5(raw_text) AS raw FROM chunks",
    "term_frequencies": f"WITH {INDEX} SELECT doc_id, term, tf FROM tf",
    "document_frequencies": f"WITH {INDEX} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf, round(ln((1 + n)::DOUBLE / (1 + df)) + 1, 6) AS smooth FROM terms, figures",
    "document_lengths": f"WITH {INDEX} SELECT doc_id, doc_len FROM lengths",
    "corpus_figures": f"WITH {INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM figures",
    "inverted_index": f"""WITH {DOCS}, p AS (SELECT DISTINCT doc_id, unnest({tokens('content')}) AS term FROM docs)
SELECT term, (doc_id // 65536)::BIGINT AS block, count(*)::BIGINT AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids FROM p GROUP BY ALL""",
    "vocabulary_index": f"WITH {INDEX} SELECT term, df, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_index FROM terms WHERE df >= 5",
    "bm25_batch": bm25("SELECT query_id, rank, doc_id, score FROM hits WHERE rank <= 10", *TERMS),
    "bm25_min_match": bm25("SELECT query_id, count(*)::BIGINT AS n_docs, max(matched)::BIGINT AS most_matched FROM enough GROUP BY 1", *TERMS),
    "bm25_benchmark": bm25("SELECT query_id, rank, doc_id, score FROM hits WHERE rank <= 5", query="q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"),
    "bm25_okapi": f"""WITH {asked(*TERMS[:4])}, tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({words('lower(text)')}) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT d.doc_id, coalesce(sum(tf), 0)::BIGINT AS doc_len FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY 1), figures AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM lengths),
idf AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, figures GROUP BY term, n), fl AS (SELECT avg(idf) * 0.25::DOUBLE AS floor FROM idf),
qs AS (SELECT query_id, unnest({words('lower(query)')}) AS term FROM q),
scored AS (SELECT query_id, doc_id, round(sum(CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl))), 6) AS score
  FROM tf JOIN qs USING (term) JOIN idf USING (term) JOIN lengths USING (doc_id), figures, fl GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored QUALIFY rank <= 10""",
    "tfidf_vectors": f"WITH {INDEX}, {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM dv",
    "tfidf_search": f"WITH {INDEX}, {asked(*TERMS)}, {TFIDF_QUERY}",
    "tfidf_prefilter": f"WITH {INDEX}, {asked(*TERMS[:2])}, {TFIDF_QUERY}",
    "vector_flat": knn("q.vec_id = 0", 10),
    "vector_min_score_label": knn("q.vec_id = 1", 10, "score >= 0.1 AND label = 0", ", label"),
    "vector_batch_knn": knn("q.vec_id % 50 = 0", 5),
    "vector_ivf_all_cells": knn("q.vec_id % 50 = 0", 10),
    "semantic_results": f"WITH {DOCS} SELECT query_id, rank, docs.doc_id::VARCHAR AS doc_id, score, {shorten('title', 120)} AS title, snippet, topic FROM ({knn('q.vec_id % 50 = 0', 3)}) k JOIN docs ON docs.doc_id = k.vec_id",
    "embedding_shards": "SELECT (i // 112)::BIGINT AS shard, count(*)::BIGINT AS n, min(i)::BIGINT AS first, max(i)::BIGINT AS last FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) GROUP BY 1",
    "hybrid_rrf": bm25("SELECT rank, key, score, keyword_score, semantic_score, keyword_rank, semantic_rank, concat_ws(',', CASE WHEN keyword_rank IS NOT NULL THEN 'keyword' END, CASE WHEN semantic_rank IS NOT NULL THEN 'semantic' END) AS modes FROM g WHERE rank <= 20", TERMS[1], more=LISTS),
    "hybrid_outer_merge": bm25("SELECT rank, key, score, keyword_score, semantic_score FROM g WHERE rank <= 20", TERMS[1], more=LISTS),
    "hybrid_zero_fill": bm25("SELECT rank, key, score, coalesce(keyword_score, 0) AS keyword_score, coalesce(semantic_score, 0) AS semantic_score FROM g WHERE rank <= 20", TERMS[1], more=LISTS),
    "rerank_overlap": bm25(
        f"""SELECT row_number() OVER (ORDER BY rerank_score DESC, place)::INTEGER AS rank, doc_id, retrieval_score, rerank_score FROM (
  SELECT doc_id, h.rank AS place, score AS retrieval_score, round(len(list_intersect((SELECT list(term) FROM qp), {tokens("concat_ws(chr(10), nullif(title, ''), 'Chuyen muc: ' || nullif(topic, ''), nullif(snippet, ''))[1:1200]")}))::DOUBLE / (SELECT count(*) FROM qp), 6) AS rerank_score
  FROM hits h JOIN docs USING (doc_id) WHERE h.rank <= 50) QUALIFY rank <= 10""", TERMS[1]),
    "filter_facet_values": bm25("SELECT rank, doc_id, score FROM dh WHERE topic = 'en' AND source = 'src3'", TERMS[1], more=_DATED_HITS),
    "filter_date_range": f"WITH {DOCS}, {DATED} SELECT doc_id, day FROM dated WHERE day = '' OR (day >= '{DATES[0]}' AND day <= '{DATES[1]}')",
    "dedupe_by_document": f"WITH {CHUNKS} SELECT doc_id, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(raw_text) DESC, chunk_id) = 1",
    "best_chunk_per_document": f"WITH {CHUNKS} SELECT doc_id, length(raw_text)::DOUBLE AS score, chunk_id, topic FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(raw_text) DESC, chunk_id) = 1",
    "newest_prefix_sort": bm25("SELECT row_number() OVER (ORDER BY day DESC, rank)::INTEGER AS rank, doc_id, day FROM dh WHERE rank <= 20", TERMS[1], more=_DATED_HITS),
    "page_slice": bm25("SELECT rank, doc_id, score FROM hits WHERE rank > 10 AND rank <= 20", TERMS[1]),
    "facets_results": bm25(facets("dh", "rank"), TERMS[1], more=_DATED_HITS),
    "facets_corpus": f"WITH {DOCS}, {DATED} {facets('dated', 'doc_id')}",
    "browse": f"WITH {DOCS} SELECT rank, doc_id, title FROM (SELECT row_number() OVER (ORDER BY doc_id)::INTEGER AS rank, doc_id, title FROM docs WHERE topic = 'en') WHERE rank > 10 AND rank <= 20",
    "suggest": f"""WITH {DOCS} SELECT text, 'title' AS type, 1.0::DOUBLE AS weight, min(doc_id) AS doc_id FROM (SELECT doc_id, trim(title) AS text FROM docs)
WHERE contains(array_to_string({tokens('text')}, ' '), 'the tion') GROUP BY text ORDER BY doc_id LIMIT 8""",
    "search_payload": bm25(
        f"""SELECT rank, id, score, category, source, published_at, {_MARKED} AS marked FROM (
  SELECT row_number() OVER (ORDER BY h.rank)::INTEGER AS rank, doc_id::VARCHAR AS id, score, topic AS category, source, snippet, {_PUBLISHED} FROM hits h JOIN dated USING (doc_id) WHERE h.rank <= 200 AND topic = 'en') WHERE rank > 10 AND rank <= 20""", TERMS[1], more=DATED),
    "search_payload_dates": bm25(f"SELECT rank, id, score, published_at FROM ({_IN_RANGE}) WHERE rank <= 10", TERMS[1], more=DATED),
    "search_total_dates": bm25(f"SELECT count(*)::BIGINT AS total FROM ({_IN_RANGE})", TERMS[1], more=DATED),
    "search_newest": bm25(
        f"""SELECT row_number() OVER (ORDER BY day DESC, rank)::INTEGER AS rank, id, score, published_at FROM (
  SELECT h.rank, doc_id::VARCHAR AS id, score, day, {_PUBLISHED} FROM hits h JOIN dated USING (doc_id) WHERE h.rank <= 20)""", TERMS[1], more=DATED),
    "search_hybrid": bm25("SELECT rank, key AS id, score, topic AS category FROM g JOIN docs ON docs.doc_id = g.key::BIGINT WHERE rank <= 20", TERMS[1], more=LISTS.replace("rank <= 50", "rank <= 1000").replace("FROM embeddings v, embeddings q", "FROM embeddings v JOIN docs ON docs.doc_id = v.vec_id, embeddings q")),
    "browse_total": "SELECT count(*)::BIGINT AS total FROM documents WHERE lang = 'en'",
    "highlight": bm25(f"SELECT h.rank, doc_id, {_MARKED} AS summary FROM hits h JOIN docs USING (doc_id) WHERE h.rank <= 10", TERMS[1]),
    "mojibake_repair": "SELECT doc_id, md5(text) AS repaired FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-k}::BIGINT, md5({_q(x)}))" for k, (_, x) in enumerate(BROKEN, 1)) + ")",
    "date_marks": f"SELECT doc_id, len(regexp_extract_all({_dates('text')}, 'DATE[0-9]+'))::BIGINT AS marks FROM documents",
    "eda_nulls": "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS nulls, {f'count(*) FILTER (WHERE trim({c}) = {_q(str())})' if c in ('text', 'lang', 'source') else '0'}::BIGINT AS blanks FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "eda_value_counts": "SELECT source AS value, count(*)::BIGINT AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 12",
    "eda_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "eda_histogram": f"""WITH v AS (SELECT len({words('text')})::DOUBLE AS v FROM documents), e AS (SELECT min(v) AS low, max(v) AS high FROM v)
SELECT CASE WHEN high > low THEN least(floor((v - low) * 60 / (high - low)), 59) ELSE 0 END::INTEGER AS bin, count(*)::BIGINT AS n FROM v, e GROUP BY 1""",
    "diagnostics_counts": f"""WITH {INDEX} SELECT 'documents' AS artifact, count(*)::BIGINT AS n FROM docs UNION ALL SELECT 'vocabulary', count(*)::BIGINT FROM terms
UNION ALL SELECT 'postings', count(*)::BIGINT FROM tf UNION ALL SELECT 'vectors', count(*)::BIGINT FROM embeddings""",
    "sequential_ids": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS new_id FROM documents WHERE length(text) > 100",
    "click_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(*)::BIGINT AS n FROM events WHERE event_type = 'click' GROUP BY ALL",
}
