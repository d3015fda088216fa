"""What happens to ranked results before they are shown: filters, one result a document, cuts, pages, facets, suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import Settings
from lexloom.functions import text as X
from lexloom.functions.values import date_text, timestamp_text

# Names of search modes.
MODES = {"": "keyword", "lexical": "keyword", "keyword": "keyword", "bm25": "keyword", "tfidf": "keyword", "semantic": "semantic", "hybrid": "hybrid"}
FACET_SIZE, SUGGESTIONS = 20, 8


class BadRequest(ValueError):
    """A parameter that no search takes."""


def search_mode(mode: str = "") -> str:
    try:
        return MODES[mode.strip().lower()]
    except KeyError:
        raise BadRequest(f"no search mode {mode!r}") from None


# Names of fields in the explanation of a search.
RAW_FIELDS = ("title", "content", "raw_text")
FOLDED_FIELDS = ("chunk_processed", "chunk_unaccented", "combined_unaccented")


class NotReady(RuntimeError):
    """A search needs vectors, and there are none."""


def resolve_mode(mode: str, semantic_ready: bool, settings: Settings) -> str:
    """Hybrid falls back to keyword where vectors are missing and aren't required."""
    found = search_mode(mode)
    if found == "hybrid" and not semantic_ready and not settings.hybrid_require_semantic:
        return "keyword"
    return found


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    if page < 1 or not 1 <= page_size <= 50:
        raise BadRequest("page is 1 or more, page_size 1 to 50")
    return (page - 1) * page_size, page_size


def candidate_count(offset: int, page_size: int, rerank: bool = False, rerank_top_k: int = 50) -> int:
    found = max(offset + 5 * page_size, 200)
    return max(found, offset + rerank_top_k) if rerank else found


def filter_results(results: DataFrame, *, category: str = "", author: str = "", source: str = "", from_date: str = "", to_date: str = "", date: Column | None = None) -> DataFrame:
    """Exact matches; an empty parameter doesn't filter; results without a date pass any range.  Acts on candidates."""
    if category:
        results = results.where(F.col("topic") == category)
    if author:
        results = results.where(F.col("author") == author)
    if source:
        results = results.where(X.source_or_host("source", "url") == source)
    if from_date or to_date:
        day = date_text("crawled_at", "crawled_text") if date is None else date
        if from_date:
            results = results.where((day == "") | (day >= from_date))
        if to_date:
            results = results.where((day == "") | (day <= to_date))
    return results


def one_per_document(results: DataFrame, order: str = "rank", key: Column | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first result of each document; results without any id all stay."""
    key = F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.col("chunk_id"), F.lit("")) if key is None else key
    held = results.withColumn("__key", key)
    first = F.row_number().over(Window.partitionBy(*by, "__key").orderBy(order))
    blank = held.where("__key = ''").withColumn("__copy", F.lit(1))
    return held.where("__key <> ''").withColumn("__copy", first).where("__copy = 1").unionByName(blank).drop("__key", "__copy")


def renumber(results: DataFrame, *order: Column | str, by: str = "query_id") -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def cut(results: DataFrame, most: int, by: str = "query_id") -> DataFrame:
    """The first ``most`` of what is left, numbered anew."""
    return renumber(results, "rank", by=by).where(F.col("rank") <= most)


def newest_first(results: DataFrame, day: Column) -> DataFrame:
    """By day, unknown ones last; ties keep their order."""
    return renumber(results.withColumn("__day", day), F.desc(F.coalesce("__day", F.lit(""))), "rank").drop("__day")


def page(results: DataFrame, offset: int, page_size: int) -> DataFrame:
    return results.where((F.col("rank") > offset) & (F.col("rank") <= offset + page_size))


def facets(results: DataFrame, order: str = "rank", most: int = FACET_SIZE) -> DataFrame:
    """``(facet, value, count)``: the most frequent values of category, author and source, first seen first among equals."""
    pairs = F.array(*(F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in (("category", F.col("topic")), ("author", F.col("author")), ("source", X.source_or_host("source", "url")))))
    counts = results.select(order, F.explode(pairs).alias("x")).where("x.value <> ''").groupBy("x.facet", "x.value").agg(F.count("*").alias("count"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "first", "value"))
    return counts.withColumn("place", place).where(F.col("place") <= most).select("facet", "value", "count", "place")


def _browsed(documents: DataFrame, category: str = "", author: str = "", source: str = "") -> DataFrame:
    held = filter_results(documents.withColumn("query_id", F.lit(0)), category=category, author=author, source=source)
    return one_per_document(held, "doc_index", F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.col("id")))


def browse(documents: DataFrame, *, category: str = "", author: str = "", source: str = "", offset: int = 0, page_size: int = 10) -> DataFrame:
    """Documents without a query, filtered, one a document, a page of them in the order of the corpus."""
    taken = _browsed(documents, category, author, source).orderBy("doc_index").limit(offset + page_size)
    return page(renumber(taken, "doc_index"), offset, page_size)


def browse_total(documents: DataFrame, *, category: str = "", author: str = "", source: str = "") -> DataFrame:
    """How many documents the filters leave, of which browsing shows a page."""
    return _browsed(documents, category, author, source).agg(F.count("*").alias("total"))


def document_payload(documents: DataFrame) -> DataFrame:
    """Documents as browsing sends them: score 0, the title as it is, the beginning of the text."""
    return payload(documents.withColumn("score", F.lit(0.0)).withColumn("snippet", F.substring("content", 1, 300)))


def suggest(documents: DataFrame, query: Column | str, most: int = SUGGESTIONS) -> DataFrame:
    """Different titles that hold the folded query, in the order of the corpus."""
    wanted = X.normalize_text(F.lit(query) if isinstance(query, str) else query)
    titles = documents.select("doc_index", F.trim("title").alias("text")).where((wanted != "") & F.contains(F.array_join(X.plain_tokens("text"), " "), wanted))
    return titles.groupBy("text").agg(F.min("doc_index").alias("doc_index")).orderBy("doc_index").limit(most).select("text", F.lit("title").alias("type"), F.lit(1.0).alias("weight"), "doc_index")


def payload(results: DataFrame, highlight: Column | None = None) -> DataFrame:
    """Results as they are sent."""
    have = lambda c: F.col(c) if c in results.columns else F.lit(None)
    return results.select(
        X.result_key("chunk_id", "doc_id").alias("id"), "doc_id", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "score", "title", F.col("snippet").alias("summary"), "url",
        X.as_text("topic").alias("category"), X.as_text("author").alias("author"), X.source_or_host("source", "url").alias("source"),
        timestamp_text(have("crawled_at").cast("double"), have("crawled_text").cast("string")).alias("published_at"), (F.lit(None).cast("struct<title:array<string>,summary:array<string>>") if highlight is None else highlight).alias("highlight"), "rank",
    )


def keyword_highlight(tokens: Column | str) -> Column:
    """Highlighted title and snippet where a token is in them, else null."""
    from lexloom.functions.repair import highlighted

    marked = {k: highlighted(c, tokens) for k, c in (("title", "title"), ("summary", "snippet"))}
    changed = {"title": F.contains(marked["title"], F.lit("<em>")), "summary": F.contains(marked["summary"], F.lit("<em>"))}
    fields = F.struct(*(F.when(changed[k], F.array(marked[k])).alias(k) for k in marked))
    return F.when(changed["title"] | changed["summary"], fields)


def explain_payload(query: str, mode: str, reranked: bool, sort: str = "relevance", settings: Settings | None = None, **filters: str) -> dict:
    """How a search was done; the folded query is a column, as folding is the engine's."""
    named = {k: filters.get(k) or None for k in ("category", "author", "source", "from_date", "to_date")}
    return {"query": query, "folded_query": X.normalize_text(F.lit(query)), "mode": mode, "rerank": reranked, "reranker_model": (settings or Settings()).reranker_model if reranked else None,
            "raw_fields": list(RAW_FIELDS), "folded_fields": list(FOLDED_FIELDS), "filters": named, "sort": sort}


@dataclass
class Page:
    """A page of results, the number of results after filters and deduplication, and facets of the raw candidates.

    ``loading`` says that vectors or their encoder aren't there yet, so there are no results but will be."""

    results: DataFrame
    total: DataFrame
    facets: DataFrame
    explain: dict | None
    mode: str = "keyword"
    loading: bool = False


@dataclass
class Engines:
    """What a search can use; ``semantic`` and ``hybrid`` are None where there are no vectors."""

    keyword: object
    semantic: object | None = None
    hybrid: object | None = None
    settings: Settings = field(default_factory=Settings)

    def status(self) -> dict:
        return {"keyword": True, "semantic": self.semantic is not None, "semantic_ready": self.semantic is not None and getattr(self.semantic, "ready", True), "hybrid": self.hybrid is not None}

    def of(self, mode: str) -> tuple[str, object]:
        """The mode that is used and its engine; hybrid gives way to keyword only where the settings allow it."""
        found = resolve_mode(mode, self.semantic is not None, self.settings)
        engine = getattr(self, found)
        if engine is None:
            raise NotReady(f"no vectors for a {found} search")
        return found, engine


def warm_up(engines: Engines, queries: DataFrame) -> dict:
    """Runs each engine once, so that its tables are read and its encoder is made; returns the status."""
    for engine in (engines.keyword, engines.semantic, engines.hybrid):
        if engine is not None:
            engine.search(queries, 1).write.format("noop").mode("overwrite").save()
    return engines.status()


def search_page(engine, documents: DataFrame, queries: DataFrame, query: str, *, mode: str = "", number: int = 1, page_size: int = 10, sort: str = "relevance", rerank_score: Column | None = None, settings: Settings | None = None, global_newest: bool = False, **filters: str) -> Page:
    """Candidates, filters, one a document, rerank or cut, sort, page; without a query, documents in their order.

    ``engine`` is a keyword engine or ``Engines``.  Sorting by date reorders what the cut left, unless ``global_newest``.
    """
    from lexloom.operators.fusion import rerank as reranked

    engines = engine if isinstance(engine, Engines) else Engines(engine, settings=settings or Settings())
    settings = settings or engines.settings
    offset, page_size = page_bounds(number, page_size)
    plain = {k: v for k, v in filters.items() if k in ("category", "author", "source")}
    query = query.strip()
    explained = lambda done: explain_payload(query, search_mode(mode), done, sort, settings, **filters)
    if not query:
        taken = browse(documents, offset=offset, page_size=page_size, **plain)
        return Page(document_payload(taken), browse_total(documents, **plain), facets(documents, "doc_index"), explained(False), search_mode(mode))
    used, chosen = engines.of(mode)
    if used != "keyword" and not getattr(engines.semantic, "ready", True):
        nothing = documents.limit(0)
        return Page(document_payload(nothing.withColumn("rank", F.lit(0))), nothing.agg(F.count("*").alias("total")), facets(nothing, "doc_index"), None, used, True)
    raw = chosen.search(queries, candidate_count(offset, page_size, rerank_score is not None, settings.reranker_top_k))
    left = renumber(one_per_document(filter_results(raw, **filters)), "rank")
    top_k = offset + page_size
    if rerank_score is not None:
        left_cut = reranked(left, rerank_score, top_k, settings.reranker_top_k)
    else:
        left_cut = left if global_newest and sort == "newest" else cut(left, top_k)
    if sort == "newest":
        left_cut = newest_first(left_cut, date_text("crawled_at", "crawled_text"))
    marked = keyword_highlight(X.tokens(F.lit(query))) if used in ("keyword", "hybrid") else None
    return Page(payload(page(left_cut, offset, page_size), marked), left.agg(F.count("*").alias("total")), facets(raw), explained(rerank_score is not None), used)
