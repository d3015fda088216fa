"""Text columns out of built-in functions: folding, tokens, cleaning, titles, hosts, canonical names."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of text that was decoded by the wrong table, and characters such a mark can begin with.
MOJIBAKE_MARKERS = ("Ã", "Ä", "Æ", "Â", "â€", "áº", "á»")
MOJIBAKE_STARTS = ("Ã", "Ä", "Æ", "Â", "â", "á")
# Patterns of page furniture, in this order, over folded text.
BOILERPLATE_PATTERNS = (
    r"\(adsbygoogle.*?push\(\{\}\);?",
    r"adsbygoogle\s+window\s+adsbygoogle\s+push",
    r"https?://\S+",
    r"trang thong tin dien tu.*",
    r"chinh sach bao mat.*",
    r"\brss\b",
)
# What a text has at least where the pattern of the same place matches; lower case, as folded text is.
BOILERPLATE_SIGNS = ("adsbygoogle", "adsbygoogle", "://", "trang thong tin dien tu", "chinh sach bao mat", "rss")
TOKEN_PATTERN = "[0-9a-zA-Z_]+"
#: Tokens that are kept: of those of one character, digits only.
KEPT_PATTERN = "[0-9a-zA-Z_]{2,}|[0-9]"
# Topic names as articles spell them, and as they are shown.
TOPICS = {
    "THẾ GIỚI": "Thế giới", "XÃ HỘI": "Xã hội", "THỜI SỰ": "Thời sự", "PHÁP LUẬT": "Pháp luật", "THỂ THAO": "Thể thao", "GIẢI TRÍ": "Giải trí",
    "GIÁO DỤC": "Giáo dục", "KINH DOANH": "Kinh doanh", "CÔNG NGHỆ": "Công nghệ", "ĐỜI SỐNG": "Đời sống", "SỨC KHỎE": "Sức khỏe", "VĂN HÓA": "Văn hóa",
}
NO_TOPIC, NO_SOURCE, NO_DATE = "Chưa phân loại", "Khác", "Không rõ ngày"
PASSAGE_PREFIX, QUERY_PREFIX = "passage: ", "query: "


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: built-in expressions inside others aren't shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_text(column: Column | str) -> Column:
    """Null as empty, anything else as a string."""
    return F.coalesce(_c(column).cast("string"), F.lit(""))


def mojibake_score(column: Column | str) -> Column:
    c = _c(column)
    return sum(((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m)).cast("int") for m in MOJIBAKE_MARKERS)


@lru_cache
def _fold_table() -> tuple[str, str]:
    """Characters that lose their accents and what is left of them, by canonical decomposition; đ has none of its own."""
    pairs = {"đ": "d", "Đ": "D"}
    for k in range(0x80, 0x110000):
        if unicodedata.decomposition(chr(k)):
            left = "".join(x for x in unicodedata.normalize("NFD", chr(k)) if unicodedata.category(x) != "Mn")
            if len(left) == 1 and left != chr(k):
                pairs[chr(k)] = left
    return "".join(pairs), "".join(pairs.values())


def strip_accents(column: Column | str) -> Column:
    """Texts of one byte a character have none."""
    return held(_c(column), lambda c: F.when(F.length(c) == F.octet_length(c), c).otherwise(F.regexp_replace(F.translate(c, *_fold_table()), r"\p{Mn}", "")))


def fold(column: Column | str) -> Column:
    """Lower case without accents."""
    return strip_accents(F.lower(_c(column)))


def strip_boilerplate(column: Column | str) -> Column:
    """Each pattern becomes a space; the open-ended ones take all that follows, so pass whole texts."""
    c = _c(column)
    for pattern in BOILERPLATE_PATTERNS:
        c = F.regexp_replace(c, f"(?is){pattern}", " ")
    return c


def _strip_folded(column: Column) -> Column:
    """``strip_boilerplate`` of folded text, whose upper-case letters are gone: a pattern is looked for only where its sign is."""

    def without(pattern: str, sign: str) -> Callable[[Column], Column]:
        return lambda c: F.when(F.contains(c, F.lit(sign)), F.regexp_replace(c, f"(?is){pattern}", " ")).otherwise(c)

    for pattern, sign in zip(BOILERPLATE_PATTERNS, BOILERPLATE_SIGNS, strict=True):
        column = held(column, without(pattern, sign))
    return column


def tokenisable(column: Column | str) -> Column:
    """Text as ``plain_tokens`` splits it: folded, without page furniture."""
    return _strip_folded(fold(column))


def repaired(column: Column | str) -> Column:
    """Decoding repair; null as empty."""
    from lexloom.functions.repair import fix_mojibake

    return fix_mojibake(column)


def plain_tokens(column: Column | str) -> Column:
    """Tokens of text that is repaired already: folded words; joined words are followed by their parts."""
    parts = lambda t: F.when(F.contains(t, F.lit("_")), F.concat(F.array(t), F.filter(F.split(t, "_"), lambda p: F.length(p) > 1))).otherwise(F.array(t))

    def split(c: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(KEPT_PATTERN), F.lit(0))
        return F.when(F.contains(c, F.lit("_")), F.flatten(F.transform(found, parts))).otherwise(found)

    return held(tokenisable(column), split)


def tokens(column: Column | str) -> Column:
    """Tokens of any text, repaired first."""
    return plain_tokens(repaired(column))


def normalize_text(column: Column | str) -> Column:
    return F.array_join(tokens(column), " ")


def collapse_space(column: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(column), r"(?U)\s+", " "), "^ | $", "")


def shorten(column: Column | str, most: int) -> Column:
    c = _c(column)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("..."))).otherwise(c)


def _first(column: Column | str, most: int) -> Column:
    """Text with single spaces, shortened: its beginning tells, unless that is spaces for the most part."""
    c = _c(column)
    p = collapse_space(F.substring(c, 1, 8 * most))
    return F.when(F.length(p) > most, shorten(p, most)).otherwise(shorten(collapse_space(c), most))


def clean_display(column: Column | str, most: int | None = None) -> Column:
    """Repaired, with single spaces, shortened."""
    c = repaired(as_text(column))
    return collapse_space(c) if most is None else _first(c, most)


def plain_display(column: Column | str, most: int | None = None) -> Column:
    """``clean_display`` of text that is repaired already."""
    c = as_text(column)
    return collapse_space(c) if most is None else _first(c, most)


def chunk_title(column: Column | str, most: int = 120) -> Column:
    return _first(as_text(column), most)


def date_marks(column: Column | str) -> Column:
    """Dates of day, month and year, then of day and month, as `` DATEyyyymmdd `` and `` DATEmmdd ``.

    Widths are padded by one pattern for each; no range is checked, so decimals and scores become dates as well.
    """
    c = _c(column)
    pad = {1: "0", 2: ""}
    for d in (2, 1):
        for m in (2, 1):
            for y, century in ((4, ""), (3, ""), (2, "20")):
                c = F.regexp_replace(c, rf"\b(\d{{{d}}})[-/.](\d{{{m}}})[-/.](\d{{{y}}})\b", f" DATE{century}$3{pad[m]}$2{pad[d]}$1 ")
    for d in (2, 1):
        for m in (2, 1):
            c = F.regexp_replace(c, rf"\b(\d{{{d}}})[-/.](\d{{{m}}})\b", f" DATE{pad[m]}$2{pad[d]}$1 ")
    return c


_PUNCTUATION = "!\"#$%&'()*+,./:;<=>?@[\\]^`{|}~"


def clean_keep_case(column: Column | str, dates: bool = True) -> Column:
    """Without tags, addresses and punctuation (``_`` and ``-`` stay), dates marked; for text in composed form."""
    c = F.regexp_replace(as_text(column), "<[^>]+>", " ")
    c = F.regexp_replace(c, r"http(?U)\S+", " ")
    c = F.regexp_replace(c, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", " ")
    c = date_marks(c) if dates else c
    return collapse_space(F.translate(c, _PUNCTUATION, " " * len(_PUNCTUATION)))


def words(column: Column | str) -> Column:
    return F.filter(F.split(_c(column), r"(?U)\s+"), lambda x: x != "")


def coalesce_columns(df, *names: str) -> Column:
    """The first of the named columns that the frame has and that isn't null or blank."""
    have = [F.when(F.trim(as_text(c)) != "", F.col(c)) for c in names if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def display_date(column: Column | str) -> Column:
    """The day as it is shown, day first; what is no day is said to be unknown."""
    day = F.try_to_timestamp(F.substring(as_text(column), 1, 10), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(day, "d/M/yyyy"), F.lit(NO_DATE))


def word_count(column: Column | str) -> Column:
    return F.size(words(as_text(column)))


def remove_stopwords(column: Column | str, stop: list[str]) -> Column:
    """Words whose lower case isn't in a short list; for a long one use an anti-join."""
    listed = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.array_join(F.filter(words(as_text(column)), lambda w: ~F.array_contains(listed, F.lower(w))), " ")


def source_from_url(column: Column | str) -> Column:
    return F.coalesce(F.replace(F.get(F.split(_c(column), "/"), F.lit(2)), F.lit("www."), F.lit("")), F.lit(""))


def source_or_host(source: Column | str, url: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(source), F.lit("")), source_from_url(url))


def canonical_topic(column: Column | str) -> Column:
    c = _c(column)
    mapped = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in TOPICS.items() for x in pair)), c), c)
    trimmed = F.trim(mapped)
    shown = F.concat(F.upper(F.substring(trimmed, 1, 1)), F.lower(F.substring(trimmed, 2, 1 << 30)))
    return F.when(c.isNull() | c.isin("Unknown", "None", "", NO_TOPIC), NO_TOPIC).otherwise(shown)


def canonical_source(column: Column | str) -> Column:
    c = _c(column)
    return F.lower(F.trim(F.when(c.isNull() | c.isin("", "Unknown"), NO_SOURCE).otherwise(c)))


def rerank_text(title: Column | str, topic: Column | str, snippet: Column | str, most: int = 1200) -> Column:
    """What a reranker reads of a result."""
    topic = F.nullif(as_text(topic), F.lit(""))
    return F.substring(F.concat_ws("\n", F.nullif(as_text(title), F.lit("")), F.concat(F.lit("Chuyen muc: "), topic), F.nullif(as_text(snippet), F.lit(""))), 1, most)


def result_key(chunk_id: Column | str, doc_id: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(chunk_id), F.lit("")), _c(doc_id))


def prefixed_key(chunk_id: Column | str, doc_id: Column | str) -> Column:
    """``doc:`` and the document, or ``chunk:`` and the chunk, or null."""
    doc, chunk = F.nullif(_c(doc_id), F.lit("")), F.nullif(_c(chunk_id), F.lit(""))
    return F.coalesce(F.concat(F.lit("doc:"), doc), F.concat(F.lit("chunk:"), chunk))


def escape_html(column: Column | str) -> Column:
    """Escaped but for ``<em>`` marks."""
    c = _c(column)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("&lt;em&gt;", "<em>"), ("&lt;/em&gt;", "</em>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def score_label(score: Column | str, hybrid: Column | str, reranked: Column | str) -> Column:
    s = _c(score)
    return F.when(s.isNull() | (s == 0), "N/A").when(F.coalesce(_c(reranked), F.lit(False)), "rerank").when(F.coalesce(_c(hybrid), F.lit(False)), "hybrid").when(s <= 1.0, "semantic").otherwise("BM25")


def sentences(column: Column | str) -> Column:
    """Sentences by end marks and line feeds; a stand-in for a trained splitter, which can be plugged in as a UDF."""
    found = F.regexp_extract_all(as_text(column), F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")
