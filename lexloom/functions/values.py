"""Numbers, dates and vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLISECONDS_FROM = 10_000_000_000
K1, B = 1.5, 0.75


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(idf: Column, tf: Column, doc_len: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avgdl))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def min_matched(n: Column) -> Column:
    """Seventy percent of the terms, rounded up."""
    return F.when(n <= 1, n).otherwise(F.ceil(n * F.lit(0.7)))


def rrf(rank: Column | str, k: int = 60) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(k) + _c(rank)), F.lit(0.0))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    norm = F.sqrt(inner_product(v, v))
    return F.transform(_c(v), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def _time(number: Column) -> Column:
    seconds = F.when(number > MILLISECONDS_FROM, number / 1000).otherwise(number)
    return F.timestamp_seconds(F.floor(seconds).cast("long"))


def timestamp_text(number: Column | str, text: Column | str | None = None) -> Column:
    """Epoch seconds or milliseconds as ISO time; where there is no number, the text as it is; null as empty."""
    n = _c(number)
    other = F.coalesce(_c(text), F.lit("")) if text is not None else F.lit("")
    return F.when(n.isNotNull(), F.date_format(_time(n), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(other)


def date_text(number: Column | str, text: Column | str | None = None) -> Column:
    """The day of a number; of a text the first ten characters if it has as many; else empty."""
    n = _c(number)
    t = _c(text) if text is not None else F.lit(None).cast("string")
    return F.when(n.isNotNull(), F.date_format(_time(n), "yyyy-MM-dd")).when(F.length(t) >= 10, F.substring(t, 1, 10)).otherwise("")


def lenient_timestamp(column: Column | str) -> Column:
    return F.try_to_timestamp(_c(column))


def total_pages(total: int, page_size: int) -> int:
    return max(1, -(-total // page_size))


def none_if_nan(column: Column | str) -> Column:
    """Null for NaN and for texts that spell it."""
    c = _c(column).cast("string")
    return F.when(~F.lower(F.trim(c)).isin("nan", "+nan", "-nan", "nat", "<na>"), c)


def without_keys(mapping: Column | str, keys: list[str]) -> Column:
    return F.map_filter(_c(mapping), lambda k, v: ~k.isin(keys))
