"""Tokens of texts and how often each is there, counted in the task that reads the text: Spark has no such function of arrays. Arrow batches only.

Nothing is shuffled to count what one document holds.  A worker holds a slice of documents at a time, or a bounded number of terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import KEPT_PATTERN

#: Documents and characters counted at a time, and terms whose documents a task counts before it gives them away.
SLICE, CHARS, TERMS_HELD = 512, 1 << 21, 1 << 17
_KEPT = re.compile(KEPT_PATTERN)
#: What isn't white space to Unicode, as in ``functions.text.words``.
_WORD = re.compile("[^\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def kept_tokens(text: str) -> list[str]:
    """``functions.text.plain_tokens`` of text that is ``tokenisable`` already."""
    found = _KEPT.findall(text)
    if "_" not in text:
        return found
    return [x for t in found for x in ((t, *(p for p in t.split("_") if len(p) > 1)) if "_" in t else (t,))]


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        begin = size = 0
        texts: list[str] = []
        for k, text in enumerate(batch.column(1)):
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if len(texts) == SLICE or size >= CHARS or k == len(batch) - 1:
                yield batch.column(0).slice(begin, len(texts)), texts
                begin, size, texts = k + 1, 0, []


def _counts(texts: list[str], split: Callable[[str], list[str]], only: frozenset[str] | None) -> tuple[list[int], list[int], list[str], list[int]]:
    """Of each text its tokens and its different listed ones; of all the terms and their counts, one text after the other."""
    lengths, sizes, terms, tf = [], [], [], []
    for text in texts:
        found = split(text)
        counts = Counter(found if only is None else [t for t in found if t in only])
        lengths.append(len(found))
        sizes.append(len(counts))
        terms.extend(counts)
        tf.extend(counts.values())
    return lengths, sizes, terms, tf


def by_document(texts: DataFrame, split: Callable[[str], list[str]] = kept_tokens, only: Collection[str] | None = None) -> DataFrame:
    """``texts(key, text)`` to ``(key, doc_len, terms, tfs)``: a row a document, terms and counts at the same places; those of ``only`` if given."""
    kept = None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, part in _slices(batches):
            lengths, sizes, terms, tf = _counts(part, split, kept)
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(terms, pa.string()), pa.array(tf, pa.int32()))]
            yield pa.RecordBatch.from_arrays([keys, pa.array(lengths, pa.int64()), *lists], names=["key", "doc_len", "terms", "tfs"])

    key, text = texts.columns
    found = texts.select(key, text).mapInArrow(run, f"key {texts.schema[key].dataType.simpleString()}, doc_len bigint, terms array<string>, tfs array<int>")
    return found.withColumnRenamed("key", key)


def rows(counts: DataFrame, *keep: str) -> DataFrame:
    """``by_document`` as ``(*keep, term, tf)``."""
    pairs = counts.select(*keep, F.inline(F.arrays_zip("terms", "tfs")).alias("term", "n"))
    return pairs.select(*keep, "term", F.col("n").cast("long").alias("tf"))


def by_row(texts: DataFrame, split: Callable[[str], list[str]] = kept_tokens) -> DataFrame:
    """``texts(key, text)`` to ``(key, doc_len, term, tf)``: a row a document and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, part in _slices(batches):
            lengths, sizes, terms, tf = _counts(part, split, None)
            at = np.repeat(np.arange(len(part)), sizes)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(np.array(lengths, np.int64)[at]), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=["key", "doc_len", "term", "tf"])

    key, text = texts.columns
    found = texts.select(key, text).mapInArrow(run, f"key {texts.schema[key].dataType.simpleString()}, doc_len bigint, term string, tf bigint")
    return found.withColumnRenamed("key", key)


def document_counts(texts: DataFrame, split: Callable[[str], list[str]] = kept_tokens) -> DataFrame:
    """``texts(key, text)`` to ``(term, df)``: in how many documents each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for _, part in _slices(batches):
            for text in part:
                held.update(set(split(text)))
            if len(held) >= TERMS_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])

    return texts.select(*texts.columns).mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
