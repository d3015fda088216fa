"""Removal of repeated strings of bytes or of words, exact.

Every symbol (a byte, or a word) covered by a string of ``width`` symbols that also starts anywhere else goes, in the same
document or another; strings are judged on the input.  No text is compared with all others:

1. Each window of ``width`` symbols is keyed by its smallest rolling hash of ``width // 2`` symbols, so equal windows
   have equal keys.  Runs of windows with one key are *pieces*; a row for each (key, hash of the piece, place).
2. A key found once repeats nothing.  Copies of a piece are one piece and its number of places before anything else
   happens, so that copies cost a row each and no group of them comes together; such a piece is covered whole.
3. The unlike pieces of a key, and those with a repeat inside, are lined up at the key, cut to what they share with a
   neighbour in sorted order, and what still differs is put into a suffix array built by linear grouping
   (``suffix_array``); neighbours in it that share ``width`` symbols are repeats.
4. A key with more than ``hot_bytes`` of unlike pieces is keyed once more, by whole windows.  Pieces of such a key are
   single windows and a group's suffix array has one entry, so their counts say the same; any key splits over many tasks.

Hashes have 64 bits.  Rows of equal id and text are judged like any others: each repeats the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.bytehash import BYTE_VALUES, arrow_text, ranges, sliding_min, value_sums, windows, word_hashes, word_places
from lexloom.llm.storage import discard, in_slices, sieve, stage
from lexloom.llm.suffix_array import suffix_array

WIDTH = 400
#: Words of a passage, for those that repeat across documents; a passage's first and last words may be joined to what is around it.
PASSAGE_WORDS = 48
HOT_BYTES = 1 << 18
UNITS = {"bytes": np.uint8, "words": np.uint64}

_PIECES = "k1 long, k2 long, start int, n int, key long, piece long, inner boolean"


def _symbols(column, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts of a column, and ``n + 1`` offsets of each text's; words are their hashes."""
    data, offsets = arrow_text(column)
    if unit == "words":
        return word_hashes(data, offsets)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sums(symbols: np.ndarray) -> np.ndarray:
    return value_sums(BYTE_VALUES[symbols] if symbols.dtype == np.uint8 else symbols | np.uint64(1))


def pieces_of(symbols: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows, key, hash and whether the key recurs inside, for each piece of one text."""
    sums = _sums(symbols)
    hashes = windows(sums, seed)
    span = width - seed + 1
    key = sliding_min(hashes, span)
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    start, end = np.append(0, edge), np.append(edge, len(key))
    pad = np.concatenate([np.zeros(span - 1, np.uint64), key, np.zeros(span - 1, np.uint64)])
    held = hashes[~sliding_min(~pad, span) == hashes]  # the hashes that are the smallest of some window
    seen, times = np.unique(held, return_counts=True)
    return start, end - start, key[start], ranges(sums, start, end - 1 + width), np.isin(key[start], seen[times > 1])


def _scan(width: int, seed: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, offsets = _symbols(batch.column("text"), unit)
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            rows, out = [], []
            for i in np.flatnonzero(np.diff(offsets) >= width):
                found = pieces_of(symbols[offsets[i] : offsets[i + 1]], width, seed)
                rows.append(np.full(len(found[0]), i))
                out.append(found)
            if out:
                at = np.concatenate(rows)
                start, n, key, piece, inner = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[at], k2[at], start.astype(np.int32), n.astype(np.int32), key.view(np.int64), piece.view(np.int64), inner)], names=["k1", "k2", "start", "n", "key", "piece", "inner"])

    return in_slices(run)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _most_shared(texts: list[np.ndarray]) -> list[int]:
    """For each text the longest prefix, in symbols, that it shares with another one."""
    each = texts[0].itemsize
    coded = [x.tobytes() for x in texts]
    order = sorted(range(len(coded)), key=coded.__getitem__)
    best = [0] * len(coded)
    for a, b in zip(order, order[1:], strict=False):
        n = _shared(coded[a], coded[b]) // each
        best[a], best[b] = max(best[a], n), max(best[b], n)
    return best


def repeats(texts: list[np.ndarray], width: int) -> list[list[tuple[int, int]]]:
    """For each text the intervals that repeats of ``width`` symbols cover, by a suffix array over all of them."""
    size = np.array([len(x) for x in texts])
    begin = np.append(0, np.cumsum(size + 1))
    ends = begin[1:] - 1
    ranks = np.unique(np.concatenate(texts), return_inverse=True)[1]
    coded = np.insert(ranks, np.cumsum(size), ranks.max(initial=0) + 1 + np.arange(len(texts)))  # each text ends with a symbol of its own
    order = np.array(suffix_array(coded), np.int64)
    whole = np.repeat(ends, size + 1)[order] - order >= width
    hashes = np.zeros(len(coded), np.uint64)
    own = windows(value_sums(coded.astype(np.uint64) * np.uint64(2) + np.uint64(1)), width)
    hashes[: len(own)] = own
    same = np.flatnonzero(whole[1:] & whole[:-1] & (hashes[order[1:]] == hashes[order[:-1]]))
    hit = np.unique(np.concatenate([order[same], order[same + 1]]))
    bounds = np.searchsorted(hit, begin)
    return [merged([(int(h) - int(begin[k]), int(h) - int(begin[k]) + width) for h in hit[bounds[k] : bounds[k + 1]]]) for k in range(len(texts))]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def covered(key: int, pieces: list[np.ndarray], width: int, seed: int) -> list[list[tuple[int, int]]]:
    """For each of the unlike pieces of a key the intervals that are covered by repeats among them."""
    at = [np.flatnonzero(windows(_sums(x), seed) == np.uint64(key)) for x in pieces]
    if any(len(x) != 1 for x in at):
        return repeats(pieces, width)
    at = [int(x[0]) for x in at]
    left = _most_shared([x[:a][::-1] for x, a in zip(pieces, at, strict=True)])
    right = _most_shared([x[a:] for x, a in zip(pieces, at, strict=True)])
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    alike: dict[bytes, list[int]] = {}
    for k, x in enumerate(pieces):
        if left[k] + right[k] >= width:
            alike.setdefault(x[at[k] - left[k] : at[k] + right[k]].tobytes(), []).append(k)
    kind = pieces[0].dtype
    for x, spans in zip(alike, repeats([np.frombuffer(x, kind) for x in alike], width) if len(alike) > 1 else [[] for _ in alike], strict=True):
        for k in alike[x]:
            lead, n = at[k] - left[k], len(x) // kind.itemsize
            out[k] = [(lead, lead + n)] if len(alike[x]) > 1 else [(lead + a, lead + b) for a, b in spans]
    return out


def _cut(width: int, unit: str):
    """Documents with their wanted pieces to a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, offsets = _symbols(batch.column("text"), unit)
            keys, names, cuts = [], [], []
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    a = offsets[i] + w["start"]
                    keys.append(w["key"])
                    names.append(w["piece"])
                    cuts.append(symbols[a : a + w["n"] - 1 + width].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(cuts, pa.binary())], names=["key", "piece", "bytes"])

    return in_slices(run)


def _by_key(width: int, seed: int, unit: str):
    """Sorted rows of (key, piece, bytes) to (key, piece, from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, cuts = None, [], []

        def done() -> pa.RecordBatch | None:
            found = [(now, names[k], a, b) for k, spans in enumerate(covered(now & (2**64 - 1), cuts, width, seed)) for a, b in spans] if cuts else []
            if found:
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "piece", "a", "b"])

        for batch in batches:
            for key, piece, cut in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "bytes")), strict=True):
                if key != now:
                    if out := done():
                        yield out
                    now, names, cuts = key, [], []
                names.append(piece)
                cuts.append(np.frombuffer(cut, UNITS[unit]))
        if out := done():
            yield out

    return run


def _by_window(width: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, piece, cut in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "bytes")), strict=True):
                own = windows(_sums(np.frombuffer(cut, UNITS[unit])), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array(np.full(len(own), piece)), pa.array(own), pa.array(np.arange(len(own), dtype=np.int32))], names=["key", "piece", "window", "a"])

    return run


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _union(column: pa.Array) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in spans])] for spans in column.to_pylist()], _SPANS)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each piece's intervals, so that a place with the piece is one row, however much repeats there."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), _union(batch.column("spans"))], names=["key", "piece", "spans"])


def _merge_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each document's intervals."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), _union(batch.column("spans"))], names=["k1", "k2", "spans"])


def repeated_spans(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, unit: str = "bytes", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``(k1, k2, spans)``: intervals of symbols to remove for each document that has some.

    ``k1`` and ``k2`` are the ``xxhash64`` of id and text; rows that agree in both get the same intervals.
    """
    seed = width // 2
    keyed = docs.select(F.xxhash64(id_col).alias("k1"), F.xxhash64(text_col).alias("k2"), F.col(text_col).alias("text"))
    pieces = stage(keyed.mapInArrow(_scan(width, seed, unit), _PIECES), "pieces")
    keys = pieces.groupBy("key").agg(F.count("*").alias("times"), F.min("piece").alias("low"), F.max("piece").alias("high"), F.max("inner").alias("within"))
    keys = keys.where("times > 1 or within").select("key", F.expr("low <> high or within").alias("unlike"))
    found = stage(pieces.join(keys, "key"), "repeated-pieces")
    discard(pieces)

    kinds = found.groupBy("key", "piece").agg(F.count("*").alias("times"), F.max("n").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("at"), F.max("unlike").alias("unlike"))
    kinds = stage(kinds, "piece-kinds")
    whole = kinds.where("times > 1").select("key", "piece", F.lit(0).alias("a"), (F.col("n") - 1 + width).cast("int").alias("b"))
    wanted = kinds.where("unlike").groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("key", "piece", "at.start", "n")).alias("wanted"))
    wanted = stage(wanted, "wanted-pieces")
    some = sieve(keyed, F.col("k1").bitwiseXOR(F.col("k2")), wanted.select(F.col("k1").bitwiseXOR(F.col("k2")).alias("k")), "wanted-documents").where("__maybe")
    cuts = some.join(wanted.hint("merge"), ["k1", "k2"]).select("text", "wanted").mapInArrow(_cut(width, unit), "key long, piece long, bytes binary").dropDuplicates(["key", "piece"])
    cuts = stage(cuts, "cut-pieces")
    hot = cuts.groupBy("key").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > hot_bytes).select("key")
    hot = stage(hot, "hot-keys")
    spans = "key long, piece long, a int, b int"
    some = cuts.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(width, seed, unit), spans)
    each = None
    if not hot.isEmpty():
        each = stage(cuts.join(hot, "key", "left_semi").mapInArrow(_by_window(width, unit), "key long, piece long, window long, a int"), "hot-windows")
        twice = each.groupBy("key", "window").count().where("count > 1").select("key", "window")
        some = some.union(each.join(twice, ["key", "window"]).select("key", "piece", "a", (F.col("a") + width).cast("int").alias("b")))
    some = whole.union(some).groupBy("key", "piece").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    some = stage(some.mapInArrow(_merge, "key long, piece long, spans array<struct<a:int,b:int>>"), "covered-pieces")
    discard(kinds, wanted, cuts, hot, *([each] if each is not None else []))
    shifted = F.transform("spans", lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"]).alias("b")))
    out = stage(found.join(some, ["key", "piece"]).groupBy("k1", "k2").agg(F.flatten(F.collect_list(shifted)).alias("spans")).mapInArrow(_merge_documents, "k1 long, k2 long, spans array<struct<a:int,b:int>>"), "repeated-spans")
    discard(found, some)
    return out


def _whole_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The interval without the parts of UTF-8 characters at its ends."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _in_bytes(text: np.ndarray, spans: list[dict], unit: str) -> list[tuple[int, int]]:
    """Intervals of symbols as intervals of bytes; words go with the white space after them."""
    runs = merged([(x["a"], x["b"]) for x in spans])
    if unit == "bytes" or not runs:
        return runs
    start, _, _ = word_places(text, np.array([0, len(text)]))
    start = np.append(start, len(text))
    return [(int(start[a]), int(start[b])) for a, b in runs]


def _remove(names: list[str], unit: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_text(batch.column("__text"))
            n_bytes, n_removed, n_spans, digest, kept = [], [], [], [], []
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                runs = _in_bytes(data[offsets[i] : offsets[i + 1]], spans or [], unit)
                left, clean, last, done = [], [], 0, 0
                for a, b in runs:
                    left.append(text[last:a])
                    last = b
                    a, b = _whole_characters(text, a, b)
                    clean.append(text[done:a])
                    done = b
                left.append(text[last:])
                clean.append(text[done:])
                n_bytes.append(len(text))
                n_removed.append(sum(b - a for a, b in runs))
                n_spans.append(len(runs))
                digest.append(hashlib.sha256(b"".join(left)).hexdigest())
                if with_text:
                    kept.append(b"".join(clean).decode())
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.string())] if with_text else [])], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])])

    return in_slices(run, "__text")


def suffix_dedup(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), width: int = WIDTH, unit: str = "bytes", hot_bytes: int = HOT_BYTES, with_text: bool = True, passages: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256, kept_text if wanted.

    ``width`` counts bytes, or words (``[^\\x20\\x09-\\x0D]+``) if ``unit`` is ``words``; removed words take the white space
    after them along.  ``kept_sha256`` is of the remaining bytes; ``kept_text`` leaves characters whole that a removed run
    only cuts.  With ``passages``, n_passage_words counts the words covered by strings of so many words that are elsewhere
    too; they are only counted.  Null text counts as empty; null ids are ids like others; texts under ``width`` lose nothing;
    an empty table gives an empty result; columns other than those named are ignored, whatever their names.
    """
    names = [id_col, *keep]
    own = [F.xxhash64(id_col).alias("__k1"), F.xxhash64(text_col).alias("__k2")]
    keyed = docs.select(*names, *own, F.col(text_col).alias("__text"))
    spans = repeated_spans(docs, text_col=text_col, id_col=id_col, width=width, unit=unit, hot_bytes=hot_bytes)
    spans = spans.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"))
    some = sieve(keyed, F.col("__k1").bitwiseXOR(F.col("__k2")), spans.select(F.col("__k1").bitwiseXOR(F.col("__k2")).alias("k")), "repeating-documents")
    rest = some.where("not __maybe").drop("__maybe").withColumn("__spans", F.lit(None).cast("array<struct<a:int,b:int>>"))
    joined = some.where("__maybe").drop("__maybe").join(spans.hint("merge"), ["__k1", "__k2"], "left").select(*rest.columns).union(rest)
    held = ["__k1", "__k2"] if passages else []
    more = ["n_bytes", "n_removed", "n_spans"]
    fields = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in [*held, *more]), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if with_text else [])])
    out = stage(joined.mapInArrow(_remove([*names, *held], unit, with_text), fields), "kept-texts")
    if not passages:
        return out
    counted = repeated_spans(docs, text_col=text_col, id_col=id_col, width=passages, unit="words", hot_bytes=hot_bytes)
    counted = counted.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]).alias("n_passage_words"))
    return out.join(counted.hint("merge"), ["__k1", "__k2"], "left").withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0).cast("long"))).drop("__k1", "__k2")
