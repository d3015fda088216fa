"""Packing of documents into sequences of a fixed number of tokens, by bin completion.

Documents are tokenised once; what the packing needs of them is how many pieces have which size, and that histogram
has no more rows than a sequence has tokens.  It is packed on the driver: ``complete`` takes the largest size left,
enumerates the undominated fillings of the space around it one after another, and searches them depth first with branch
and bound.  A filling is dominated if a larger piece that is left could stand in for one or two of its pieces, or another
piece fits beside them.  A branch is cut when its waste alone rules out fewer bins than the incumbent, which is a best-fit
decreasing packing at first.  A filling is tried as often as the counts allow and then less often, so the work depends on
the sizes, not on the number of documents.  Fillings and branches count against ``nodes``; whether the result is proven to
be the least, by the bound or as the search came to its end, is told in the column ``proven``.  Pieces then find their
place by their rank among the pieces of their size.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.storage import in_slices, stage

CAPACITY = 2048
Pattern = tuple[tuple[int, ...], int]


class _Units(dict):
    """Ids, as bytes, of `` unit``: a stretch of text without a space, with the space before it.

    A pre-token of the byte-level BPE never goes on over a single space that has no other white space beside it, so such
    stretches are tokenised apart.  Up to ``most`` of them are kept, those that come first and so the frequent ones.
    """

    def __init__(self, encode, most: int = 150_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, unit: str) -> bytes:
        found = np.array(self.encode(" " + unit), "<u4").tobytes()
        if len(self) < self.most:
            self[unit] = found
        return found


def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """A function from a text to its ids as little-endian unsigned 32-bit integers."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    slow = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if not ranks_path:
        return slow
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    units = _Units(fast)
    get = units.__getitem__
    beside = re.compile(r" \s|[^\S ] ").search

    def encode(text: str) -> bytes:
        if any(x in text for x in special):
            return slow(text)
        if beside(text):
            return np.array(fast(text), "<u4").tobytes()
        first, _, rest = text.partition(" ")
        return np.array(fast(first), "<u4").tobytes() + (b"".join(map(get, rest.split(" "))) if _ else b"")

    return encode


def tokenizer_files() -> tuple[str, str, str]:
    """The byte-level BPE of the public tokenizers: its file, the same vocabulary as ranks, and its pattern."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def _pieces(files, capacity: int):
    """Rows (doc_id, text) to the pieces of each document, with the piece's rank among those of its size in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task, end = encoder(*(files or tokenizer_files())), Counter(), TaskContext.get().partitionId(), np.zeros(1, "<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    rows.append((k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a]))
                    seen[b - a] += 1
            if rows:
                k, a, n, crc, rank = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), k, a, n, crc, pa.array(np.full(len(at), task, np.int32)), rank], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return run


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, many equal bins at a time."""
    spaces: dict[int, list[Pattern]] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            space = min((s for s in spaces if s >= size and spaces[s]), default=None)
            if space is None:
                each = min(capacity // size, left)
                bins = left // each
                spaces[capacity - each * size].append(((size,) * each, bins))
                left -= each * bins
                continue
            pattern, bins = spaces[space].pop()
            use = min(bins, left)
            if use < bins:
                spaces[space].append((pattern, bins - use))
            spaces[space - size].append(((*pattern, size), use))
            left -= use
    return [x for group in spaces.values() for x in group]


class _Spent(Exception):
    """The search has used up its nodes."""


def fillings(left: np.ndarray, space: int, waste: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``space`` but for ``waste`` at most with sizes that are left, larger pieces first.

    A piece that fills the rest to the last token is better than any set of pieces there, so nothing else is tried then.
    """

    def dominated(chosen: tuple[int, ...], rest: int) -> bool:
        if left[1 : rest + 1].any():
            return True
        sums = {*chosen, *(a + b for k, a in enumerate(chosen) for b in chosen[k + 1 :])} if rest else set()
        return any(left[x + 1 : x + rest + 1].any() for x in sums)

    def walk(top: int, rest: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        budget[0] -= 1
        if budget[0] < 0:
            raise _Spent
        if 0 < rest <= top and left[rest]:
            yield (*chosen, rest)
            return
        here = np.flatnonzero(left[: min(top, rest) + 1])[::-1].tolist()
        if not here and rest <= waste and not dominated(chosen, rest):
            yield chosen
        for s in here:
            left[s] -= 1
            yield from walk(s, rest - s, (*chosen, s))
            left[s] += 1

    yield from walk(space, space, ())


def complete(counts: dict[int, int], capacity: int, *, nodes: int = 20_000) -> tuple[list[Pattern], bool]:
    """Patterns of sizes and how many bins each fills, by bin completion; and whether fewer bins are ruled out."""
    total = sum(s * n for s, n in counts.items())
    incumbent = best_fit(counts, capacity)
    half = sum(n for s, n in counts.items() if 2 * s > capacity)  # no two of them share a bin
    least = max(-(-total // capacity), half)
    most = sum(n for _, n in incumbent)
    budget = [nodes]

    def search(left: dict[int, int], used: int, waste: int, path: list[Pattern]) -> None:
        nonlocal incumbent, most
        if not left:
            if used < most:
                incumbent, most = list(path), used
            return
        budget[0] -= 1
        if budget[0] < 0:
            raise _Spent
        big = max(left)
        room = (most - 1) * capacity - total - waste  # waste that a better packing may still have
        if room < 0:
            return
        array = np.zeros(capacity + 1, np.int64)
        for s, n in left.items():
            array[s] = n
        array[big] -= 1
        for way in fillings(array, capacity - big, min(room, capacity), budget):  # on counts of its own
            pattern = (big, *way)
            use = Counter(pattern)
            lost = capacity - sum(pattern)
            for times in range(min(left[s] // n for s, n in use.items()), 0, -1):
                if most <= least:
                    return
                if waste + lost * times > (most - 1) * capacity - total:
                    continue
                rest = {s: n - use.get(s, 0) * times for s, n in left.items() if n - use.get(s, 0) * times}
                path.append((pattern, times))
                search(rest, used + times, waste + lost * times, path)
                path.pop()

    if most > least:
        try:
            search(dict(counts), 0, 0, [])
        except (_Spent, RecursionError):
            return incumbent, most <= least
    return incumbent, True


def _places(patterns: list[Pattern]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each size the first rank of each stretch, and its first sequence, pieces a sequence and first offset."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = defaultdict(lambda: ([], []))
    used, sequence = Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            out[size][0].append(used[size])
            out[size][1].append((sequence, each, offset))
            used[size] += each * times
            offset += size * each
        sequence += times
    return dict(out)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            sequence, offset = [], []
            for size, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                first, stretch = places[size]
                k = bisect_right(first, rank) - 1
                base, each, at = stretch[k]
                sequence.append(base + (rank - first[k]) // each)
                offset.append(at + (rank - first[k]) % each * size)
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, files: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; and whether fewer sequences are ruled out (``proven``).

    A document is its ids and then id 0; only one longer than ``capacity`` is cut, and its first piece takes what the
    full ones leave.  Null or empty text is id 0 alone; every row counts, repeated ids and texts too, null ids too; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    names = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(*x) for x in names), T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType())])
    pieces = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(in_slices(_pieces(files, capacity)), schema), "pieces-to-pack")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    by_task = by_task.select("length", "task", "n", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    by_task = stage(by_task, "piece-sizes")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    patterns, proven = complete(counts, capacity)
    shared = spark.sparkContext.broadcast(_places(patterns))
    ranked = pieces.join(by_task.select("length", "task", "before"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(*x) for x in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_assign(shared), out).withColumn("proven", F.lit(proven))
