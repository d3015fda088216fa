"""Near-duplicate documents by BagMinHash and verified overlap.

A text is the bag of its shingles of ``words`` words, weighted by how often each occurs.  BagMinHash draws the
signature from Poisson processes over the weights: a shingle's weight axis is cut at the powers of two, each part has a
process of its own with a rate equal to the part's length, and a point counts for a bag if its place on the axis lies
below the bag's weight.  A point falls on one position of the signature, which keeps the earliest; two signatures agree
at a position with probability sum(min) / sum(max) of the weights, without bias.  Points come in order of time, and a
process ends once it is later than all positions of the signature, so a text costs about one point a shingle.

Signatures are banded; different texts that share a band's key are candidates.  In each bucket a lead is held against all
others: the text that has the most company in all of its buckets, so that copies meet the text they were made of.  A pair
is first told by one bit of each position of the signatures, inside the join: too many that differ put a link out of
the question (chance below 1e-8).  Links are verified on the whole bags.

A bucket whose texts are then all in one component is done, and so are the pairs with its lead.  In each of the others the
texts outside the largest component are strays.  Strays are dealt out in blocks of bounded rows and bytes, each against
itself, the other blocks of strays and the blocks of the largest component.  A task has all bags of its two blocks, finds
every link between them, and gives each text with the smallest id that it reaches there: a row a text, and none for a pair.
So no candidate is left out, copies cost one comparison a text, and only a bucket of texts that stay unlike costs more: each
of its texts goes to as many tasks as there are blocks of strays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.bytehash import arrow_text, mix64, shingles, word_hashes
from lexloom.llm.graph import block_roots, components
from lexloom.llm.storage import discard, in_slices, sieve, stage

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 25
CHUNK = 256
#: Rows and bytes of text in a block, and columns of a block's incidence matrix at a time.
BLOCK_ROWS, BLOCK_BYTES, COLUMNS = 256, 1 << 19, 2048
MAIN = 4  # times as large are the blocks of the main component
_FAR = np.float64(np.inf)


def bag(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles in ascending order and how often each occurs."""
    return np.unique(shingles(words, size), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima by sum of maxima; 0 for two empty bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    high = int(a[1].sum()) + int(b[1].sum()) - low
    return low / high if high else 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(owner: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """BagMinHash signatures ``[n, size]`` of bags given as rows (owner, item, weight); empty bags get zeros."""
    part = [np.zeros(len(item), np.int64)]
    row = [np.arange(len(item))]
    for k in range(1, int(weight.max(initial=1)).bit_length() + 1):  # part k holds the weights in [2^(k-1), 2^k)
        reach = np.flatnonzero(weight > 1 << (k - 1))
        row.append(reach)
        part.append(np.full(len(reach), k))
    row, part = np.concatenate(row), np.concatenate(part)
    own, most = owner[row], weight[row]
    low = np.where(part == 0, 0, 1 << np.maximum(part - 1, 0))
    length = np.where(part == 0, 1, low)
    state = mix64(item[row] + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.zeros(len(row))
    best, name = np.full(n * size, _FAR), np.zeros(n * size, np.uint64)
    late = np.full(n, _FAR)
    alive = np.arange(len(row))
    while len(alive):
        draw = mix64(state[alive] + np.uint64(0xA0761D6478BD642F))
        state[alive] = draw
        at[alive] -= np.log(_unit(draw)) / length[alive]
        alive = alive[at[alive] < late[own[alive]]]
        second = mix64(state[alive] ^ np.uint64(0xE7037ED1A0B428DB))
        third = mix64(state[alive] ^ np.uint64(0x8EBC6AF09C88C6E3))
        counts = alive[low[alive] + np.floor((_unit(third) - 2.0**-53) * length[alive]) < most[alive]]
        slot = own[alive] * size + (second % np.uint64(size)).astype(np.int64)
        taken = np.isin(alive, counts, assume_unique=True) if len(counts) < len(alive) else slice(None)
        slot, time, code = slot[taken], at[alive][taken], second[taken]
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        name[slot[won]] = code[won]
        late = best.reshape(n, size).max(axis=1)
    return name.reshape(n, size)


def _sign(words: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 512):
                batch = whole.slice(begin, 512)
                hashes, ends = word_hashes(*arrow_text(batch.column("text")))
                bags = [bag(hashes[a:b], words) for a, b in zip(ends, ends[1:], strict=False)]
                owner = np.repeat(np.arange(len(bags)), [len(x[0]) for x in bags])
                found = signatures(owner, np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags]), len(bags), rows * bands)
                full = np.diff(ends) > 0
                code = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(bags), 0)
                for k in range(rows):
                    code = mix64(code * np.uint64(0xD6E8FEB86659FD93) + found[:, k::rows])
                offsets = np.append(0, np.cumsum(full * bands)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[full].ravel().view(np.int64)))
                low = np.zeros((len(bags), 128), np.uint64)
                low[:, : min(128, rows * bands)] = found[:, :128] & np.uint64(1)
                s1, s2 = (np.bitwise_or.reduce(low[:, a : a + 64] << np.arange(64, dtype=np.uint64), axis=1).view(np.int64) for a in (0, 64))
                size = pa.array(np.diff(arrow_text(batch.column("text"))[1]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t1"), batch.column("t2"), keys, pa.array(s1), pa.array(s2), size], names=["doc_id", "t1", "t2", "keys", "s1", "s2", "size"])

    return run


def _verify(words: int, least: float):
    """Rows (lead, part, member, text), the lead's own first, to verified links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, []
        for whole in batches:
            a, b = [], []
            for begin in range(0, len(whole), 256):
                batch = whole.slice(begin, 256)
                hashes, ends = word_hashes(*arrow_text(batch.column("text")))
                for i, (x, y) in enumerate(zip(batch.column("lead").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                    mine = bag(hashes[ends[i] : ends[i + 1]], words)
                    if x == y:
                        lead, own = x, [*own, mine] if lead == x else [mine]  # several texts of one id
                    elif lead == x and any(overlap(z, mine) >= least for z in own):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def overlaps(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of bags with bags: a shingle that occurs k times is k items, so the bags are sets of items."""

    def items(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        times = np.concatenate([x[1] for x in bags]).astype(np.int64)
        turn = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
        size = np.array([int(x[1].sum()) for x in bags])
        return mix64(np.repeat(np.concatenate([x[0] for x in bags]), times) + turn * np.uint64(0xA0761D6478BD642F)), np.repeat(np.arange(len(bags)), size), size

    x, own_x, size_x = items(a)
    y, own_y, size_y = items(b)
    both = np.intersect1d(x, y)
    low = np.zeros((len(a), len(b)))

    def columns(item: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(both, item)
        held = np.flatnonzero(both[np.minimum(place, len(both) - 1)] == item)
        held = held[np.argsort(place[held], kind="stable")]
        return place[held], owner[held]

    if len(both):
        (cx, rx), (cy, ry) = columns(x, own_x), columns(y, own_y)
        for begin in range(0, len(both), COLUMNS):
            left, right = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
            for column, row, into in ((cx, rx, left), (cy, ry, right)):
                i, j = np.searchsorted(column, [begin, begin + COLUMNS])
                into[row[i:j], column[i:j] - begin] = 1
            low += left @ right.T
    high = size_x[:, None] + size_y[None] - low
    return np.where(high > 0, low / np.maximum(high, 1), 0.0)


def _settle(words: int, least: float):
    """Sorted rows (key, i, j, own, doc_id, component, text) of a pair of blocks to (node, smallest node reached) where they differ."""

    def reach(i: int, j: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        first, second = [x for x in rows if x[0] == i], [x for x in rows if x[0] == j]
        nothing = np.empty(0, np.int64)
        if not first or not second or len({x[2] for x in rows}) < 2:
            return nothing, nothing
        name_x, name_y, part_x, part_y = (np.array([x[k] for x in part], np.int64) for k in (1, 2) for part in (first, second))
        near = (overlaps([x[3] for x in first], [x[3] for x in second]) >= least) & (part_x[:, None] != part_y[None])
        root_x, root_y = block_roots(near, name_x, name_y, i == j)
        found = [(n[n != r], r[n != r]) for n, r in ((name_x, root_x), (name_y, root_y))]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            found = []
            hashes, ends = word_hashes(*arrow_text(batch.column("text")))
            for k, (key, i, j, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "own", "doc_id", "component")), strict=True)):
                if (key, i, j) != now:
                    if rows:
                        found.append(reach(*now[1:], rows))
                    now, rows = (key, i, j), []
                rows.append((*row, bag(hashes[ends[k] : ends[k + 1]], words)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in reach(*now[1:], rows)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose bags overlap enough; a text goes to the tasks once for each of its pairs."""
    dealt = pairs.select(F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.lit(1 << 20)).alias("salt"), F.col("b").alias("doc_id"))
    parts = pairs.groupBy(F.col("a").alias("lead")).agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = dealt.join(parts, "lead").select("doc_id", "lead", F.pmod("salt", "parts").cast("long").alias("part"))
    heads = parts.select(F.col("lead").alias("doc_id"), "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rows = texts.join(dealt.union(heads), "doc_id").repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("doc_id") != F.col("lead"))
    return rows.select("lead", "doc_id", "text").mapInArrow(in_slices(_verify(words, least)), "a long, b long")


def _may_link(size: int, least: float):
    """A test of pairs by one bit of each position of their signatures: no more of them differ than in any link.

    Half of the positions that disagree show it, so at the least similarity the number that differ has mean
    ``n (1 - least) / 2``; six deviations more have a chance below 1e-8.
    """
    n, p = min(size, 128), (1 - least) / 2
    most = int(n * p + 6 * (n * p * (1 - p)) ** 0.5)
    return F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b"))) <= most


def _among(texts: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Without most of the texts whose id isn't in ``ids(id)``, before anything is shuffled."""
    return sieve(texts, F.col("doc_id"), ids, name).where("__maybe").drop("__maybe")


def _settled(held: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """``held(key, doc_id, component, size)``: links (a, b) between components that share a bucket, enough of them to tell what reaches what."""
    parts = held.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = F.max(F.struct("n", "size", "component"))
    parts = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), largest.alias("main"))
    blocks = lambda n, size, times: F.ceil(F.greatest(n / (BLOCK_ROWS * times), size / (BLOCK_BYTES * times), F.lit(1))).cast("int")
    parts = parts.select("key", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"), 1).alias("strays"), blocks(F.col("main.n"), F.col("main.size"), MAIN).alias("mains"))
    is_main, spread = F.col("component") == F.col("main"), lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    own = F.when(is_main, F.col("strays") + spread("mains")).otherwise(spread("strays"))
    last = F.when(is_main, F.col("strays")).otherwise(F.col("strays") + F.col("mains")) - 1
    dealt = held.join(parts, "key").select("key", "doc_id", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component")
    rows = dealt.join(_among(texts, held.select(F.col("doc_id").alias("id")), "open-texts"), "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.select("key", "i", "j", "own", "doc_id", "component", "text").mapInArrow(in_slices(_settle(words, least)), "a long, b long")


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, least: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``(doc_id, class_id, kept)``: a row for each row of ``docs``; class_id is the smallest id that links reach.

    Texts equal to the byte are one class without being compared.  Texts with fewer words than a shingle are one
    shingle; texts without a word, null ones among them, link with their exact copies only, and null with null.  Rows
    that share an id are one document, whose texts all count.  A null id has a null class, links nothing and is kept.
    An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col, F.length(text_col)).alias("t2"), F.col(text_col).alias("text"))
    named = base.where("doc_id is not null")
    signed = stage(named.mapInArrow(in_slices(_sign(words, rows, bands)), "doc_id long, t1 long, t2 long, keys array<long>, s1 long, s2 long, size long"), "signatures")
    first = stage(signed.groupBy("t1", "t2").agg(F.min("doc_id").alias("first")), "texts")
    several = signed.groupBy("doc_id").agg(F.min(F.struct("t1", "t2")).alias("low"), F.max(F.struct("t1", "t2")).alias("high")).where("low <> high").select("doc_id")
    copies = signed.select("doc_id", "t1", "t2").join(several, "doc_id", "left_semi").join(first, ["t1", "t2"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b")).where("a <> b")  # ids of several texts tie those together
    nodes = signed.join(first.select("t1", "t2", F.col("first").alias("doc_id")), ["t1", "t2", "doc_id"])
    bits = stage(nodes.select("doc_id", "s1", "s2").distinct(), "signature-bits")
    bucket = stage(nodes.select(F.explode("keys").alias("key"), "doc_id", "size").groupBy("key", "doc_id").agg(F.sum("size").alias("size")), "buckets")
    sets = bucket.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("members")).where("n > 1")
    sets = sets.groupBy("n", "members").agg(F.min("key").alias("key"), (F.first("n") * F.count("*")).alias("company"))  # buckets of the same texts are one
    shared = stage(bucket.join(sets.select("key", "company"), "key"), "shared-buckets")
    discard(bucket)
    company = shared.groupBy("doc_id").agg(F.sum("company").alias("company"))
    lead = shared.select("key", "doc_id").join(company, "doc_id").groupBy("key").agg((-F.max(F.struct("company", (-F.col("doc_id")).alias("id")))["id"]).alias("a"))
    shared = stage(shared.select("key", "doc_id", "size").join(lead, "key"), "led-buckets")
    texts = named.select("doc_id", "text")
    side = lambda x: bits.select(F.col("doc_id").alias(x), F.col("s1").alias(f"s1_{x}"), F.col("s2").alias(f"s2_{x}"))
    pairs = shared.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    pairs = stage(pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(rows * bands, least)).select("a", "b").distinct(), "star-pairs")
    near = _among(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), "star-texts")
    links = stage(_verified(pairs, near, words, least).union(copies.select("a", "b")).distinct(), "star-links")
    label = components(links, "star")

    held = shared.where("a <> doc_id").select("key", "doc_id", "size").join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", "size", F.coalesce("component", "doc_id").alias("component"))
    apart = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    held = stage(held.join(apart, "key"), "open-buckets")
    discard(shared, pairs)
    if not held.isEmpty():
        more = stage(_settled(held, texts, words, least), "block-links")
        if not more.isEmpty():
            label = components(links.union(more), "all")
    label = label.select(F.col("node").alias("first"), "component")
    found = signed.select("doc_id", "t1", "t2").join(first, ["t1", "t2"]).join(label, "first", "left").select("doc_id", F.coalesce("component", "first").alias("class_id"))
    found = found.union(base.where("doc_id is null").select("doc_id", F.lit(None).cast("long")))
    return found.select("doc_id", "class_id", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
