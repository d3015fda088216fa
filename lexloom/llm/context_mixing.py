"""Scores of texts by a language model that mixes hashed-context bit predictors.

A token is coded as a walk down a binary tree: the frequent tokens are leaves of a Huffman tree, and so is one escape
for each first byte of all others, which are then spelt.  Each step is a bit.

*Along the text.*  Several predictors look up a hashed context, each with the node of the tree, in two layers.  Those of the
first are none, the last anchor word (one of the most frequent tokens) before this token, what kind of token came just
before, and both: a text's language and matter tell what comes next.  Those of the second are the whole token before,
whichever it is, and the whole two tokens before; they are mixed with what the first layer gives.  A predictor's counts are
smoothed towards those of the shorter context, its log-odds are mixed by weights that a gate picks (how often the contexts
were seen), and an adaptive table of gate and odds refines the result of each layer.

*Inside a spelt token.*  The bits of the bytes after the first are predicted by the last one to three bytes and by the whole
token so far, mixed and refined alike.  A token's own discounted count in the training texts is added to what the spelling
gives.

All is learnt online: a task goes through its texts slice by slice (or through its different tokens), predicts by the counts
it has so far, moves the weights against its errors, and only then counts.  Tasks are merged by adding up their counts and
averaging their weights by the bits they saw.  Every training text counts, whole.  How many different tokens there are,
their counts and their spellings grow with the corpus, are kept in tables and joined; what goes to every task (leaves,
anchors, hashed counts, the ``heavy`` most frequent tokens) is bounded by parameters.

The probabilities of all texts add up to one at most: leaves and escapes share out each step, and a token's share of its
escape is a discounted count plus what the discounts free, dealt out by spelling.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.bytehash import arrow_text, mix64, prefix_sums, ranges
from lexloom.llm.storage import discard, in_slices, stage

#: Most leaves that are tokens, and how often such a token occurs at least; anchors; tokens whose scores go to every task.
LEAVES, LEAST, ANCHORS, HEAVY, FLUSH = 1 << 14, 5, 31, 300_000, 600_000
KINDS = 4
#: Bytes of text that are tokenised at a time: words that recur in them are looked up once.
TEXT_BYTES = 8 << 20
#: Of them, tokens whose leaves, states and scores are held at a time, unless one text has more; different tokens hashed at a time.
PIECE, HASHED = 1 << 16, 1 << 14
#: Bits of the tables of hashed contexts along the text: none, anchor, kind before, both.
WORD_BITS = (15, 19, 17, 20)
#: Bits of those of whole tokens: the one before, the two before.
TOKEN_BITS = (20, 20)
#: Bytes of context inside a token (0: the token so far) and bits of its table.
ORDERS = ((1, 16), (2, 18), (3, 20), (0, 20))
_SPELL_BITS = tuple(b for _, b in ORDERS)
_LEVELS, _BUCKETS, _CHUNK, _RUN, _STEP, _PART = (0, 3, 30), 33, 1 << 13, 1 << 11, 1 << 20, 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


# --- tokens -----------------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """The tokens of a batch of texts: which of the different ones in ``coded`` each is, and its text; ends aren't among them."""

    coded: pa.Array
    word: np.ndarray
    doc: np.ndarray
    n: int

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        data, offsets = arrow_text(column)
        begin = pa.py_buffer(np.ascontiguousarray(offsets - offsets[0]))  # Arrow splits arrays that begin within a buffer wrongly
        whole = pa.LargeStringArray.from_buffers(len(column), begin, pa.py_buffer(np.ascontiguousarray(data[offsets[0] : offsets[-1]])))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(lists).dictionary_encode()
        word, named = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary())
        doc = np.repeat(np.arange(len(column), dtype=np.int32), size)
        empty = np.flatnonzero(pc.binary_length(named).to_numpy(zero_copy_only=False) == 0)
        if len(empty):  # before leading and after trailing white space
            real = word != empty[0]
            word, doc = word[real], doc[real]
        return cls(named, word, doc, len(column))

    @cached_property
    def words(self) -> list[bytes]:
        data, at = arrow_text(self.coded)
        raw, at = data.tobytes(), at.tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    @cached_property
    def first(self) -> np.ndarray:
        """The first byte of each of ``words``; 0 if it is empty."""
        data, at = arrow_text(self.coded)
        return np.where(np.diff(at) > 0, np.append(data, np.uint8(0))[at[:-1]], 0).astype(np.int64)

    def pieces(self, most: int = PIECE) -> Iterator[tuple[int, Tokens]]:
        """Texts in a row, whole, with ``most`` tokens in all unless one alone has more; the number of the first before each."""
        upto = np.append(0, np.cumsum(np.bincount(self.doc, minlength=self.n)))
        begin = 0
        while begin < self.n:
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + most, side="right")) - 1)
            some = slice(upto[begin], upto[end])
            yield begin, Tokens(self.coded, self.word[some], self.doc[some] - np.int32(begin), end - begin)
            begin = end

    def with_ends(self, value: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
        """A value for each token and, after each text's last one, ``end``; and ``n + 1`` offsets of the texts."""
        offsets = np.append(0, np.cumsum(np.bincount(self.doc, minlength=self.n) + 1))
        out = np.full(len(self.word) + self.n, end, value.dtype)
        out[np.arange(len(self.word)) + self.doc] = value[self.word]
        return out, offsets


def _find(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each of ``words`` is in ``among``, -1 if it isn't."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to (token, its count in training documents); the end of a text is the empty token."""
    known, other = Counter(), set()

    def out() -> pa.RecordBatch:
        words = [*known, *(w for w in other if w not in known)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([known.get(w, 0) for w in words], pa.int64())], names=["word", "c"])

    for batch in batches:
        tokens = Tokens.of(batch.column("text"))
        train = ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
        learnt = np.bincount(tokens.word[train[tokens.doc]], minlength=len(tokens.words))
        for w, n in zip(tokens.words, learnt.tolist(), strict=True):
            if n:
                known[w] += n
            elif w:
                other.add(w)
        if train.any():
            known[b""] += int(train.sum())
        if len(known) + len(other) > FLUSH:
            yield out()
            known, other = Counter(), set()
    yield out()


# --- mixing -----------------------------------------------------------------------------------------------------


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _stretch(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Mixer:
    """Weights by gate and the refining table; learns online from bits with their number of times."""

    def __init__(self, gates: int, start: tuple[float, ...]):
        self.weights = np.tile(np.array(start, np.float64), (gates, 1))
        self.steep = np.full_like(self.weights, 1e-3)
        self.refine = np.tile(_squash(np.linspace(-8, 8, _BUCKETS)), (gates, 1))
        self.bits = 0.0

    def odds(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(x.dtype)
        odds = x[:, 0] * weights[:, 0].take(gate, mode="clip")
        for i in range(1, x.shape[1]):
            odds += x[:, i] * weights[:, i].take(gate, mode="clip")
        return odds

    def refined(self, gate: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """The refined probability, between two buckets of odds."""
        at = (np.clip(odds, -8, 7.999) + 8) * ((_BUCKETS - 1) / 16)
        low = at.astype(np.int64)
        high = at - low.astype(at.dtype)
        spot, flat = gate * _BUCKETS + low, self.refine.astype(odds.dtype).ravel()
        return flat[spot] * (1 - high) + flat[spot + 1] * high

    def predict(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        odds = self.odds(x, gate)
        return np.clip((_squash(odds) + self.refined(gate, odds)) / 2, 1e-6, 1 - 1e-6)

    def learn(self, x: np.ndarray, gate: np.ndarray, ones: np.ndarray, times: np.ndarray) -> None:
        """A step against the error: of ``times`` bits with these inputs ``ones`` were one."""
        gates, k = self.weights.shape
        odds = self.odds(x, gate)
        error = ones - _squash(odds) * times
        spot = gate * _BUCKETS + np.rint((np.clip(odds, -8, 8) + 8) * ((_BUCKETS - 1) / 16)).astype(np.int64)
        total = np.bincount(spot, times, gates * _BUCKETS)
        seen = total.reshape(gates, -1).sum(axis=1)
        slope = np.stack([np.bincount(gate, error * x[:, i], gates) for i in range(k)], 1) / np.maximum(seen, 1)[:, None]
        self.steep += slope**2
        self.weights += 0.03 * slope / np.sqrt(self.steep)
        flat = self.refine.ravel()
        flat += (np.bincount(spot, ones, gates * _BUCKETS) - total * flat) / (total + 200)
        self.bits += float(times.sum())

    def vector(self) -> np.ndarray:
        """Everything that is merged, times the bits seen, and those."""
        return np.append(np.concatenate([self.weights.ravel(), self.refine.ravel()]) * self.bits, self.bits)

    def merge(self, vector: np.ndarray | None) -> Mixer:
        if vector is not None and vector[-1] > 0:
            mean, n = vector[:-1] / vector[-1], self.weights.size
            self.weights, self.refine = mean[:n].reshape(self.weights.shape), np.clip(mean[n:].reshape(self.refine.shape), 1e-5, 1 - 1e-5)
        return self


class Counts:
    """Zeros and ones of hashed contexts, a table for each predictor; both of a context lie side by side."""

    def __init__(self, bits: tuple[int, ...]):
        self.first = np.cumsum([0, *(1 << b for b in bits)])
        self.n = np.zeros((self.first[-1], 2), np.float32)

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.n.view(np.complex64)[:, 0].take(slots)
        return both.real, both.imag

    def ending(self, tables: int) -> Counts:
        """The last tables alone."""
        out = Counts(())
        out.first, out.n = self.first[-tables - 1 :] - self.first[-tables - 1], self.n[self.first[-tables - 1] :].copy()
        return out

    def add(self, slots: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        for row in slots:
            np.add.at(self.n.view(np.complex64)[:, 0], row, zeros + 1j * ones)

    def add_bits(self, slots: np.ndarray, bit: np.ndarray) -> None:
        for row in slots:
            np.add.at(self.n.reshape(-1), 2 * row + bit, np.float32(1))


def _levels(n: np.ndarray) -> np.ndarray:
    return sum((n > x).view(np.int8) for x in _LEVELS).astype(np.int64)


def _packed(counts: Counts, *mixers: Mixer) -> pa.RecordBatch:
    """A task's counts in parts and, as parts -1, -2 and so on, its weights."""
    rows = [(-1 - k, mixer.vector().tobytes()) for k, mixer in enumerate(mixers)]
    flat = counts.n.ravel()
    for k in range(0, len(flat), _PART):
        part = flat[k : k + _PART]
        if part.any():
            rows.append((k // _PART, part.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "salt", "vector"])


_PARTS = "part int, salt int, vector binary"


def _numbers(part: int, vector: bytes) -> np.ndarray:
    return np.frombuffer(vector, np.float64 if part < 0 else np.float32)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, vector in zip(batch.column("part").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            x = _numbers(part, vector)
            total[part] = total[part] + x if part in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "salt", "vector"])


def _merged(parts: DataFrame, name: str, counts: Counts, *mixers: Mixer) -> None:
    """Add up the tasks' parts, in two steps, into ``counts`` and ``mixers``; as many rows reach the driver as a task has parts."""
    some = parts.repartition("part", "salt").mapInArrow(_add_up, _PARTS)
    table = stage(some.repartition("part").mapInArrow(_add_up, _PARTS), name)
    flat = counts.n.ravel()
    for part, vector in zip(*(table.toArrow()[c].to_pylist() for c in ("part", "vector")), strict=True):
        x = _numbers(part, vector)
        if part < 0:
            mixers[-1 - part].merge(x)
        else:
            flat[part * _PART : part * _PART + len(x)] = x
    discard(table)


# --- along the text ---------------------------------------------------------------------------------------------


class Tree:
    """A Huffman tree over weights: the path of each leaf as nodes and bits; node 0 is the root, children come after it."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        heap = [(int(w), k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        above = np.zeros(2 * n - 1, np.int64)
        side = np.zeros(2 * n - 1, np.int8)
        new = n
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            above[[x, y]], side[y] = new, 1
            heapq.heappush(heap, (a + b, new))
            new += 1
        self.n, self.root = n, new - 1
        self.above, self.side = above, side
        self.depth = np.zeros(new, np.int64)
        for x in range(new - 2, -1, -1):
            self.depth[x] = self.depth[above[x]] + 1
        below = np.zeros((new, 2), np.int64)
        below[above[: new - 1], side[: new - 1]] = np.arange(new - 1)
        leaves = np.zeros(new, np.int64)
        leaves[:n] = 1
        for x in range(n, new):
            leaves[x] = leaves[below[x, 0]] + leaves[below[x, 1]]
        first = np.zeros(new, np.int64)
        for x in range(new - 1, n - 1, -1):
            first[below[x, 0]], first[below[x, 1]] = first[x], first[x] + leaves[below[x, 0]]
        self.rank = first[:n]  # of leaves, from left to right; a node's leaves are [low, high), those of its bit one [mid, high)
        inner = np.arange(self.root, n - 1, -1)
        self.low, self.mid, self.high = first[inner], first[inner] + leaves[below[inner, 0]], first[inner] + leaves[inner]
        at = np.arange(n)
        steps = []
        for _ in range(int(self.depth[:n].max(initial=0))):
            up = at != self.root
            steps.append((np.where(up, self.root - above[at], -1), np.where(up, side[at], 0)))
            at = np.where(up, above[at], self.root)
        nodes = np.stack([s[0] for s in steps], 1) if steps else np.empty((n, 0), np.int64)
        bits = np.stack([s[1] for s in steps], 1) if steps else np.empty((n, 0), np.int8)
        real = nodes >= 0
        self.size = real.sum(axis=1)
        self.start = np.append(0, np.cumsum(self.size))
        self.nodes, self.bits = nodes[real].astype(np.int64), bits[real].astype(np.int8)
        top, place = np.arange(n - 1), np.ones(n - 1, np.int64)  # of every three levels the top node, and the place below it, 1 to 7
        for node in range(1, n - 1):
            up, bit = self.root - above[self.root - node], side[self.root - node]
            if place[up] < 4:
                top[node], place[node] = top[up], 2 * place[up] + bit
        mark = mix64((top + 1).astype(np.uint64) * _ODD[0])
        self.marks = {b: mark ^ place.astype(np.uint64) << np.uint64(64 - b) for b in TOKEN_BITS}
        self.both = (self.nodes << 1 | self.bits).astype(np.int32)

    def steps(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For leaves one after another: which of them, the node and the bit of each step."""
        size = self.size[leaf]
        row = np.repeat(np.arange(len(leaf)), size)
        at = np.arange(len(row)) + np.repeat(self.start[leaf] - np.cumsum(size) + size, size)
        return row, self.nodes[at], self.bits[at]

    def path(self, leaf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``steps``, the nodes and bits alone."""
        at = np.repeat(self.start[leaf] - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        both = self.both.take(at, mode="clip")
        return (both >> 1).astype(np.int64), (both & 1).astype(np.int8)

    def leaves(self, one: np.ndarray) -> np.ndarray:
        """Log10 of each leaf's probability from those of bit one at the inner nodes; rows are states."""
        out = np.zeros((len(one), 2 * self.n - 1))
        logs = np.log10(1 - one), np.log10(one)
        for depth in range(1, int(self.depth.max(initial=0)) + 1):
            x = np.flatnonzero(self.depth == depth)
            up = self.above[x]
            node = self.root - up
            out[:, x] = out[:, up] + np.where(self.side[x] == 1, logs[1][:, node], logs[0][:, node])
        return out[:, : self.n].astype(np.float32)


def _state(anchor: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What comes before each token: the last anchor, from 1 on, and the kind of the token before; 0 at a text's begin.

    ``anchor`` and ``kind`` are of the tokens themselves, texts one after another."""
    n = len(anchor)
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    last = np.maximum.accumulate(np.where(anchor > 0, np.arange(n), -1)) if n else np.empty(0, np.int64)
    before = np.append(-1, last[:-1])[:n]
    inside = before >= begin
    first = np.arange(n) == begin
    return np.where(inside, anchor[np.maximum(before, 0)], 0) * KINDS + np.where(first, 0, np.append(0, kind[:-1])[:n])


def _word_slots(state: np.ndarray, node: np.ndarray, first: np.ndarray) -> np.ndarray:
    contexts = (np.zeros_like(state), state // KINDS + 1, state % KINDS + 1, state + 1)
    node = node.astype(np.uint64)
    out = np.empty((4, len(node)), np.int64)
    for k, (context, bits) in enumerate(zip(contexts, WORD_BITS, strict=True)):
        out[k] = (((context.astype(np.uint64) << np.uint64(32) | node) * _ODD[k]) >> np.uint64(64 - bits)).astype(np.int64) + first[k]
    return out


def _word_inputs(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ``[n, 5]`` of the predictors, each smoothed towards a shorter context, and the gate."""
    n = n0 + n1
    p0 = (n1[0] + 0.4) / (n[0] + 0.8)
    p1, p2 = ((n1[k] + 4 * p0) / (n[k] + 4) for k in (1, 2))
    p3 = (n1[3] + 4 * p1) / (n[3] + 4)
    x = np.stack([*(_stretch(p) for p in (p0, p1, p2, p3)), np.full(len(p0), 0.3, p0.dtype)]).T
    return x, _levels(n[1]) * 4 + _levels(n[3])


def _word_mixer() -> Mixer:
    return Mixer(16, (0.0, 0.5, 0.0, 0.5, 0.0))


class Leaves:
    """The leaf, anchor and kind of each token of a batch."""

    def __init__(self, words: list[bytes], anchors: int):
        self.place = {w: k for k, w in enumerate(words)}
        self.names = pa.array(words, pa.binary())
        self.size, self.anchors, self.end = len(words), anchors, self.place[b""]

    def named(self, tokens: Tokens, place: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each different token; ``place`` tells where it is in a list that begins with the leaves."""
        place = _find(tokens.coded, self.names) if place is None else place
        return np.where((place >= 0) & (place < self.size), place, self.size + tokens.first)

    def of(self, tokens: Tokens, named: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf and state of every token and end, and the offsets of the texts."""
        leaf, offsets = tokens.with_ends(self.named(tokens) if named is None else named, self.end)
        anchor = np.where((leaf < self.anchors + 1) & (leaf != self.end), leaf + 1, 0)
        kind = np.where(anchor > 0, 1, np.where(leaf < self.size, 2, 3))
        return leaf, _state(anchor, kind, offsets), offsets


def hash_words(tokens: Tokens) -> np.ndarray:
    """The hash of each different token.  They come from the bytes, so each has its own, however rare."""
    data, at = arrow_text(tokens.coded)
    out = np.empty(len(at) - 1, np.uint64)
    for a in range(0, len(out), HASHED):
        some = at[a : a + HASHED + 1]
        out[a : a + HASHED] = ranges(prefix_sums(data[some[0] : some[-1]]), some[:-1] - some[0], some[1:] - some[0]) | np.uint64(1)
    return out


def token_hashes(tokens: Tokens, hashed: np.ndarray | None = None) -> np.ndarray:
    """Two zeros and the hash of each token; ends have 0."""
    return np.append(np.zeros(2, np.uint64), tokens.with_ends(hash_words(tokens) if hashed is None else hashed, np.uint64(0))[0])


def prepared(tokens: Tokens, leaves: Leaves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf and state of every token and end, and ``token_hashes``; made piece by piece."""
    n = len(tokens.word) + tokens.n
    leaf, state, hashed = np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(n + 2, np.uint64)
    named, own, at = leaves.named(tokens), hash_words(tokens), 0
    for _, some in tokens.pieces():
        end = at + len(some.word) + some.n
        leaf[at:end], state[at:end], _ = leaves.of(some, named)
        hashed[at + 2 : end + 2] = some.with_ends(own, np.uint64(0))[0]
        at = end
    return leaf, state, hashed


def tokens_before(hashed: np.ndarray) -> np.ndarray:
    """Hashes ``[2, n]`` of the whole token before each token, and of the two before; ``hashed`` begins two tokens earlier.

    Nothing is taken from the text before: what follows an end has none before it."""
    one, two = hashed[1:-1], np.where(hashed[1:-1] == 0, np.uint64(0), hashed[:-2])
    return np.stack([mix64(one + _ODD[2]), mix64(two * _ODD[1] + one + _ODD[3])])


def _token_slots(before: np.ndarray, size: np.ndarray, node: np.ndarray, tree: Tree, first: np.ndarray) -> np.ndarray:
    """Slots of the steps of tokens, ``size`` each, by what ``tokens_before`` tells of these tokens.

    Three steps in a row lie side by side, at most eight slots from each other."""
    out = np.empty((len(TOKEN_BITS), len(node)), np.int64)
    mark = {b: x.take(node, mode="clip") for b, x in tree.marks.items()}
    for k, bits in enumerate(TOKEN_BITS):
        slot = np.repeat(before[k], size)
        slot ^= mark[bits]
        slot >>= np.uint64(64 - bits)
        np.add(slot.view(np.int64), first[k - len(TOKEN_BITS) - 1], out=out[k])
    return out


def _token_inputs(p: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ``[n, 4]`` of the first layer's ``p`` and of the whole tokens before, smoothed alike, and the gate."""
    x = np.empty((4, len(p)), p.dtype)
    x[0], x[3] = np.log(p / (1 - p)), 0.3
    gate = np.zeros(len(p), np.int8)
    for k, weight in enumerate((4, 2)):
        if k:
            p = np.clip(ones / n, 1e-6, 1 - 1e-6)  # noqa: F821
        ones, zeros = n1[k] + weight * p, n0[k] + weight * (1 - p)
        n = ones + zeros
        np.log(ones / zeros, out=x[k + 1])
        gate *= 4
        for level in _LEVELS:
            gate += (n > level + weight + 0.5).view(np.int8)
    return x.T, gate.astype(np.int64)


def _token_steps(leaf: np.ndarray, state: np.ndarray, before: np.ndarray, tree: Tree, given: np.ndarray, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots, log-odds, gates and bits of the second layer for the steps of leaves one after another."""
    size = tree.size[leaf]
    node, bit = tree.path(leaf, size)
    slots = _token_slots(before, size, node, tree, counts.first)
    x, gate = _token_inputs(given.ravel().take(np.repeat(state * np.int64(given.shape[1]), size) + node), *counts.of(slots))
    return slots, x, gate, bit


def _token_mixer() -> Mixer:
    return Mixer(16, (0.4, 0.3, 0.3, 0.0))


def learn_words(leaf: np.ndarray, state: np.ndarray, hashed: np.ndarray, tree: Tree, counts: Counts, mixer: Mixer, last: Mixer, draw: np.random.Generator) -> None:
    """One step of learning: predict the tokens by the counts so far, move the weights of both layers, then count.

    For the first layer equal tokens in equal states are one, and so are equal nodes, with their numbers of zeros and ones."""
    inner, top = tree.n - 1, int(state.max()) + 1
    if not inner:
        return
    upto = np.zeros((top, tree.n + 1), np.int32)
    np.cumsum(np.bincount(state * np.int64(tree.n) + tree.rank[leaf], minlength=top * tree.n).reshape(top, -1), axis=1, out=upto[:, 1:])
    total = upto[:, tree.high]
    total -= upto[:, tree.low]
    total = total.ravel()
    at = draw.permutation(np.flatnonzero(total))
    of, node = np.divmod(at, inner)
    total, ones = total[at], upto[of, tree.high[node]] - upto[of, tree.mid[node]]
    del upto
    slots = _word_slots(of, node, counts.first)
    given = np.empty(top * inner, np.float32)
    for a in range(0, len(at), _CHUNK):
        some = slice(a, a + _CHUNK)
        x, gate = _word_inputs(*counts.of(slots[:, some]))
        given[at[some]] = mixer.predict(x, gate)
        mixer.learn(x, gate, ones[some], total[some])
    counts.add(slots, (total - ones).astype(np.float32), ones.astype(np.float32))
    for a in range(0, len(leaf), _RUN):
        some = slice(a, a + _RUN)
        slots, x, gate, bit = _token_steps(leaf[some], state[some], tokens_before(hashed[a : a + _RUN + 2]), tree, given.reshape(top, -1), counts)
        last.learn(x, gate, bit, np.ones(len(bit), np.float32))
        counts.add_bits(slots, bit)


def _learn_words(shared):
    """Training documents to the counts and weights of a task; its steps double from 2**14 tokens to ``_STEP``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, tree = shared.value
        counts, mixer, last = Counts((*WORD_BITS, *TOKEN_BITS)), _word_mixer(), _token_mixer()
        draw, step = np.random.Generator(np.random.PCG64(7)), 1 << 14
        for batch in batches:
            leaf, state, hashed = prepared(Tokens.of(batch.column("text")), leaves)
            at = 0
            while at < len(leaf):
                some = slice(at, at + step)
                learn_words(leaf[some], state[some], hashed[at : at + step + 2], tree, counts, mixer, last, draw)
                at, step = at + step, min(2 * step, _STEP)
        yield _packed(counts, mixer, last)

    return in_slices(run, most=TEXT_BYTES, gather=True)


def node_scores(tree: Tree, counts: Counts, mixer: Mixer, states: int) -> np.ndarray:
    """The first layer's probability of bit one at each inner node in each state."""
    inner = tree.n - 1
    one = np.empty((states, inner))
    node = np.arange(inner)
    for s in range(states):
        slots = _word_slots(np.full(inner, s), node, counts.first)
        one[s] = mixer.predict(*_word_inputs(*counts.of(slots)))
    return one


def leaf_scores(tree: Tree, counts: Counts, mixer: Mixer, states: int) -> np.ndarray:
    """Log10 of each leaf's probability in each state by the first layer alone."""
    return tree.leaves(node_scores(tree, counts, mixer, states))


def walk_scores(leaf: np.ndarray, state: np.ndarray, hashed: np.ndarray, tree: Tree, given: np.ndarray, counts: Counts, last: Mixer) -> np.ndarray:
    """Log10 of the probability of each leaf, in its state and after the tokens before; ``given`` is the first layer's, ``counts`` end with the second's."""
    out = np.zeros(len(leaf))
    for a in range(0, len(leaf), _RUN):
        some = slice(a, a + _RUN)
        _, x, gate, bit = _token_steps(leaf[some], state[some], tokens_before(hashed[a : a + _RUN + 2]), tree, given, counts)
        size = tree.size[leaf[some]]
        out[some] = np.add.reduceat(np.log(np.abs(1 - bit - last.predict(x, gate))), np.cumsum(size) - size)
    return out / np.log(10)


# --- inside a token ---------------------------------------------------------------------------------------------


def _spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots ``[orders, n]``, bits and each bit's word, for the bits after the first byte of all words, with their closing spaces."""
    data = np.frombuffer(b" " + b"".join(w + b" " for w in words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    head = np.cumsum(sizes) - sizes  # the space before the word
    at = np.arange(1, len(data))
    later = at - 1 != np.repeat(head, sizes)
    at, word = at[later], np.repeat(np.arange(len(words)), sizes)[later]
    head = head[word]
    sums = prefix_sums(data)
    byte = data[at, None].astype(np.int64)
    step = np.arange(8)
    node = ((1 << step) | (byte >> (8 - step))).astype(np.uint64) * _ODD[0]
    first = np.cumsum([0, *(1 << b for b in _SPELL_BITS)])
    slots = np.empty((len(ORDERS), 8 * len(at)), np.int64)
    for k, (order, size) in enumerate(ORDERS):
        context = ranges(sums, np.maximum(head, at - order) if order else head, at)
        slots[k] = (((context[:, None] + node) * _ODD[1]) >> np.uint64(64 - size)).ravel().astype(np.int64) + first[k]
    return slots, ((byte >> (7 - step)) & 1).ravel().astype(np.int8), np.repeat(word, 8)


def _spell_inputs(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As along the text: each order is smoothed towards the one before."""
    n = n0 + n1
    p = (n1[0] + 0.4) / (n[0] + 0.8)
    held = [p]
    for k in range(1, len(ORDERS)):
        p = (n1[k] + 2 * p) / (n[k] + 2)
        held.append(p)
    x = np.stack([*(_stretch(p) for p in held), np.full(n.shape[1], 0.3, n.dtype)]).T
    return x, _levels(n[2]) * 4 + _levels(n[3])


def _spell_mixer() -> Mixer:
    return Mixer(16, (0.0, 0.0, 0.5, 0.5, 0.0))


def _learn_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different tokens, each once, to the counts and weights of a task."""
    counts, mixer = Counts(_SPELL_BITS), _spell_mixer()
    for batch in batches:
        words = batch.column("word").to_pylist()
        for a in range(0, len(words), 500):
            slots, bit, _ = _spelling(words[a : a + 500])
            once = np.ones(len(bit), np.float32)
            mixer.learn(*_spell_inputs(*counts.of(slots)), bit, once)
            counts.add_bits(slots, bit)
    yield _packed(counts, mixer)


def spelt(words: list[bytes], counts: Counts, mixer: Mixer, most: int = 500) -> np.ndarray:
    """Log10 of the probability of each word's bytes after the first."""
    out = [np.empty(0)]
    for a in range(0, len(words), most):
        part = words[a : a + most]
        slots, bit, word = _spelling(part)
        p = mixer.predict(*_spell_inputs(*counts.of(slots)))
        out.append(np.bincount(word, np.log(np.abs(1 - bit - p)), len(part)))
    return np.concatenate(out) / np.log(10)


def backed_off(count: np.ndarray, spelling: np.ndarray, n: np.ndarray, v: np.ndarray, discount: float) -> np.ndarray:
    """Log10 of a token's probability among those of its escape: its own discounted count out of ``n``, and what the
    discounts of ``v`` different tokens free by how it is spelt."""
    rest = spelling + np.log10(np.where(n > 0, discount * v / np.maximum(n, 1), 1.0))
    known = count > 0
    rest[known] = np.log10((count[known] - discount) / n[known] + 10.0 ** rest[known])
    return rest


def _score_words(model, n: int, v: int, discount: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mixer, total, kinds = model.value
        for batch in batches:
            words, count = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            first = np.array([w[0] for w in words], np.int64)
            extra = backed_off(count, spelt(words, counts, mixer), total[first], kinds[first], discount) if words else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(_base(count, n, v)), pa.array(extra)], names=["word", "c", "base", "extra"])

    return run


def _base(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((count + 0.1) / (n + 0.1 * (v + 1)))


# --- texts ------------------------------------------------------------------------------------------------------


def _score_texts(shared):
    """Documents to a row each, with what frequent tokens add up to, and a row for each other token in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, tree, given, contexts, last, words, count, base, extra = shared.value
        figures = [np.append(x, 0.0) for x in (count > 0, base, extra)]  # none for the tokens that aren't in the list
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            tokens, n = Tokens.of(batch.column("text")), len(batch)
            place = _find(tokens.coded, words)
            named, hashed = leaves.named(tokens, place), hash_words(tokens)
            walk, known, low, more = np.empty((4, n))
            for begin, some in tokens.pieces():
                own = slice(begin, begin + some.n)
                leaf, state, offsets = leaves.of(some, named)
                doc = np.repeat(np.arange(some.n), np.diff(offsets))
                walk[own] = np.bincount(doc, walk_scores(leaf, state, token_hashes(some, hashed), tree, given, contexts, last), some.n)
                at, _ = some.with_ends(place, leaves.end)
                for x, figure in zip((known, low, more), figures, strict=True):
                    x[own] = np.bincount(doc, figure[at], some.n)
            size_in_tokens = np.bincount(tokens.doc, minlength=n) + 1
            rare = place[tokens.word] < 0
            pair, times = np.unique(tokens.doc[rare] * np.int64(max(len(place), 1)) + tokens.word[rare], return_counts=True)
            own, which = pair // max(len(place), 1), pair % max(len(place), 1)
            none = lambda x, k: pa.concat_arrays([x, pa.nulls(k, x.type)])
            r, size = len(pair), pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.arange(row, row + n), row + own])),
                    none(batch.column("doc_id"), r), none(batch.column("held_out"), r), none(size, r), none(pa.array(size_in_tokens), r), none(pa.array(known.astype(np.int64)), r), none(pa.array(low), r), none(pa.array(walk + more), r),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), tokens.coded.take(pa.array(which))]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times.astype(np.int64))]),
                ],
                names=["row", "doc_id", "held_out", "size", "n_tokens", "n_known", "base", "score", "word", "times"],
            )
            row += n

    return in_slices(run, most=TEXT_BYTES, gather=True)


def score_texts(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", folds: int = 10, leaves: int = LEAVES, anchors: int = ANCHORS, heavy: int = HEAVY, least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Documents whose ``crc32`` of the id as text is 0 modulo ``folds`` are held out; all others are learnt from, every
    token of each.  ``bits_per_byte`` is the score in bits for each byte of the text, null for a text without one.  Null or
    empty text is its end alone; a null id counts as an empty one; repeated rows are learnt from as often as they are
    there; an empty table gives an empty result; other columns are ignored.  Weights are averages over tasks, so scores differ a
    little with how the input is dealt out.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0).alias("held_out"))
    words = stage(base.select("text", "held_out").mapInArrow(in_slices(_count_words, most=TEXT_BYTES, gather=True), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    n, v, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    top = words.where(F.col("c") >= least).where("word <> X''").orderBy(F.desc("c"), "word").limit(leaves).toArrow()
    named, count = top["word"].to_pylist(), top["c"].to_numpy()
    low = (int(count[-1]), named[-1]) if named else (1 << 62, b"")
    is_leaf = (F.col("c") > low[0]) | ((F.col("c") == low[0]) & (F.col("word") <= F.lit(bytearray(low[1])))) | (F.length("word") == 0)
    spelled = words.where(~is_leaf)
    first = F.conv(F.hex(F.substring("word", 1, 1)), 16, 10).cast("int")
    total, kinds = np.zeros(256), np.zeros(256)
    for r in spelled.where("c > 0").groupBy(first.alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # 256 rows at most
        total[r["b"]], kinds[r["b"]] = r["n"], r["v"]
    ends = words.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    anchors = min(anchors, len(named))
    listed = Leaves([*named[:anchors], b"", *named[anchors:]], anchors)
    count = np.insert(count, anchors, ends)
    tree = Tree(np.concatenate([np.maximum(count, 1), total + 1]))
    shared = spark.sparkContext.broadcast((listed, tree))
    contexts, mixer, last = Counts((*WORD_BITS, *TOKEN_BITS)), _word_mixer(), _token_mixer()
    _merged(base.where("not held_out").select("text").mapInArrow(_learn_words(shared), _PARTS), "context-counts", contexts, mixer, last)
    given = node_scores(tree, contexts, mixer, (anchors + 2) * KINDS).astype(np.float32)

    letters, speller = Counts(_SPELL_BITS), _spell_mixer()
    _merged(words.where("c > 0").where("length(word) > 0").select("word").mapInArrow(_learn_spelling, _PARTS), "spelling-counts", letters, speller)
    model = spark.sparkContext.broadcast((letters, speller, total, kinds))
    scored = stage(spelled.mapInArrow(_score_words(model, n, v, discount), "word binary, c long, base double, extra double"), "scored-words")
    more = scored.orderBy(F.desc("c"), "word").limit(max(heavy - len(count), 0)).toArrow()
    names = pa.concat_arrays([listed.names, more["word"].combine_chunks().cast(pa.binary())])
    frequent = (names, np.append(count, more["c"].to_numpy()), np.append(_base(count, n, v), more["base"].to_numpy()), np.append(np.zeros(len(count)), more["extra"].to_numpy()))
    known = spark.sparkContext.broadcast((listed, tree, given, contexts.ending(len(TOKEN_BITS)), last, *frequent))
    fields = [("row", T.LongType()), ("doc_id", kind), ("held_out", T.BooleanType()), ("size", T.LongType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("word", T.BinaryType()), ("times", T.LongType())]
    read = stage(base.mapInArrow(_score_texts(known), T.StructType([T.StructField(*x) for x in fields])), "text-tokens")
    discard(words)
    rest = read.where("word is not null").select("row", "word", "times").join(scored, "word").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("base")).alias("b"), F.sum(F.col("times") * F.col("extra")).alias("s"))
    out = read.where("word is null").drop("word", "times").join(rest, "row", "left")
    score = F.col("score") + F.coalesce("s", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), score.alias("score"), F.when(F.col("size") > 0, -score * 3.321928094887362 / F.col("size")).alias("bits_per_byte"))
