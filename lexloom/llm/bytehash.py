"""Vectorised hashing of byte strings: rolling windows, words and shingles, straight from Arrow buffers.

All hashes are 64-bit and the same on every machine.  A hash of a byte range comes from prefix sums of a
polynomial modulo 2**64 with an odd base (odd numbers have inverses there), over a random 64-bit value per byte,
and is finished by an avalanche step.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """At least ``n`` powers of the base, or of its inverse."""
    have = _powers[inverse]
    while len(have) < n:
        step = np.uint64(pow(int(_INVERSE if inverse else _BASE), len(have), 2**64))
        have = np.concatenate([have, have * step])
    _powers[inverse] = have
    return have


def value_sums(values: np.ndarray) -> np.ndarray:
    """``len(values) + 1`` sums of value times power of the base."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(values))[: len(values)], out=out[1:])
    return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``value_sums`` of bytes, each of which has a random odd value."""
    return value_sums(BYTE_VALUES[data])


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every window of ``size`` bytes."""
    n = len(sums) - size
    return mix64((sums[size:] - sums[:n]) * powers(n, True)[:n]) if n > 0 else np.empty(0, np.uint64)


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end)."""
    return mix64((sums[end] - sums[start]) * powers(len(sums), True)[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbouring values, by doubling."""
    span = 1
    while span < size:
        step = min(span, size - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


def arrow_text(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its ``n + 1`` offsets into them; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends, from the first text on, of the words ``[^\\x20\\x09-\\x0D]+`` of several texts, and ``n + 1`` offsets of each text's words."""
    base = offsets[0]
    data = data[base : offsets[-1]]
    ends = offsets - base
    inside = ~_SPACE[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    starts = ends[:-1][ends[:-1] < len(data)]
    fresh[starts] = inside[starts]
    start = np.flatnonzero(fresh)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:]
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, ends)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, and ``n + 1`` offsets of each text's words."""
    start, end, at = word_places(data, offsets)
    return ranges(prefix_sums(data[offsets[0] : offsets[-1]]), start, end), at


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` words in a row of one text; of all its words if there are fewer, but one at least."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix64(out)
