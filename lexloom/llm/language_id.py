"""Languages of texts, span by span.

Words are runs of letters.  A word's script, told by ranges of code points, leaves the languages that were seen in that
script; hashed n-grams of one to four letters score those.  Viterbi over the words of a text, with a penalty for each
switch, labels spans of mixed text; a text is in the language that labels most of its letters.

What is learnt are n-gram counts over all training texts, in vectors of fixed size: tasks sum their own, then the
vectors are added up in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.bytehash import mix64, powers
from lexloom.llm.storage import in_slices, stage

ORDERS, BITS = 4, 14
#: Cost of a change of language, and the most by which one word speaks for a language of its script, in nats.
SWITCH, MOST = 8.0, 6.0
UNDETERMINED = "und"
#: First code point of each script range, and the script; fixed values of the Unicode blocks.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD800, "Han"), (0xFB00, "Latin"), (0x20000, "Han"),
)
_FIRST = np.array([x for x, _ in SCRIPTS])
_NAMES = sorted({x for _, x in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(x) for _, x in SCRIPTS])
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def code_points(column) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts of a column, a line feed after each, and where each text begins."""
    texts = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")).to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), "<u4"), np.append(0, np.cumsum(sizes))


class Words:
    """The words of several texts: start and end, text, and the different ones among them."""

    def __init__(self, points: np.ndarray, begin: np.ndarray):
        inside = letters()[points]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.points, self.start, self.end = points, edge[::2], edge[1::2]
        sums = np.append(np.uint64(0), np.cumsum(mix64(points.astype(np.uint64)) * powers(len(points))[: len(points)]))
        names = mix64((sums[self.end] - sums[self.start]) * powers(len(sums), True)[self.start])
        _, first, self.kind = np.unique(names, return_index=True, return_inverse=True)
        self.first = first
        self.script = _SCRIPT[np.searchsorted(_FIRST, points[self.start[first]], side="right") - 1]
        self.offsets = np.searchsorted(self.start, begin)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots ``[orders, n]`` of the n-grams of the different words, and how many each word has of an order."""
        start, size = self.start[self.first], (self.end - self.start)[self.first]
        lead = ORDERS - 1
        room = size + lead + 1
        base = np.cumsum(room) - room
        padded = np.zeros(int(room.sum()), np.uint64)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        padded[np.repeat(base + lead, size) + within] = self.points[np.repeat(start, size) + within]
        at = np.repeat(base + lead, size + 1) + np.arange(int((size + 1).sum())) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        slots = np.empty((ORDERS, len(at)), np.int64)
        code = np.zeros(len(at), np.uint64)
        for k in range(ORDERS):
            code = code * np.uint64(0x9E3779B97F4A7C15) + padded[at - k] + np.uint64(1)
            slots[k] = (mix64(code) >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS)
        return slots, size + 1


def _count(langs: list[str], salts: int):
    """Training texts to (lang, part, salt, vector): n-gram counts by order, then letters by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), ORDERS << BITS))
        scripts = np.zeros((len(langs), len(_NAMES)))
        place = {x: k for k, x in enumerate(langs)}
        for whole in batches:
            for begin in range(0, len(whole), 1000):
                batch = whole.slice(begin, 1000)
                words = Words(*code_points(batch.column("text")))
                if not len(words.start):
                    continue
                own = np.repeat([place[x] for x in batch.column("lang").to_pylist()], np.diff(words.offsets))
                slots, size = words.grams()
                for k in np.unique(own):
                    mine = own == k
                    times = np.bincount(words.kind[mine], minlength=len(words.first))
                    weight = np.repeat(times, size)
                    for row in slots:
                        grams[k] += np.bincount(row, weight, ORDERS << BITS)
                    scripts[k] += np.bincount(words.script[words.kind[mine]], (words.end - words.start)[mine], len(_NAMES))
        rows = [(k, p, v.tobytes()) for k in range(len(langs)) for p, v in enumerate([*grams[k].reshape(ORDERS, -1), scripts[k]]) if v.any()]
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "part", "salt", "vector"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for lang, part, vector in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "vector")), strict=True):
            x = np.frombuffer(vector)
            total[lang, part] = total[lang, part] + x if (lang, part) in total else x
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "part", "salt", "vector"])


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each row; rows [offsets[i], offsets[i+1]) are a text's words, all texts side by side."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    begin, size = offsets[:-1][order], size[order]
    out = np.zeros(len(scores), np.int32)
    if not len(scores):
        return out
    came = np.zeros(len(scores), np.int32)  # the language that a switch at this word would come from
    stays = np.zeros(scores.shape, bool)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    total = scores[begin[: active[0]]].astype(np.float64)
    final = [total[active[1] if len(active) > 1 else 0 :]]
    for t in range(1, len(active)):
        m = active[t]
        total = total[:m]
        at = begin[:m] + t
        best = total.argmax(axis=1)
        other = total[np.arange(m), best][:, None] - switch
        stay = total >= other
        came[at], stays[at] = best, stay
        total = np.where(stay, total, other) + scores[at]
        final.append(total[active[t + 1] if t + 1 < len(active) else 0 :])
    state = np.concatenate([x.argmax(axis=1) for x in final[::-1]]).astype(np.int32)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        out[at] = state[:m]
        if t:
            state[:m] = np.where(stays[at, state[:m]], state[:m], came[at])
    return out


def _predict(shared, switch: float, most: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, allowed = shared.value
        for whole in batches:
            for begin in range(0, len(whole), 2000):
                batch = whole.slice(begin, 2000)
                points, at = code_points(batch.column("text"))
                words = Words(points, at)
                names, score, runs = [UNDETERMINED] * len(batch), np.zeros(len(batch)), [[] for _ in range(len(batch))]
                if len(words.start) and langs:
                    slots, size = words.grams()
                    each = np.add.reduceat(table[slots].sum(axis=0), np.append(0, np.cumsum(size)[:-1])) / ORDERS
                    each = np.where(allowed[words.script], each, -np.inf)
                    each = np.where(allowed[words.script], np.maximum(each - each.max(axis=1, keepdims=True), -most), -np.inf)
                    label = viterbi(each[words.kind], words.offsets, switch)
                    length = words.end - words.start
                    doc = np.repeat(np.arange(len(batch)), np.diff(words.offsets))
                    share = np.bincount(doc * len(langs) + label, length, len(batch) * len(langs)).reshape(len(batch), -1)
                    some = share.sum(axis=1) > 0
                    best = share.argmax(axis=1)
                    score = np.where(some, share.max(axis=1) / np.maximum(share.sum(axis=1), 1), 0.0)
                    names = [langs[k] if s else UNDETERMINED for k, s in zip(best, some, strict=True)]
                    if spans:
                        fresh = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
                        last = np.append(fresh[1:], len(label)) - 1
                        for i, j in zip(fresh, last, strict=True):
                            runs[doc[i]].append({"start": int(words.start[i] - at[doc[i]]), "end": int(words.end[j] - at[doc[i]]), "lang": langs[label[i]]})
                own = [batch.column(c) for c in ("doc_id", "held_out")]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(score), *([pa.array(runs, kind)] if spans else [])], names=["doc_id", "held_out", "lang_pred", "score", *(["spans"] if spans else [])])

    return run


def languages(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", folds: int = 5, switch: float = SWITCH, most: float = MOST, spans: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score and, if wanted, spans.

    Rows whose ``crc32`` of the id as text is 0 modulo ``folds`` are held out; all others with a language are learnt
    from.  ``score`` is the share of letters that the language labels.  Null text, texts without a letter, and all texts if nothing was learnt,
    are ``und`` with score 0; a null id counts as an empty one.  Spans are code points of the lower-cased text.  Repeated rows
    count as often as they are there; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0).alias("held_out"))
    train = base.where("not held_out and lang is not null")
    langs = [r["lang"] for r in train.select("lang").distinct().orderBy("lang").collect()]  # names of languages only
    schema = "lang int, part int, salt int, vector binary"
    sums = train.select("lang", "text").mapInArrow(in_slices(_count(langs, 32)), schema).repartition("lang", "part", "salt").mapInArrow(_add, schema)
    sums = stage(sums.repartition("lang", "part").mapInArrow(_add, schema), "gram-counts").select("lang", "part", "vector").toArrow()
    count = np.zeros((len(langs), ORDERS, 1 << BITS))
    script = np.zeros((len(langs), len(_NAMES)))
    for lang, part, vector in zip(*(sums[c].to_pylist() for c in ("lang", "part", "vector")), strict=True):
        if part < ORDERS:
            count[lang, part] = np.frombuffer(vector)
        else:
            script[lang] = np.frombuffer(vector)
    table = np.log((count + 0.5) / (count.sum(axis=2, keepdims=True) + 0.5 * (1 << BITS))).reshape(len(langs), ORDERS << BITS).T.astype(np.float32)
    allowed = (script > 1e-4 * script.sum(axis=1, keepdims=True)).T if langs else np.zeros((len(_NAMES), 0), bool)
    allowed = np.where(allowed.any(axis=1, keepdims=True), allowed, True)
    shared = spark.sparkContext.broadcast((langs, np.ascontiguousarray(table), allowed))
    fields = [("doc_id", docs.schema[id_col].dataType), ("held_out", T.BooleanType()), ("lang_pred", T.StringType()), ("score", T.DoubleType())]
    if spans:
        fields.append(("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))))
    return stage(base.select("doc_id", "text", "held_out").mapInArrow(in_slices(_predict(shared, switch, most, spans)), T.StructType([T.StructField(*x) for x in fields])), "languages")
