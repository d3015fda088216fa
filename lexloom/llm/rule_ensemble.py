"""Quality scores by a sparse ensemble of rules.

Each text gives a vector of statistics.  From a bounded sample of labelled rows small trees are grown; every path from a
root to a node is a conjunction of comparisons, a rule.  A lasso logistic regression weighs the rules and leaves few of
them, and those are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.bytehash import arrow_text, shingles, word_hashes
from lexloom.llm.storage import in_slices, stage

#: Labelled rows to fit on, at most; trees, depth, thresholds a statistic, strength of the lasso.
SAMPLE, TREES, DEPTH, BINS, LASSO = 20_000, 40, 3, 24, 0.002
THRESHOLD = 0.7
STATISTICS = ("log_words", "word_length", "capitals", "exclamations", "bars", "symbols", "digits", "stops", "other_ascii", "short_words", "distinct_words", "repeated_threes", "repeated_lines", "log_line_words")
Rule = tuple[tuple[int, bool, float], ...]

_CLASSES = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "exclamations": b"!?", "bars": b"|", "symbols": b"#*$%&<>", "digits": b"0123456789", "stops": b".,;:", "other_ascii": b"\"'()+-/=@[\\]^_`{}~"}
_TABLE = np.zeros((256, len(_CLASSES)), bool)
for _k, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _k] = True


def _line_hashes(data: np.ndarray) -> np.ndarray:
    lines = [hash(x) for x in data.tobytes().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return np.array(lines, np.int64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``[texts, STATISTICS]`` of UTF-8 texts given as bytes and offsets; an empty text has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    hashes, ends = word_hashes(data, offsets)
    sizes = np.diff(offsets)
    sums = np.zeros((n, len(_CLASSES)))
    full = np.flatnonzero(sizes)
    if len(full):
        part = data[offsets[0] : offsets[-1]]
        for k in range(len(_CLASSES)):
            sums[full, k] = np.add.reduceat(_TABLE[:, k][part], offsets[full] - offsets[0], dtype=np.int64)
    for i in full:
        words = hashes[ends[i] : ends[i + 1]]
        if not len(words):
            continue
        text = data[offsets[i] : offsets[i + 1]]
        space = int(np.isin(text, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)).sum())
        chars = len(text) - space
        threes = shingles(words, 3)
        lines = _line_hashes(text)
        gaps = np.diff(np.flatnonzero(np.concatenate([[True], text <= 32, [True]])))
        out[i] = (
            np.log1p(len(words)), chars / len(words), *(sums[i] / chars), float((gaps <= 4).mean()),
            len(np.unique(words)) / len(words), 1 - len(np.unique(threes)) / len(threes), 1 - len(np.unique(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
        )
    return out


def _measure(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 1000):
                batch = whole.slice(begin, 1000)
                found = statistics(*arrow_text(batch.column("__text")))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], names=[*names, *STATISTICS])

    return run


def grow(x: np.ndarray, y: np.ndarray, depth: int, cuts: list[np.ndarray], binned: np.ndarray, rows: np.ndarray, features: np.ndarray, path: Rule = ()) -> list[Rule]:
    """Rules of one tree: the paths to all its nodes but the root."""
    if not depth or len(rows) < 20:
        return []
    total, ones, best = len(rows), y[rows].sum(), (1e-9, None)
    for f in features:
        k = len(cuts[f])
        if not k:
            continue
        n = np.cumsum(np.bincount(binned[rows, f], minlength=k + 1))[:k]
        s = np.cumsum(np.bincount(binned[rows, f], weights=y[rows], minlength=k + 1))[:k]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((n >= 5) & (n <= total - 5), s * s / n + (ones - s) ** 2 / (total - n), -np.inf) - ones * ones / total
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (gain[at], (int(f), at))
    if best[1] is None:
        return []
    f, at = best[1]
    low = binned[rows, f] <= at
    out: list[Rule] = []
    for below, part in ((True, rows[low]), (False, rows[~low])):
        own = (*path, (f, below, float(cuts[f][at])))
        out += [own, *grow(x, y, depth - 1, cuts, binned, part, features, own)]
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, seed: int = 11) -> list[Rule]:
    """Different rules of trees over halves of the rows and of the statistics; ``x <= cut`` or ``x > cut``."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    draw = np.random.Generator(np.random.PCG64(seed))
    found: list[Rule] = []
    for _ in range(trees):
        rows = np.flatnonzero(draw.random(len(x)) < 0.5)
        features = draw.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]
        found += grow(x, y, depth, cuts, binned, rows, features)
    return list(dict.fromkeys(found))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, cut in rule:
        out &= x[:, f] <= cut if below else x[:, f] > cut
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, strength: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps; the intercept isn't shrunk."""
    n, p = a.shape
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(p), float(np.log(base / (1 - base)))
    v, c, t = w, b, 1.0
    rate = 4.0 / max(1.0, np.linalg.norm(np.column_stack([a, np.ones(n)]), 2) ** 2 / n)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30))) - y
        new = v - rate * (a.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * strength, 0)
        intercept = c - rate * error.mean()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t_new * (new - w), intercept + (t - 1) / t_new * (intercept - b)
        w, b, t = new, intercept, t_new
    return w, b


def fit(x: np.ndarray, y: np.ndarray, **options) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with weights that aren't zero, and the intercept."""
    if len(y) == 0:
        return [], 0.0
    if y.min() == y.max() or len(y) < 40:
        rate = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(rate / (1 - rate)))
    rules = extract_rules(x, y, **options)
    a = np.column_stack([holds(r, x) for r in rules]) if rules else np.zeros((len(y), 1))
    a, keep = np.unique(a, axis=1, return_index=True)
    w, b = lasso_logistic(a.astype(np.float64), y.astype(np.float64))
    return [(rules[k], float(v)) for k, v in zip(keep, w, strict=True) if v and rules], b


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The score as a column over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        test = F.lit(True)
        for f, below, cut in rule:
            test = test & (F.col(STATISTICS[f]) <= cut if below else F.col(STATISTICS[f]) > cut)
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", folds: int = 4, held: int = 2, sample: int = SAMPLE, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep`` columns, held_out, score, predicted.

    Rows whose ``crc32`` of the id as text is ``held`` modulo ``folds`` aren't learnt from; of the other labelled ones
    at most ``sample`` are, drawn by a hash.  Null text counts as empty and gets a score like others; a null id counts
    as an empty one and is never learnt from; null labels are left out; with fewer than 40 labelled rows, or labels all alike, every score is
    their smoothed rate, with none 0.5.  Repeated rows count as often as they are there; an empty table gives an empty result; other columns are ignored.
    """
    names = [id_col, *keep]
    base = docs.select(*names, F.col(text_col).alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])
    measured = stage(base.mapInArrow(in_slices(_measure(names), "__text"), schema), "statistics")
    remainder = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    learn = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("__label")).where("__label is not null").where(remainder != held)
    rows = measured.join(learn, id_col).select("__label", *STATISTICS, F.xxhash64(id_col, *STATISTICS).alias("__order"))
    drawn = rows.orderBy("__order", "__label").limit(sample).drop("__order").toArrow()
    x = np.column_stack([drawn[s].to_numpy() for s in STATISTICS]) if len(drawn) else np.empty((0, len(STATISTICS)))
    rules, intercept = fit(x, drawn["__label"].to_numpy())
    score = compiled(rules, intercept)
    out = measured.select(*names, (remainder == held).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
