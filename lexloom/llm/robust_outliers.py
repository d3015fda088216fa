"""Quality rules and robust multivariate outliers, built of DataFrame functions only.

Every text gives a handful of counts; two base rules reject at once.  All other texts are held against their like: for
each language and source a minimum-covariance-determinant estimate is made of the transformed counts, and a text whose
Mahalanobis distance from its own group is beyond ``cutoff`` is rejected.

Each estimate has three starts with the medians as centre: absolute deviations alone, the covariance of values cut at two
deviations, and that of directions from the centre.  From each, concentration steps are taken: mean and covariance of the
``share`` of rows that are nearest, distances by them, and again.  After ``trial`` steps the start with the smallest
determinant goes on alone.  The covariance is widened by the factor that makes it consistent for normal data, and
``cutoff`` is the chi-square quantile that one clean text in ten million exceeds.

What is nearest is told by a quantile of each group, not by a sort, so a group of any size is sums and sketches only; no
group comes together in one task.  Groups of fewer than ``least`` rows use their language's estimate, and such languages
that of all rows.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.storage import discard, stage

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SHARE, TRIAL, STEPS, LEAST = 0.75, 2, 4, 100
#: Smallest standard deviation of each transformed count: what is the same in most texts of a group still varies a bit.
FLOOR = 0.08
#: The share of clean texts whose distance is beyond the cutoff, for normal data.
TAIL = 1e-7
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_capitals")


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def _covered(marked: Column) -> Column:
    """How many words windows of three at the ascending positions ``marked`` cover."""
    gaps = F.zip_with(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), F.slice(marked, 1, F.greatest(F.size(marked) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(F.size(marked) > 0, F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).otherwise(0)


def text_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` and ``n_capitals``; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__text", text).withColumn("__trim", _trimmed(F.col("__text")))
    out = out.withColumn("__words", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", "[ \\t-\\r]+")))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    windows = F.transform(F.sequence(F.lit(1), F.size("__words") - 2), lambda i: F.struct(F.xxhash64(F.element_at(F.col("__words"), i), F.element_at(F.col("__words"), i + 1), F.element_at(F.col("__words"), i + 2)).alias("h"), i.alias("i")))
    out = out.withColumn("__windows", F.when(F.col("n_words") >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    n = F.size("__windows")
    nothing = F.lit(None).cast("struct<h:bigint,i:int>")
    shifted = F.slice("__windows", 2, F.greatest(n - 1, F.lit(0)))
    twice = F.zip_with(F.concat(F.array(nothing), F.slice("__windows", 1, F.greatest(n - 1, F.lit(0)))), F.zip_with(F.col("__windows"), shifted, lambda a, b: F.when(a["h"] == b["h"], a["i"]).otherwise(-a["i"])), lambda before, signed: F.struct(before["h"].alias("h"), signed.alias("i")))
    marked = F.zip_with(twice, F.col("__windows"), lambda x, a: F.when((x["i"] > 0) | (x["h"] == a["h"]), a["i"]))
    out = out.withColumn("__marked", F.sort_array(F.filter(marked, lambda x: x.isNotNull())))
    lines = F.filter(F.split("__text", "\n"), lambda x: _trimmed(x) != "")
    out = out.withColumn("__lines", lines)
    gone = lambda chars: (F.length("__text") - F.length(F.translate("__text", chars, ""))).cast("long")
    out = out.withColumn("word_chars", F.length(F.translate("__text", SPACE, "")).cast("long")).withColumn("n_symbols", gone(SYMBOLS))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).withColumn("n_lines", F.size("__lines").cast("long"))
    out = out.withColumn("n_repeat_words", _covered(F.col("__marked")).cast("long")).withColumn("n_capitals", gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return out.drop("__text", "__trim", "__words", "__windows", "__marked", "__lines")


def _features() -> list[Column]:
    """Counts as shares, on scales where ordinary texts differ by about the floor."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return [
        F.log(F.greatest(share("word_chars", "n_words"), F.lit(1.0))).alias("f_word_length"),
        F.sqrt(share("n_symbols", "n_words")).alias("f_symbols"),
        share("n_dup_lines", "n_lines").alias("f_dup_lines"),
        share("n_repeat_words", "n_words").alias("f_repeats"),
        F.sqrt(share("n_capitals", "word_chars")).alias("f_capitals"),
    ]


def _inverse_root(p: int) -> dict[str, Column]:
    """Entries of the inverse of the Cholesky factor of the covariance, from columns ``c_i_j`` (i >= j), unrolled."""
    low: dict[tuple[int, int], str] = {}
    out: dict[str, Column] = {}
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(low[i, k]) * F.col(low[j, k])
            name = low[i, j] = f"l_{i}_{j}"
            out[name] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(low[j, j])
    for j in range(p):
        for i in range(j, p):
            rest = F.lit(1.0) if i == j else F.lit(0.0)
            for k in range(j, i):
                rest = rest - F.col(low[i, k]) * F.col(f"v_{k}_{j}")
            out[f"v_{i}_{j}"] = rest / F.col(low[i, i])
    return out


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of the features by columns ``m_i`` and ``v_i_j``."""
    total = F.lit(0.0)
    for i in range(p):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"v_{i}_{j}") * (F.col(FEATURES[j]) - F.col(f"m_{j}"))
        total = total + part * part
    return total


def chi_square(p: int, x: float) -> float:
    """The probability that a chi-square variable of ``p`` degrees is below ``x``."""
    if x <= 0:
        return 0.0
    a, z = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > 1e-17 * total:
        k += 1
        term *= z / k
        total += term
    from math import lgamma

    return min(1.0, total * exp(a * log(z) - z - lgamma(a)))


def chi_square_quantile(p: int, q: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(p, mid) < q else (low, mid)
    return (low + high) / 2


def consistency(p: int, share: float) -> float:
    """What the covariance of the nearest ``share`` of normal data is to be multiplied by."""
    return share / chi_square(p + 2, chi_square_quantile(p, share)) if share < 1 else 1.0


def _rooted(covariances: DataFrame, by: tuple[str, ...], floor: float) -> DataFrame:
    """Means ``m_i`` and inverse root ``v_i_j`` from ``m_i`` and covariances ``c_i_j``, with the floor added."""
    p = len(FEATURES)
    for i in range(p):
        covariances = covariances.withColumn(f"c_{i}_{i}", F.col(f"c_{i}_{i}") + floor * floor)
    for name, entry in _inverse_root(p).items():
        covariances = covariances.withColumn(name, entry)
    return covariances.select(*by, *(f"m_{i}" for i in range(p)), *(f"v_{i}_{j}" for i in range(p) for j in range(i + 1)))


def _estimate(rows: DataFrame, by: tuple[str, ...], floor: float, widen: float) -> DataFrame:
    """Mean and inverse root of the widened and floored covariance for each key of ``rows``."""
    p = len(FEATURES)
    sums = [F.avg(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)]
    sums += [(widen * F.covar_pop(FEATURES[i], FEATURES[j])).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    return _rooted(rows.groupBy(*by).agg(*sums), by, floor)


def _starts(rows: DataFrame, floor: float) -> DataFrame:
    """Three models for each key: ``start`` 0 to 2."""
    p = len(FEATURES)
    middle = rows.groupBy("key").agg(*(F.percentile_approx(f, 0.5, 1000).alias(f"m_{i}") for i, f in enumerate(FEATURES)))
    spread = rows.join(middle, "key").groupBy("key").agg(*(F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)), *((1.4826 * F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{i}")), 0.5, 1000)).alias(f"s_{i}") for i, f in enumerate(FEATURES)))
    spread = stage(spread, "mcd-spread")
    held = rows.join(spread, "key")
    wide = [F.col(f"s_{i}") + floor for i in range(p)]
    far = F.sqrt(sum(((F.col(f) - F.col(f"m_{i}")) / wide[i]) ** 2 for i, f in enumerate(FEATURES)))
    held = held.withColumn("far", far)
    cut = [F.greatest(F.least(F.col(f), F.col(f"m_{i}") + 2 * wide[i]), F.col(f"m_{i}") - 2 * wide[i]).alias(f"a_{i}") for i, f in enumerate(FEATURES)]
    way = [F.when(F.col("far") > 0, (F.col(f) - F.col(f"m_{i}")) / F.col("far")).otherwise(0.0).alias(f"b_{i}") for i, f in enumerate(FEATURES)]
    held = held.select("key", *cut, *way)
    both = held.groupBy("key").agg(*((factor * F.covar_pop(f"{x}_{i}", f"{x}_{j}")).alias(f"{x}_{i}_{j}") for x, factor in (("a", 1), ("b", p)) for i in range(p) for j in range(i + 1)))
    both = stage(both.join(spread, "key"), "mcd-covariances")
    none = F.lit(0.0)
    kinds = (lambda i, j: F.col(f"s_{i}") * F.col(f"s_{i}") if i == j else none, lambda i, j: F.col(f"a_{i}_{j}"), lambda i, j: F.col(f"b_{i}_{j}"))
    out = None
    for start, kind in enumerate(kinds):
        one = both.select("key", F.lit(start).alias("start"), *(f"m_{i}" for i in range(p)), *(kind(i, j).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)))
        out = one if out is None else out.union(one)
    return stage(_rooted(out, ("key", "start"), floor), "mcd-start")


def mcd(rows: DataFrame, *, share: float = SHARE, trial: int = TRIAL, steps: int = STEPS, floor: float = FLOOR) -> DataFrame:
    """Estimates for each ``key`` of ``rows(key, features)``: means ``m_i`` and inverse root ``v_i_j``."""
    p = len(FEATURES)
    widen = consistency(p, share)
    model, by = _starts(rows, floor), ("key", "start")
    for k in range(trial + steps):
        if k == trial:  # the smallest determinant: that of the root's inverse is the product of its diagonal
            small = F.struct((-sum(F.log(f"v_{i}_{i}") for i in range(p))).alias("size"), "start")
            model = model.join(model.groupBy("key").agg(F.min(small).alias("best")).select("key", F.col("best.start").alias("start")), ["key", "start"], "left_semi").drop("start")
            by = ("key",)
        held = rows.join(model, "key").select(*by, *FEATURES, _distance(p).alias("d"))
        edge = held.groupBy(*by).agg(F.percentile_approx("d", share, 1000).alias("edge"))
        near = held.join(edge, list(by)).where("d <= edge")
        old, model = model, stage(_estimate(near, by, floor, widen), f"mcd-{k}")
        discard(old)
    return model


def quality_outliers(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", share: float = SHARE, trial: int = TRIAL, steps: int = STEPS, least: int = LEAST, floor: float = FLOOR, tail: float = TAIL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, distance, kept.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated windows of three.  Only texts that pass
    are estimated from and judged by distance; ``distance`` is null for the others, which aren't kept.  Null text counts as empty,
    null language or source as a value of its own; repeated rows count as often as they are there; an empty table gives
    an empty result; other columns are ignored.  Windows of three words are told apart by 64-bit hashes.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    counts = text_counts(base, "text").select("doc_id", "lang", "source", *COUNTS, "n_lines", "n_capitals")
    counts = stage(counts, "text-counts").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    quote = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    keyed = counts.select("*", F.to_json(F.array(quote("lang"), quote("source"))).alias("key0"), F.to_json(F.array(quote("lang"))).alias("key1"), F.lit("[]").alias("key2"), *_features())
    passed = keyed.where(~F.col("base_failed")).select(F.explode(F.array("key0", "key1", "key2")).alias("key"), *FEATURES)
    sizes = stage(passed.groupBy("key").count().where(F.col("count") >= least).select("key"), "mcd-keys")
    rows = stage(passed.join(sizes, "key"), "mcd-rows")
    model = mcd(rows, share=share, trial=trial, steps=steps, floor=floor)
    cutoff = chi_square_quantile(len(FEATURES), 1 - tail)
    for k in range(3):  # the first of its keys that has an estimate
        keyed = keyed.join(sizes.select(F.col("key").alias(f"key{k}"), F.lit(True).alias(f"has{k}")), f"key{k}", "left")
    key = F.coalesce(*(F.when(F.col(f"has{k}"), F.col(f"key{k}")) for k in range(3)))
    judged = keyed.withColumn("key", key).join(model, "key", "left")
    distance = F.when(~F.col("base_failed"), _distance(len(FEATURES)))
    out = judged.withColumn("distance", distance)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance")
