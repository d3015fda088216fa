"""Mixing of sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent.  At 1 sources keep their shares, at 0 they
are equal.  The exponent is bisected: the largest that meets a target entropy, or the smallest that repeats no source
more often than allowed; weights times the token budget is what each source gives.

A source gives its documents in blocks.  Each block is a permutation of all its documents, by a hash that differs from
block to block; the last block goes as far as the budget does.  The place of a document in the mix is its place within
its source, so sources alternate evenly all along.  Where the last block ends is found by sums over ranges of
the hash, then inside one range only; no source comes together in one task.
"""

from __future__ import annotations

from math import ceil, exp, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.storage import stage

#: Target entropy as a share of the largest possible one; most blocks a source may give.
ENTROPY, REPETITION = 0.9, 4.0
ROWS_A_RANGE = 5_000


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised powers of the token shares; sources without a token weigh nothing."""
    total = sum(tokens.values())
    raw = {s: exp(exponent * log(n / total)) if n > 0 else 0.0 for s, n in tokens.items()}
    norm = sum(raw.values())
    return {s: x / norm if norm else 0.0 for s, x in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(x * log(x) for x in w.values() if x > 0)


def repetition(tokens: dict[str, int], w: dict[str, float], budget: float) -> float:
    """The most blocks that a source gives."""
    return max((w[s] * budget / n for s, n in tokens.items() if n > 0), default=0.0)


def exponent(tokens: dict[str, int], budget: float, *, target_entropy: float | None = ENTROPY, most: float | None = REPETITION, steps: int = 60) -> float:
    """The largest exponent in [0, 1] with the target entropy, but none so small that a source is repeated too often."""

    def bisect(holds, low: float, high: float) -> tuple[float, float]:
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low, high

    live = sum(n > 0 for n in tokens.values())
    if live < 2:
        return 1.0
    found = 1.0
    if target_entropy is not None:
        goal = target_entropy * log(live)
        if entropy(weights(tokens, 1.0)) < goal:
            found = bisect(lambda x: entropy(weights(tokens, x)) >= goal, 0.0, 1.0)[0]
    if most is not None and repetition(tokens, weights(tokens, found), budget) > most:
        found = bisect(lambda x: repetition(tokens, weights(tokens, x), budget) > most, found, 1.0)[1]
    return found


def mix_sources(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", budget: float | None = None, target_entropy: float | None = ENTROPY, most: float | None = REPETITION, seed: int = 0) -> DataFrame:
    """The columns of ``docs`` with ``mix_block`` (from 0), ``mix_tokens`` and ``mix_place`` (0 to 1, the order of the mix).

    Tokens are words.  ``budget`` is in tokens, those of all documents if None.  A document is in a block if the tokens before it in that
    block leave room for at least half of it, so each source's sum is within one document of its share.  A null source is a source of its
    own; null and empty texts have no tokens and stand in every whole block.  Rows are told apart by id and text only; equal rows share
    their place, and count as often as they are there, so a cut falls before or after all of them.  An empty table gives an empty result; columns of ``docs`` that begin with
    ``mix_`` are replaced.
    """
    plain = docs.drop("mix_block", "mix_tokens", "mix_place")
    names = plain.columns
    trimmed = F.trim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    count = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    digest = F.xxhash64(F.lit(seed), id_col, text_col)
    keys = stage(plain.select(source.alias("s"), digest.alias("h"), count.alias("n")), "mix-keys")
    sizes = {r["s"]: (r["n"], r["docs"]) for r in keys.groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()}  # a row for each source
    tokens = {s: n for s, (n, _) in sizes.items()}
    total = sum(tokens.values())
    budget = total if budget is None else budget
    w = weights(tokens, exponent(tokens, budget, target_entropy=target_entropy, most=most))
    plan = []
    for s, (n, rows) in sizes.items():
        blocks = w[s] * budget / n if n else 1.0
        whole = int(blocks + 1e-9)
        plan.append((s, whole, max(0.0, w[s] * budget - whole * n) if n else 0.0, max(blocks, 1e-9), max(1, ceil(rows / ROWS_A_RANGE))))
    spark = docs.sparkSession
    plans = spark.createDataFrame(plan, "s string, whole int, rest double, blocks double, ranges int")

    # the last block of each source: its order, cut in ranges; tokens before each range; then a running sum in the range of the cut
    order = F.pmod(F.xxhash64("h", F.col("whole")), F.lit(1 << 40))
    last = keys.join(plans.where("rest > 0"), "s").select("s", "n", "rest", order.alias("o"), F.expr("cast(floor(pmod(xxhash64(h, whole), 1099511627776L) / 1099511627776D * ranges) as int)").alias("r"))
    sums = last.groupBy("s", "r").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    open_range = stage(sums.where("before < rest and before + n >= rest").groupBy("s").agg(F.min(F.struct("r", "before")).alias("x")).select("s", "x.r", "x.before"), "mix-ranges")
    inside = last.join(open_range, ["s", "r"]).groupBy("s", "o", "rest", "before").agg(F.sum("n").alias("n"), F.max("n").alias("one"))
    upto = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("upto", upto).where(F.col("upto") + F.col("n") / 2 <= F.col("rest")).groupBy("s").agg(F.max("o").alias("o"))
    edge = open_range.join(cut, "s", "left").select("s", F.col("r").alias("edge_r"), F.coalesce("o", F.lit(-1)).alias("edge_o"))
    full = plans.join(edge, "s", "left")
    full = stage(full, "mix-plan")

    dealt = plain.withColumn("__s", source).withColumn("__h", digest).withColumn("mix_tokens", count).join(full.withColumnRenamed("s", "__s"), "__s")
    dealt = dealt.withColumn("mix_block", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    place = F.pmod(F.xxhash64("__h", "mix_block"), F.lit(1 << 40))
    dealt = dealt.withColumn("__o", place)
    spot = F.expr("cast(floor(__o / 1099511627776D * ranges) as int)")
    taken = (F.col("mix_block") < F.col("whole")) | ((F.col("rest") > 0) & F.coalesce((spot < F.col("edge_r")) | ((spot == F.col("edge_r")) & (F.col("__o") <= F.col("edge_o"))), F.lit(True)))
    return dealt.where(taken).select(*names, "mix_block", "mix_tokens", F.least(F.lit(1.0), (F.col("mix_block") + F.col("__o") / float(1 << 40)) / F.col("blocks")).alias("mix_place"))
