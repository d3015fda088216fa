"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.storage import discard, stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` of longs, in any order and direction; returns ``(node, component)``, the smallest node reachable.

    Every round takes the smallest label among the neighbours and then the label of that label, so paths shrink by
    pointer jumping.  Labels are tables in the shared folder; the driver sees one count a round.  Nodes without an
    edge aren't returned; loops and repeated edges do no harm; no edges give an empty table.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    both = stage(both, f"{name}-edges")
    label = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), f"{name}-0")
    k = 0
    while True:  # labels only fall, so it ends
        k += 1
        near = both.join(label.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("seen"))
        step = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("now"))
        jump = label.select(F.col("node").alias("now"), F.col("component").alias("further"))
        new = step.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("further", "now")).alias("component"))
        old, label = label, stage(new, f"{name}-{k}")
        discard(old)
        if label.where("was <> component").isEmpty():
            discard(both)
            return label.select("node", "component")


def block_roots(near: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest name that each row and each column of a block of links reaches inside it."""
    far = np.iinfo(np.int64).max
    while True:
        new_x = np.minimum(x, np.where(near, y[None], far).min(axis=1, initial=far))
        new_y = new_x if same else np.minimum(y, np.where(near, new_x[:, None], far).min(axis=0, initial=far))
        if np.array_equal(new_x, x) and np.array_equal(new_y, y):
            return x, y
        x, y = new_x, new_y
