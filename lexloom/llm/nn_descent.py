"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one node.  A first neighbour graph comes from several sorted orders by random hyperplanes:
vectors that are next to each other, in blocks of bounded size, are compared.  Rounds of NN-descent follow: around each
node its neighbours, and the nodes that have it as a neighbour, are compared with each other, and every node keeps its
``k`` best.  Rounds end when hardly any list changes.  Edges at the threshold are verified in double precision and
give connected components.

A list that is full of such edges is saturated, as the node may have more links than the list holds.  A link between two
saturated nodes can be in neither list, so saturated nodes get further lists, of neighbours outside their component, by
the same orders and rounds; links found there merge components, and that is repeated until no such list holds one.  Then
lists of components with a saturated node are enlarged to the whole component, in pairs of blocks of bounded size that
give counts and no pairs.

At last the result is audited: a sample of bounded size is held against all vectors.  If fewer links were found than
``recall`` of those that there are, everything is repeated with twice as many orders on top of the graph so far; if that
doesn't help either, all vectors of a label are compared, in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.graph import block_roots, components
from lexloom.llm.storage import stage

LEAST = 0.98
NEIGHBOURS, ORDERS, BLOCK, ROUNDS = 6, 8, 256, 3
ENLARGED = 1024
AUDIT, RECALL = 1000, 0.995
_SLACK = 1e-5
_EDGES = "a long, b long, cosine float"


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.empty((0, 0), kind)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; largest components first go to about 1, so nothing overflows."""
    x = x / 2.0 ** np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size, label, vector) to (node, size, label, dim, unit, short): unit vectors as double and single floats."""
    for batch in batches:
        units = [_unit(np.array([v], np.float64)) for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("node", "size", "label")), pa.array([x.shape[1] for x in units], pa.int32()), pa.array([x.tobytes() for x in units], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in units], pa.binary())],
            names=["node", "size", "label", "dim", "unit", "short"],
        )


def _orders(seed: int, orders: int, bits: int = 62):
    """Each vector once for each order, with its place there: the signs on random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.Generator(np.random.PCG64([seed, int(dim)])).standard_normal((int(dim), orders * bits)).astype("<f4")
                part = batch.filter(pa.array(dims == dim))
                signs = (_matrix(part.column("short"), "<f4") @ planes[dim] > 0).reshape(len(part), orders, bits)
                code = signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                for k in range(orders):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), *(part.column(c) for c in ("node", "part", "label", "dim", "short")), pa.array(code[:, k])], names=["turn", "node", "part", "label", "dim", "short", "code"])

    return run


def _best(names: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest entries of each row of a square matrix, as edges; -2 is no entry."""
    k = min(k, len(names) - 1)
    if k < 1:
        return names[:0], names[:0], np.empty(0, np.float32)
    col = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(names)), k)
    col = col.ravel()
    real = cosines[row, col] > -2
    return names[row[real]], names[col[real]], cosines[row[real], col[real]].astype(np.float32)


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float32())], names=["a", "b", "cosine"])


def _neighbours_in_order(k: int, block: int):
    """Sorted rows to edges between parts: blocks that overlap by a half, each compared inside."""

    def compare(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = np.array([x[0] for x in rows], np.int64)
        group = np.array([x[1] for x in rows], np.int64)
        cosines = np.full((len(rows), len(rows)), -2.0, np.float32)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            x = np.frombuffer(b"".join(rows[i][2] for i in at), "<f4").reshape(len(at), -1)
            cosines[np.ix_(at, at)] = x @ x.T
        part = np.array([x[3] for x in rows], np.int64)
        cosines[part[:, None] == part] = -2
        return _best(names, cosines, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        fresh = 0
        kinds: dict[tuple, int] = {}
        for batch in batches:
            found = []
            group = [kinds.setdefault(x, len(kinds)) for x in zip(*(batch.column(c).to_pylist() for c in ("turn", "label", "dim")), strict=True)]
            for row in zip(batch.column("node").to_pylist(), group, batch.column("short").to_pylist(), batch.column("part").to_pylist(), strict=True):
                held.append(row)
                fresh += 1
                if len(held) == block:
                    found.append(compare(held))
                    held, fresh = held[block // 2 :], 0
            if found:
                yield _edges(found)
        if fresh:
            yield _edges([compare(held)])

    return run


def _local_join(k: int):
    """Rows (center, member, worst, short, part) sorted by center to edges between members of different parts that beat one's worst neighbour."""

    def compare(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = np.array([x[0] for x in rows], np.int64)
        x = np.frombuffer(b"".join(x[2] for x in rows), "<f4").reshape(len(rows), -1)
        cosines = x @ x.T
        part = np.array([x[3] for x in rows], np.int64)
        cosines[part[:, None] == part] = -2
        cosines[cosines <= np.array([x[1] for x in rows], np.float32)[:, None]] = -2
        return _best(names, cosines, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            found = []
            for center, *row in zip(*(batch.column(c).to_pylist() for c in ("center", "node", "worst", "short", "part")), strict=True):
                if center != now:
                    if len(held) > 1:
                        found.append(compare(held))
                    now, held = center, []
                held.append(row)
            if found:
                yield _edges(found)
        if len(held) > 1:
            yield _edges([compare(held)])

    return run


def _top(edges: DataFrame, k: int, by: str = "a") -> DataFrame:
    other = "b" if by == "a" else "a"
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cosine"), other))
    return edges.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _around(graph: DataFrame, k: int) -> DataFrame:
    """Each node with its neighbours and with the nodes that have it as a neighbour."""
    return graph.select(F.col("a").alias("center"), F.col("b").alias("node")).union(_top(graph, k, "b").select(F.col("b").alias("center"), F.col("a").alias("node")))


def _dealt(nodes: DataFrame, graph: DataFrame, seed: int, orders: int, k: int, name: str) -> DataFrame:
    """The graph with the neighbours in ``orders`` sorted orders added."""
    kind = nodes.schema["label"].dataType.simpleString()
    dealt = nodes.mapInArrow(_orders(seed, orders), f"turn int, node long, part long, label {kind}, dim int, short binary, code long")
    dealt = dealt.repartitionByRange("turn", "label", "dim", "code").sortWithinPartitions("turn", "label", "dim", "code")
    first = dealt.mapInArrow(_neighbours_in_order(k, BLOCK), _EDGES)
    return stage(_top(graph.union(first).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), k), name)


def _descend(nodes: DataFrame, graph: DataFrame, k: int, name: str, own: DataFrame | None = None) -> DataFrame:
    """One round: neighbours of neighbours, in both directions, against each other; ``own`` are edges inside parts, which lead on."""
    around = _around(graph, k) if own is None else _around(graph, k).union(_around(own, k)).union(graph.select("a", "a"))
    worst = graph.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(F.lit(-1.5)).cast("float").alias("worst"))
    known = nodes.select("node", "short", "part").join(worst, "node", "left").select("node", F.coalesce("worst", F.lit(-1.5).cast("float")).alias("worst"), "short", "part")
    rows = around.distinct().join(known, "node").repartition("center").sortWithinPartitions("center")
    better = rows.select("center", "node", "worst", "short", "part").mapInArrow(_local_join(k), _EDGES)
    return stage(_top(graph.union(better).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), k), name)


def _rounds(nodes: DataFrame, graph: DataFrame, k: int, rounds: int, name: str, own: DataFrame | None = None) -> DataFrame:
    size = graph.count()
    for r in range(rounds):
        new = _descend(nodes, graph, k, f"{name}-{r}", own)
        changed = new.join(graph, ["a", "b"], "left_anti").count()
        graph = new
        if changed <= 0.002 * size:
            break
    return graph


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [float(np.dot(np.frombuffer(x), np.frombuffer(y))) >= least for x, y in zip(batch.column("unit_a").to_pylist(), batch.column("unit_b").to_pylist(), strict=True)]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "size_a", "size_b")], names=["a", "b", "size_a", "size_b"])

    return run


def _count_pairs(least: float):
    """Sorted rows (component, i, j, own, node, size, unit) of a pair of blocks to (node, links, root in the block)."""

    def compare(i: int, j: int, rows: list[tuple]) -> pa.RecordBatch:
        first, second = [x for x in rows if x[0] == i], [x for x in rows if x[0] == j]
        names, links, roots = [], [], []
        if first and second:
            x, y = (np.frombuffer(b"".join(r[3] for r in part)).reshape(len(part), -1) for part in (first, second))
            near = x @ y.T >= least
            if i == j:
                np.fill_diagonal(near, False)
            names = [r[1] for r in first]
            links = (near @ np.array([r[2] for r in second], np.int64)).tolist()
            root = block_roots(near, *(np.array([r[1] for r in part], np.int64) for part in (first, second)), i == j)
            roots = root[0].tolist()
            if i != j:
                names += [r[1] for r in second]
                links += (np.array([r[2] for r in first], np.int64) @ near).tolist()
                roots += root[1].tolist()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64())], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for c, i, j, *row in zip(*(batch.column(n).to_pylist() for n in ("component", "i", "j", "own", "node", "size", "unit")), strict=True):
                if (c, i, j) != now:
                    if held:
                        yield compare(*now[1:], held)
                    now, held = (c, i, j), []
                held.append(row)
        if held:
            yield compare(*now[1:], held)

    return run


def _in_blocks(nodes: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """``members(component, node, blocks)`` against all others of their component: (node, links, root) for each pair of blocks."""
    pairs = members.select("component", "node", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node").join(nodes.select("node", "size", "unit"), "node")
    return pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").select("component", "i", "j", "own", "node", "size", "unit").mapInArrow(_count_pairs(least), "node long, links long, root long")


def _verified(nodes: DataFrame, graph: DataFrame, least: float, name: str) -> DataFrame:
    """Edges of the graph at the threshold, each once."""
    close = graph.where(F.col("cosine") >= least - _SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("unit").alias(f"unit_{x}"))
    pairs = close.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "unit_a", "unit_b")
    return stage(pairs.mapInArrow(_verify(least), "a long, b long, size_a long, size_b long"), name)


def _merged(nodes: DataFrame, graph: DataFrame, label: DataFrame, full: DataFrame, k: int, least: float, seed: int, orders: int, rounds: int, name: str) -> DataFrame:
    """``label(node, component)`` after links between saturated nodes of different components are found."""
    own = graph.join(full.select(F.col("node").alias("a")), "a").join(full.select(F.col("node").alias("b")), "b").select("a", "b", "cosine")
    turn = 0
    while True:
        held = stage(nodes.drop("part").join(full, "node").join(label.withColumnRenamed("component", "part"), "node"), f"{name}-held-{turn}")
        if held.select("part").distinct().limit(2).count() < 2:
            return label
        between = _dealt(held, nodes.sparkSession.createDataFrame([], _EDGES), seed, orders, k, f"{name}-between-{turn}")
        between = _rounds(held, between, k, rounds, f"{name}-between-{turn}", own)
        found = _verified(nodes, between, least, f"{name}-found-{turn}")
        if found.isEmpty():
            return label
        side = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}"))
        joined = found.join(side("a"), "a").join(side("b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        joined = components(joined, f"{name}-merge-{turn}").select(F.col("node").alias("component"), F.col("component").alias("now"))
        label = stage(label.join(joined, "component", "left").select("node", F.coalesce("now", "component").alias("component")), f"{name}-labels-{turn}")
        turn += 1


def _links(nodes: DataFrame, graph: DataFrame, k: int, least: float, seed: int, orders: int, rounds: int, name: str) -> DataFrame:
    """``(node, links, component)`` of the nodes that have a link."""
    pairs = _verified(nodes, graph, least, f"{name}-links")
    label = stage(components(pairs.select("a", "b"), f"{name}-components"), f"{name}-labels")
    lists = graph.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min("cosine").alias("worst"))
    full = stage(lists.where((F.col("n") >= k) & (F.col("worst") >= least - _SLACK)).select("node"), f"{name}-full")
    label = _merged(nodes, graph, label, full, k, least, seed, orders, rounds, f"{name}-merged")
    each = pairs.select(F.col("a").alias("node"), F.col("size_b").alias("size")).union(pairs.select("b", "size_a")).groupBy("node").agg(F.count("*").alias("entries"), F.sum("size").alias("links"))
    each = stage(each.join(label, "node").join(full.withColumn("full", F.lit(True)), "node", "left"), f"{name}-lists")
    wide = each.groupBy("component").agg(F.max("entries").alias("most"), F.count("*").alias("members"), F.max("full").alias("full"))
    wide = wide.where((F.col("most") >= k) | F.col("full")).select("component", F.ceil(F.col("members") / ENLARGED).cast("int").alias("blocks"))
    wide = stage(wide, f"{name}-saturated")
    if wide.isEmpty():
        return each.select("node", "links", "component")
    counted = _in_blocks(nodes, each.join(wide, "component"), least).groupBy("node").agg(F.sum("links").alias("counted"))
    return each.join(counted, "node", "left").select("node", F.coalesce("counted", "links").alias("links"), "component")


def _exact(nodes: DataFrame, least: float, name: str) -> DataFrame:
    """The result of ``_links`` by all pairs of a label and length."""
    kinds = nodes.groupBy("label", "dim").agg(F.min("node").alias("component"), F.ceil(F.count("*") / ENLARGED).cast("int").alias("blocks"))
    counted = stage(_in_blocks(nodes, nodes.select("node", "label", "dim").join(kinds, ["label", "dim"]), least), f"{name}-counted")
    label = components(counted.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), f"{name}-components")
    return counted.groupBy("node").agg(F.sum("links").alias("links")).join(label, "node")


def _audit(queries, least: float):
    """All vectors against the sampled ones: (number of the sample, links to it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, labels, units = queries.value
        groups: dict[tuple, list[int]] = {}
        for i, (label, unit) in enumerate(zip(labels, units, strict=True)):
            groups.setdefault((label, len(unit)), []).append(i)
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            label, node, size, unit = batch.column("label").to_pylist(), batch.column("node").to_numpy(), batch.column("size").to_numpy(), batch.column("unit").to_pylist()
            rows: dict[tuple, list[int]] = {}
            for i, x in enumerate(zip(label, map(len, unit), strict=True)):
                rows.setdefault(x, []).append(i)
            for x, at in rows.items():
                if x in groups:
                    q = groups[x]
                    near = np.frombuffer(b"".join(units[i] for i in q)).reshape(len(q), -1) @ np.frombuffer(b"".join(unit[i] for i in at)).reshape(len(at), -1).T >= least
                    near &= names[q][:, None] != node[at][None]
                    total[q] += near @ size[at]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["node", "there"])

    return run


def audit_recall(nodes: DataFrame, found: DataFrame, *, least: float = LEAST, sample: int = AUDIT) -> float:
    """Found links by those that there are, over about ``sample`` nodes held against all others; 1 if there are none."""
    n = max(nodes.count(), 1)
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) < int(min(1, sample / n) * (1 << 30))).select("node", "label", "unit").limit(2 * sample).toArrow()
    queries = nodes.sparkSession.sparkContext.broadcast((drawn["node"].to_numpy(), drawn["label"].to_pylist(), drawn["unit"].to_pylist()))
    there = nodes.select("node", "size", "label", "unit").mapInArrow(_audit(queries, least), "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    both = there.join(found.select("node", "links"), "node", "left").agg(F.sum("there").alias("n"), F.sum(F.least("there", F.coalesce("links", F.lit(0)))).alias("k")).first()
    return both["k"] / both["n"] if both["n"] else 1.0


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, k: int = NEIGHBOURS, orders: int = ORDERS, rounds: int = ROUNDS, sample: int = AUDIT, recall: float = RECALL, attempts: int = 3) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept.

    Only vectors of equal labels and lengths are compared.  Vectors that are null, empty or zero, or hold null or
    non-finite components, and those with a null id or label, link with nothing and are kept.  Rows that share an id
    are one vector, the smallest (label, components) of them.  An empty table gives an empty result; other columns are
    ignored.
    """
    doubles = F.col(vector_col).cast("array<double>")
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), doubles.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    single = valid.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x"))
    single = single.select("id", F.col("x.label").alias("label"), F.col("x.vector").alias("vector"), F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))
    single = stage(single, "vectors")
    classes = single.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("size"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
    classes = stage(classes, "vector-classes")
    kind = classes.schema["label"].dataType.simpleString()
    nodes = stage(classes.select(F.col("node").cast("long").alias("node"), "size", "label", "vector").mapInArrow(_prepare, f"node long, size long, label {kind}, dim int, unit binary, short binary").withColumn("part", F.col("node")), "vector-nodes")

    graph = nodes.sparkSession.createDataFrame([], _EDGES)
    for attempt in range(attempts):
        graph = _dealt(nodes, graph, attempt, orders << attempt, k, f"graph-{attempt}")
        graph = _rounds(nodes, graph, k, rounds, f"graph-{attempt}")
        found = stage(_links(nodes, graph, k, least, attempt, orders << attempt, rounds, f"vectors-{attempt}"), f"found-{attempt}")
        if audit_recall(nodes, found, least=least, sample=sample) >= recall:
            break
    else:
        found = stage(_exact(nodes, least, "vectors-exact"), "found-exact")

    result = classes.select("h1", "h2", F.col("node").alias("first"), "size").join(found.withColumnRenamed("node", "first"), "first", "left")
    result = result.select("h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "first").alias("component"))
    by_id = single.select("id", "h1", "h2").join(result, ["h1", "h2"]).select("id", "n_links", "component")
    out = base.select("id").join(by_id, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


#: The same result over all pairs of a label, for tables that bear it.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98::DOUBLE
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), smallest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, s.component_id::BIGINT AS component_id, e.vec_id = s.component_id AS kept
FROM embeddings e JOIN smallest s USING (vec_id) LEFT JOIN counted c USING (vec_id)
"""
