import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import near_dedup
from lexloom.llm.bytehash import arrow_text, word_hashes
from lexloom.llm.graph import components
from lexloom.llm.near_dedup import bag, near_duplicates, overlap, overlaps, signatures
from lexloom.llm.nn_descent import near_vectors
from lexloom.llm.suffix_array import suffix_array
from lexloom.llm.suffix_dedup import suffix_dedup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(x):
    assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def spans(texts, width):
    where = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            where.setdefault(tuple(t[i : i + width]), []).append((k, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + width] = True
    return gone


def test_suffix_dedup(spark):
    draw = np.random.default_rng(3)
    word = lambda n: "".join(draw.choice(list("abcdé "), n))
    shared = [word(90) for _ in range(4)]
    texts = [word(int(n)) for n in draw.integers(0, 80, 12)] + [None, "", shared[0], shared[0], "a" * 300, "xyz" * 50]
    texts += [word(20) + s[int(draw.integers(0, 20)) :] + word(30) + s[:60] for s in shared for _ in range(3)]
    rows = [(k if k else None, t, 1) for k, t in enumerate(texts)]
    for hot in (1 << 20, 100):
        docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
        out = {r["doc_id"]: r for r in suffix_dedup(docs, width=40, hot_bytes=hot).collect()}
        data = [(t or "").encode() for t in texts]
        for (i, *_), t, gone in zip(rows, data, spans(data, 40), strict=True):
            runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
            left = bytes(np.frombuffer(t, np.uint8)[~gone])
            assert (out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"], out[i]["kept_sha256"]) == (len(t), gone.sum(), runs, hashlib.sha256(left).hexdigest())
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_are_counted(spark):
    draw = np.random.default_rng(6)
    words = lambda n: list(draw.choice([f"w{k}" for k in range(900)], int(n)))
    shared = words(30)
    texts = [words(50), words(9) + shared + words(20), shared[:20] + words(5), [], words(3)]
    rows = [(k, " ".join(t) if t else None, 0) for k, t in enumerate(texts)]
    out = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_passage_words int"), with_text=False, passages=12)
    assert {r["doc_id"]: r["n_passage_words"] for r in out.collect()} == {k: int(g.sum()) for k, g in enumerate(spans(texts, 12))} == {0: 0, 1: 20, 2: 20, 3: 0, 4: 0}
    assert "kept_text" not in out.columns


def test_suffix_dedup_of_words(spark):
    draw = np.random.default_rng(4)
    words = lambda n: list(draw.choice([f"{c}{k}" for c in "abé" for k in range(30)], int(n)))
    shared = [words(30) for _ in range(4)]
    texts = [words(n) for n in draw.integers(0, 40, 12)] + [["a"] * 40, shared[0], shared[0]]
    texts += [words(9) + s[int(draw.integers(0, 8)) :] + words(7) + s[:18] for s in shared for _ in range(3)]
    spaced = ["".join(w + str(draw.choice([" ", "\n", "  ", "\t\r"])) for w in t) for t in texts]
    gone = spans([[hash(w) for w in t] for t in texts], 12)
    for hot in (1 << 18, 100):
        docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(spaced)] + [(-1, None, 1)], "doc_id long, text string, k1 int")
        out = {r["doc_id"]: r for r in suffix_dedup(docs, width=12, unit="words", hot_bytes=hot).collect()}
        assert out[-1]["n_removed"] == 0
        for k, t in enumerate(texts):
            assert out[k]["kept_text"].split() == [w for w, g in zip(t, gone[k], strict=True) if not g]
            assert out[k]["n_removed"] == len(spaced[k].encode()) - len(out[k]["kept_text"].encode())


def test_bagminhash_is_unbiased():
    draw = np.random.default_rng(5)
    a = draw.integers(0, 5, 60)
    b = np.maximum(a + draw.integers(-2, 3, 60), 0)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    items = draw.integers(0, 2**63, 60).astype(np.uint64)
    both = [np.flatnonzero(x) for x in (a, b)]
    found = signatures(np.repeat([0, 1], [len(x) for x in both]), np.concatenate([items[x] for x in both]), np.concatenate([a[both[0]], b[both[1]]]), 2, 4000)
    assert abs((found[0] == found[1]).mean() - want) < 0.03


def test_near_duplicates(spark):
    draw = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [list(draw.choice(vocabulary, 120)) for _ in range(8)]
    texts = [None, None, "", " \n", "one two", "one two", "long " * 30_000]
    for base in bases:
        for changes in (0, 0, 1, 2, 3, 9):
            t = list(base)
            for i in draw.integers(0, len(t), changes):
                t[i] = "changed"
            texts.append(" ".join(t))
    rows = [(k, t, 0) for k, t in enumerate(texts)]
    hashes, ends = word_hashes(*arrow_text(pa.array(texts, pa.string())))
    bags = [bag(hashes[x:y], 5) for x, y in zip(ends, ends[1:], strict=False)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or overlap(bags[i], bags[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    found = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()}
    assert found == {k: (root(k), root(k) == k) for k in range(len(texts))}
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "g h i j k l"), (5, "g h i j k l"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, ((r["doc_id"], r["class_id"], r["kept"]) for r in near_duplicates(odd).collect()))) == sorted(map(str, [(None, None, True), (3, 1, False), (3, 1, False), (5, 1, False), (1, 1, True), (1, 1, True)]))
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlaps():
    draw = np.random.default_rng(12)
    words = [draw.integers(0, 9, int(n)).astype(np.uint64) for n in draw.integers(1, 60, 30)]
    bags = [bag(x, 2) for x in words] + [bag(np.empty(0, np.uint64), 2)]
    assert np.allclose(overlaps(bags[:20], bags), [[overlap(x, y) for y in bags] for x in bags[:20]])


def test_buckets_without_a_centre(spark, monkeypatch):
    """Chains of copies of copies: neighbours link, others don't, and no text links with all of its bucket."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near_dedup, "MAIN", 1)
    draw = np.random.default_rng(10)
    texts = []
    for _ in range(4):
        t = list(draw.choice([f"w{k}" for k in range(500)], 200))
        for _ in range(15):
            texts.append(" ".join(t))
            for i in draw.integers(0, len(t), 3):
                t[i] = f"new{int(draw.integers(0, 10**9))}"
    order = draw.permutation(len(texts))
    texts = [texts[k] for k in order]
    hashes, ends = word_hashes(*arrow_text(pa.array(texts, pa.string())))
    bags = [bag(hashes[x:y], 5) for x, y in zip(ends, ends[1:], strict=False)]
    near = overlaps(bags, bags) >= 0.8
    root = np.arange(len(texts))
    while True:
        new = np.minimum(root, np.where(near, root[None], len(texts)).min(axis=1))
        if np.array_equal(new, root):
            break
        root = new
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == dict(enumerate(root.tolist())) and len(set(root.tolist())) < len(texts) / 3


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 40), (40, 41), (60, 60)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(31)) and found[50] == found[41] == 40


def test_near_vectors(spark):
    draw = np.random.default_rng(1)
    rows = []
    for k in range(12):
        center = draw.standard_normal(16)
        for _ in range(int(draw.integers(1, 12))):
            rows.append((len(rows), [float(x) for x in (center + 0.07 * draw.standard_normal(16))], int(k % 3)))
    rows += [(len(rows), rows[0][1], 0), (len(rows) + 1, [0.0] * 16, 0), (len(rows) + 2, None, 0), (len(rows) + 3, rows[0][1], None), (len(rows) + 4, [float("nan")] + rows[0][1][1:], 0), (len(rows) + 5, [None] + rows[0][1][1:], 0), (len(rows) + 6, [], 1)]
    ok = {i: (np.array(v), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    linked = {i: {j for j in ok if j != i and ok[j][1] == ok[i][1] and ok[i][0] @ ok[j][0] / np.linalg.norm(ok[i][0]) / np.linalg.norm(ok[j][0]) >= 0.98} for i in ok}
    want = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in linked.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        want[i] = (len(linked.get(i, ())), min(seen), min(seen) == i)
    found = near_vectors(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, node int"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()} == want
    assert any(w[0] >= 6 for w in want.values())
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_links_between_full_lists(spark):
    draw = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        axes = np.linalg.qr(draw.standard_normal((32, 32)))[0]
        turn = np.arccos(0.985)
        for k in range(3 if label else 2):  # groups in a row, only neighbours of which are linked
            center = np.cos(k * turn) * axes[0] + np.sin(k * turn) * axes[1]
            rows += [(len(rows) + i, (center + 0.02 * axes[2 + i + 9 * k]).tolist(), label) for i in range(9)]
    x, labels = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels) & ~np.eye(len(x), dtype=bool)
    nearest = np.argsort(-np.where(near, x @ x.T, -2), axis=1)[:, :6]
    assert near[:9, 9:18].all() and (nearest[:9] < 9).all() and not near[18:27, 36:45].any()
    want = {i: (int(near[i].sum()), 0 if i < 18 else 18, i in (0, 18)) for i in range(len(x))}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for attempts in (1, 0):  # none: all pairs at once
        found = near_vectors(vectors, attempts=attempts, recall=0.0)
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()} == want
