import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import context_mixing as lm
from lexloom.llm import mixing, packing, robust_outliers, rule_ensemble
from lexloom.llm.context_mixing import score_texts
from lexloom.llm.language_id import languages, viterbi
from lexloom.llm.queries import op8_language_id

SF = "/root/testdata/sf0.001"
ODD = [(900_001, None, None, None, 0), (900_002, "", None, "s", 0), (900_003, "a " * 50_000, "en", None, 0), (900_003, "a " * 50_000, "en", None, 0), (None, "the of and", "en", "s", 10), (900_004, "12 34 !!", "en", "s", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    return table.union(spark.createDataFrame(ODD, table.schema)).withColumn("score", F.lit(1)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_rules(spark, docs, labels):
    found = rule_ensemble.quality_scores(docs, labels)
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"] is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    assert {r["score"] for r in rule_ensemble.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert rule_ensemble.quality_scores(docs.limit(0), labels).count() == 0


def test_rules_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = rule_ensemble.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    held = found.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95


def test_rule_columns(spark):
    draw = np.random.default_rng(2)
    x = draw.random((400, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 1] > 0.5) & (x[:, 2] <= 0.6)).astype(float)
    rules, b = rule_ensemble.fit(x, y)
    score = 1 / (1 + np.exp(-(b + sum(w * rule_ensemble.holds(r, x) for r, w in rules))))
    assert ((score > 0.5) == y).mean() > 0.97 and len(rules) < 120
    df = spark.createDataFrame(x.tolist(), list(rule_ensemble.STATISTICS))
    assert np.allclose([r[0] for r in df.select(rule_ensemble.compiled(rules, b)).collect()], score)


def test_outliers(spark, docs):
    out = robust_outliers.quality_outliers(docs).collect()
    assert len(out) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    import re

    for r in out:
        text = texts[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(threes)
        covered = {i + k for i, t in enumerate(threes) if times[t] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])
    assert robust_outliers.quality_outliers(docs.limit(0)).count() == 0


def test_mcd_against_numpy(spark):
    draw = np.random.default_rng(4)
    x = draw.standard_normal((800, 5)) @ draw.standard_normal((5, 5)) * 0.2
    x[:80] += 9
    rows = spark.createDataFrame([("k", *map(float, v)) for v in x], ["key", *robust_outliers.FEATURES])
    m = robust_outliers.mcd(rows).first()
    center = np.array([m[f"m_{i}"] for i in range(5)])
    clean = x[80:]
    assert np.abs(center - clean.mean(axis=0)).max() < 0.1
    root = np.array([[m[f"v_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    far = (((x - center) @ root.T) ** 2).sum(axis=1)
    assert far[:80].min() > 40 and np.quantile(far[80:], 0.99) < 40


def test_chi_square():
    assert math.isclose(robust_outliers.chi_square_quantile(2, 0.95), -2 * math.log(0.05), rel_tol=1e-9)
    assert math.isclose(robust_outliers.chi_square_quantile(5, 0.975), 12.832501994, rel_tol=1e-7)
    assert robust_outliers.consistency(5, 1.0) == 1.0 and 1.3 < robust_outliers.consistency(5, 0.75) < 1.5


def test_mcd_needs_its_starts(spark):
    """Two features that go together, and outliers against that grain: deviations one by one don't show them."""
    draw = np.random.default_rng(5)
    x = draw.standard_normal((600, 5)) * 0.5
    x[:, 1] = x[:, 0] + 0.01 * draw.standard_normal(600)
    x[:60, 0] = np.sign(x[:60, 0]) * (1 + np.abs(x[:60, 0]) / 3)
    x[:60, 1] = -x[:60, 0]
    m = robust_outliers.mcd(spark.createDataFrame([("k", *map(float, v)) for v in x], ["key", *robust_outliers.FEATURES])).first()
    root = np.array([[m[f"v_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    far = (((x - np.array([m[f"m_{i}"] for i in range(5)])) @ root.T) ** 2).sum(axis=1)
    edge = robust_outliers.chi_square_quantile(5, 1 - robust_outliers.TAIL)
    assert far[60:].max() < edge and (far[:60] > edge).mean() > 0.8


def test_outliers_by_brute_force(spark, docs):
    """The verdict of the whole query, by numpy."""
    p, f = len(robust_outliers.FEATURES), robust_outliers
    rows = f.text_counts(docs.select("doc_id", "lang", "source", "text"), "text").select("lang", "source", *f.COUNTS, "n_lines", *f._features()).collect()
    failed = np.array([r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"] for r in rows])
    x = np.array([[r[c] for c in f.FEATURES] for r in rows])
    quantile = lambda v, q: np.quantile(v, q, axis=0, method="inverted_cdf")
    widen = f.consistency(p, f.SHARE)
    inverse = lambda c: np.linalg.inv(np.linalg.cholesky(c + np.eye(p) * f.FLOOR**2))

    def model(x):
        m = quantile(x, 0.5)
        s = 1.4826 * quantile(np.abs(x - m), 0.5)
        z = (x - m) / (s + f.FLOOR)
        n = np.sqrt((z * z).sum(axis=1))[:, None]
        way = np.where(n > 0, (x - m) / np.where(n > 0, n, 1), 0)
        cov = lambda v: np.cov(v.T, bias=True)
        held = [(m, inverse(c)) for c in (np.diag(s * s), cov(np.clip(x, m - 2 * (s + f.FLOOR), m + 2 * (s + f.FLOOR))), p * cov(way))]

        def step(m, v):
            d = (((x - m) @ v.T) ** 2).sum(axis=1)
            near = x[d <= quantile(d, f.SHARE)]
            return near.mean(axis=0), inverse(widen * cov(near))

        for _ in range(f.TRIAL):
            held = [step(*h) for h in held]
        best = min(held, key=lambda h: -np.log(np.diag(h[1])).sum())
        for _ in range(f.STEPS):
            best = step(*best)
        return best

    group = [[(r["lang"], r["source"]), (r["lang"],), ()] for r in rows]
    size = Counter(k for g, bad in zip(group, failed, strict=True) if not bad for k in g)
    own = [next((k for k in g if size[k] >= f.LEAST), None) for g in group]
    models = {k: model(x[[i for i, g in enumerate(group) if k in g and not failed[i]]]) for k in set(own) if k is not None}
    edge = f.chi_square_quantile(p, 1 - f.TAIL)
    want = Counter()
    for i, r in enumerate(rows):
        m, v = models[own[i]]
        d = (((x[i] - m) @ v.T) ** 2).sum()
        want[tuple(r[c] for c in f.COUNTS), bool(not failed[i] and d <= edge)] += 1
    got = Counter((tuple(r[c] for c in f.COUNTS), r["kept"]) for r in f.quality_outliers(docs).collect())
    assert len(models) >= 2 and got == want


def test_viterbi():
    draw = np.random.default_rng(6)
    sizes = [0, 1, 5, 9, 3]
    scores = draw.normal(size=(sum(sizes), 3)) * 4
    offsets = np.append(0, np.cumsum(sizes))
    found = viterbi(scores, offsets, 2.5)
    total = lambda s, path: sum(s[i, p] for i, p in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    import itertools

    for a, b in zip(offsets, offsets[1:], strict=False):
        if 0 < b - a <= 9:
            best = max(total(scores[a:b], p) for p in itertools.product(range(3), repeat=int(b - a)))
            assert math.isclose(total(scores[a:b], found[a:b]), best)


def test_languages(spark, docs):
    out = {r["doc_id"]: r for r in languages(docs).collect()}
    assert out[900_001]["lang_pred"] == out[900_002]["lang_pred"] == out[900_004]["lang_pred"] == "und" and out[900_001]["score"] == 0
    truth = {r["doc_id"]: r["lang"] for r in docs.where("doc_id < 900000").collect()}
    held = [i for i in truth if out[i]["held_out"]]
    assert held and np.mean([out[i]["lang_pred"] == truth[i] for i in held]) >= 0.95
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars > 1500 and n_chars < 4000").collect()}
    mixed = docs.union(spark.createDataFrame([(5_000_000, texts["en"] + "\n" + texts["de"], None, "s", 0, 1)], docs.schema))
    spans = next(r["spans"] for r in languages(mixed).collect() if r["doc_id"] == 5_000_000)
    assert {"en", "de"} <= {s["lang"] for s in spans}
    assert languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_one_word_of_another_script(spark, tmp_path):
    taught = [(k, t, lang, "s", 0) for k in range(1, 40) for t, lang in (("the house of the king and the river", "en"), ("дом короля и река у города", "ru"))]
    text = "the house of the дом king and the river"
    rows = [*taught, (1_000, text, None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = op8_language_id(spark, f"file://{tmp_path}").where("doc_id = 1000").first()
    assert found["lang_pred"] == "en" and [(text[s["start"] : s["end"]], s["lang"]) for s in found["spans"]] == [("the house of the", "en"), ("дом", "ru"), ("king and the river", "en")]


def test_language_model(spark, docs):
    out = score_texts(docs).collect()
    assert len(out) == docs.count()
    train, texts = Counter(), {}
    for r in docs.collect():
        tokens = [w.lower() for w in (r["text"] or "").encode().split()] + [b""]
        texts[r["doc_id"]] = tokens
        if zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 10:
            train.update(tokens)
    n, v = sum(train.values()), len(train)
    for r in out:
        tokens = texts[r["doc_id"]]
        base = sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(t in train for t in tokens), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in docs.collect()}
    for r in out:
        bits = r["bits_per_byte"]
        assert (bits is None) == (not size[r["doc_id"]]) and (bits is None or math.isclose(bits, -r["score"] * math.log2(10) / size[r["doc_id"]]))
    held = [r for r in out if r["held_out"]]
    assert -sum(r["score"] for r in held) * math.log2(10) / sum(size[r["doc_id"]] for r in held) < 4
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert score_texts(docs.limit(0)).count() == 0


def test_language_model_held_out(spark):
    out = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert len(out) == 2 and all(r["s"] > r["b"] for r in out)


def test_tokens_and_states():
    import re

    draw = np.random.default_rng(21)
    texts = ["".join(draw.choice(["a", "B", "é", "the", "x1", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\u00a0"], 30)) for _ in range(50)] + [None, "", " ", "one"]
    tokens = lm.Tokens.of(pa.array(texts, pa.string()))
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    want = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for t in low]
    assert [[tokens.words[k] for k in tokens.word[tokens.doc == i]] for i in range(len(texts))] == want
    part = lm.Tokens.of(pa.array(texts, pa.string()).slice(7, 20))
    assert [[part.words[k] for k in part.word[part.doc == i]] for i in range(20)] == want[7:27]
    leaves = lm.Leaves([b"the", b"a", b"", b"b"], 2)
    leaf, state, offsets = leaves.of(tokens)
    for i, t in enumerate(want):
        anchor = kind = 0
        for k, w in enumerate([*t, b""]):
            at = offsets[i] + k
            assert state[at] == anchor * lm.KINDS + kind
            assert leaf[at] == (leaves.place[w] if w in leaves.place else 4 + w[0])
            anchor = {b"the": 1, b"a": 2}.get(w, anchor)
            kind = 1 if w in (b"the", b"a") else 2 if w == b"b" else 3


def test_leaves_sum_to_one_and_follow_the_counts():
    draw = np.random.default_rng(3)
    tree = lm.Tree(draw.integers(1, 1000, 40))
    counts, mixer = lm.Counts(lm.WORD_BITS), lm._word_mixer()
    for _ in range(30):
        leaf = draw.integers(0, 5, 500)
        row, node, bit = tree.steps(leaf)
        slots = lm._word_slots(np.full(len(leaf), 6)[row], node, counts.first)
        mixer.learn(*lm._word_inputs(*counts.of(slots)), bit, np.ones(len(bit)))
        counts.add(slots, 1.0 - bit, bit)
    found = lm.leaf_scores(tree, counts, mixer, 8)
    assert np.allclose((10.0**found).sum(axis=1), 1, atol=1e-4)
    assert (10.0 ** found[6, :5]).sum() > 0.97
    for k in range(40):  # the walk, bit by bit
        _, node, bit = tree.steps(np.array([k]))
        slots = lm._word_slots(np.full(len(node), 6), node, counts.first)
        p = mixer.predict(*lm._word_inputs(*counts.of(slots)))
        assert math.isclose(found[6, k], np.log10(np.where(bit == 1, p, 1 - p)).sum(), abs_tol=1e-3)


def test_whole_tokens_before_tell_what_comes_next(spark):
    """Tokens that are no anchors and of one kind, each as often as the others: only the whole tokens before tell them apart."""
    anchors = " ".join(f"a{k:02}" for k in range(31))
    pair = lambda k, m: f"{anchors} p{k:02} q{m:02}"
    three = lambda k, m: f"{anchors} r{k:02} same s{m:02}"
    train = [(i, t(k, k)) for i, (t, k) in enumerate((t, k) for _ in range(40) for t in (pair, three) for k in range(20))]
    train = [(i * 1000 + next(x for x in range(1000) if zlib.crc32(str(i * 1000 + x).encode()) % 10), text) for i, text in train]
    asked = {9_000_000 + 2 * k + swapped: (t, k, swapped) for t, k, swapped in ((pair, 1, 0), (pair, 1, 1))}
    asked |= {9_000_010 + swapped: (three, 1, swapped) for swapped in (0, 1)}
    own = {d * 1000 + next(x for x in range(1000) if zlib.crc32(str(d * 1000 + x).encode()) % 10 == 0): v for d, v in asked.items()}
    rows = train + [(d, t(k, (k + 7 * swapped) % 20)) for d, (t, k, swapped) in own.items()]
    found = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert all(found[d]["held_out"] for d in own)
    score = {(t, swapped): found[d]["score"] for d, (t, _, swapped) in own.items()}
    assert score[pair, 0] > score[pair, 1] + 1 and score[three, 0] > score[three, 1] + 0.5


def test_tokens_before_and_walks_sum_to_one():
    draw = np.random.default_rng(5)
    tokens = lm.Tokens.of(pa.array(["a b c", None, "c b c b", " b c", "a b zz"], pa.string()))
    leaves = lm.Leaves([b"a", b"", b"b", b"c"], 1)
    leaf, state, _ = leaves.of(tokens)
    hashed = lm.token_hashes(tokens)
    before = lm.tokens_before(hashed)
    want = [(t[k - 1] if k else None, t[k - 2] if k > 1 else None) for t in (["a", "b", "c"], [], ["c", "b", "c", "b"], ["b", "c"], ["a", "b", "zz"]) for k in range(len(t) + 1)]
    for k, distinct in ((0, [w[0] for w in want]), (1, want)):
        assert len(set(before[k].tolist())) == len(set(distinct)) == len(set(zip(before[k].tolist(), distinct, strict=True)))
    tree = lm.Tree(draw.integers(1, 1000, 4 + 256))
    counts, mixer, last = lm.Counts((*lm.WORD_BITS, *lm.TOKEN_BITS)), lm._word_mixer(), lm._token_mixer()
    for _ in range(30):
        lm.learn_words(leaf, state, hashed, tree, counts, mixer, last, draw)
    given = lm.node_scores(tree, counts, mixer, 8).astype(np.float32)
    for k in (0, 2, len(leaf) - 1):
        found = [lm.walk_scores(np.array([x]), state[k : k + 1], hashed[k : k + 3], tree, given, counts.ending(2), last)[0] for x in range(tree.n)]
        assert math.isclose((10.0 ** np.array(found)).sum(), 1, abs_tol=1e-4)
    whole = lm.walk_scores(leaf, state, hashed, tree, given, counts, last)
    alone = [lm.walk_scores(leaf[k : k + 1], state[k : k + 1], hashed[k : k + 3], tree, given, counts, last)[0] for k in range(len(leaf))]
    assert np.allclose(whole, alone, atol=1e-5) and whole.mean() > tree.leaves(given)[state, leaf].mean()


def test_a_task_holds_few_bytes_for_each_token(monkeypatch):
    """Learning and scoring go piece by piece: they hold less for each token of a batch than six numbers."""
    import tracemalloc

    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = lambda self: 0

    class Shared:
        def __init__(self, *value):
            self.value = value

    monkeypatch.setattr(lm, "TaskContext", Task)
    for name, value in (("_STEP", 1 << 14), ("WORD_BITS", (8, 8, 8, 8)), ("TOKEN_BITS", (10, 10))):  # tables that don't grow with the batch
        monkeypatch.setattr(lm, name, value)
    draw = np.random.default_rng(11)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(words[k] for k in row) for row in draw.integers(0, 5000, (600, 1000))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "held_out": [False] * 600, "text": texts})
    leaves = lm.Leaves([b"w1", b"", b"w2", b"w3"], 1)
    tree = lm.Tree(draw.integers(1, 1000, 4 + 256))
    counts, mixer, last = lm.Counts((*lm.WORD_BITS, *lm.TOKEN_BITS)), lm._word_mixer(), lm._token_mixer()
    given = lm.node_scores(tree, counts, mixer, 3 * lm.KINDS).astype(np.float32)
    names = [*leaves.place, *(w.encode() for w in words if w.encode() not in leaves.place)]
    known = (pa.array(names, pa.binary()), np.ones(len(names), np.int64), np.zeros(len(names)), np.zeros(len(names)))
    peak = []
    for run in (lm._learn_words(Shared(leaves, tree)), lm._score_texts(Shared(leaves, tree, given, counts.ending(2), last, *known))):
        tracemalloc.start()
        out = next(run(iter([batch])))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert out["n_tokens"].to_pylist()[:600] == [1001] * 600
    assert max(peak) < 48 * 600_600, [p / 600_600 for p in peak]


def test_pieces_are_whole_texts():
    texts = ["a b c", None, "", "B  c b c", " b c", "d " * 9, "a"]
    tokens = lm.Tokens.of(pa.array(texts, pa.string()))
    want = [[tokens.words[k] for k in tokens.word[tokens.doc == i]] for i in range(len(texts))]
    leaves = lm.Leaves([b"a", b"", b"b", b"c"], 1)
    whole = leaves.of(tokens)[:2], lm.token_hashes(tokens)
    for most in (1, 4, 7, 1000):
        found, begins = [], []
        for begin, some in tokens.pieces(most):
            assert begin == len(found) and (len(some.word) <= most or some.n == 1)
            found += [[some.words[k] for k in some.word[some.doc == i]] for i in range(some.n)]
            begins.append((leaves.of(some)[:2], lm.token_hashes(some)[2:]))
        assert found == want
        assert all((np.concatenate([b[0][k] for b in begins]) == whole[0][k]).all() for k in (0, 1))
        assert (np.concatenate([b[1] for b in begins]) == whole[1][2:]).all()
    leaf, state, hashed = lm.prepared(tokens, leaves)
    assert (leaf == whole[0][0]).all() and (state == whole[0][1]).all() and (hashed == whole[1]).all()


def test_spelling_sums_to_one_at_most():
    counts, mixer = lm.Counts(lm._SPELL_BITS), lm._spell_mixer()
    words = [b"ab", b"abc", b"b", b"ba"] * 50
    slots, bit, _ = lm._spelling(words)
    for _ in range(5):
        mixer.learn(*lm._spell_inputs(*counts.of(slots)), bit, np.ones(len(bit)))
        counts.add(slots, 1.0 - bit, bit)
    every = [b"a" + bytes(x) for n in (0, 1, 2) for x in __import__("itertools").product([c for c in range(256) if chr(c) not in " \t\n\x0b\x0c\r"], repeat=n)]
    mass = 10.0 ** lm.spelt(every, counts, mixer)
    assert mass.sum() < 1 + 1e-6 and mass[every.index(b"ab")] + mass[every.index(b"abc")] > 0.8


def test_backed_off_sums_to_one():
    count, spelt = np.array([5, 1, 1, 0, 0]), np.log10(np.array([0.1, 0.2, 0.3, 0.25, 0.15]))
    assert math.isclose((10.0 ** lm.backed_off(count, spelt, np.full(5, 7.0), np.full(5, 3.0), 0.6)).sum(), 1.0)
    assert np.array_equal(lm.backed_off(count * 0, spelt, np.zeros(5), np.zeros(5), 0.5), spelt)


def test_exponent():
    tokens = {"a": 900, "b": 90, "c": 10, "d": 0}
    x = mixing.exponent(tokens, 1000, most=None)
    w = mixing.weights(tokens, x)
    assert math.isclose(mixing.entropy(w), 0.9 * math.log(3), rel_tol=1e-6) and w["d"] == 0 and math.isclose(sum(w.values()), 1)
    y = mixing.exponent(tokens, 1000, most=4.0)
    assert mixing.repetition(tokens, mixing.weights(tokens, y), 1000) <= 4.0 + 1e-9 and y > x
    assert mixing.exponent({}, 0) == 1.0 and mixing.exponent({"a": 5}, 5) == 1.0


def test_mix(spark, docs):
    big = docs.withColumn("source", F.when(F.col("doc_id") % 10 < 7, "hot").otherwise(F.col("source")))
    out = mixing.mix_sources(big, target_entropy=0.95)
    rows = out.collect()
    tokens = Counter()
    longest = Counter()
    for r in big.collect():
        n = len((r["text"] or "").split())
        key = r["source"]
        tokens[key] += n
        longest[key] = max(longest[key], n)
    named = {("-" if k is None else "=" + k): v for k, v in tokens.items()}
    budget = sum(tokens.values())
    w = mixing.weights(named, mixing.exponent(named, budget, target_entropy=0.95))
    got = Counter()
    for r in rows:
        got[r["source"]] += r["mix_tokens"]
    for s in tokens:
        goal = w["-" if s is None else "=" + s] * budget
        copies = 2 if s is None else 1
        assert abs(got[s] - goal) <= copies * longest[s] or not tokens[s]
    assert set(big.columns) <= set(out.columns) and all(0 <= r["mix_place"] <= 1.0 + 1e-9 for r in rows)
    whole = Counter((r["doc_id"], r["text"], r["mix_block"]) for r in rows)
    assert all(n == 2 if k[0] == 900_003 else n == 1 for k, n in whole.items())
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_pack(spark, docs):
    rows = packing.pack(docs).collect()
    slow = packing.encoder(packing.tokenizer_files()[0], None, None)
    want, got = Counter(), Counter()
    for r in docs.collect():
        ids = (slow(r["text"]) if r["text"] else b"") + b"\0\0\0\0"
        n = len(ids) // 4
        cuts = [0, *range(n % 2048 or 2048, n + 1, 2048)] if n > 2048 else [0, n]
        want.update((r["doc_id"], k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    bins = {}
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want and any(k[1] > 0 for k in want)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(bins) <= least + 2 and (len(bins) > least or all(r["proven"] for r in rows))
    assert packing.pack(docs.limit(0)).count() == 0


def least_bins(sizes, capacity):
    """By trying every bin for every piece."""
    best = len(sizes)

    def place(k, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if k == len(sizes):
            best = len(spaces)
            return
        for i in range(len(spaces)):
            if spaces[i] >= sizes[k] and spaces[i] not in spaces[:i]:
                place(k + 1, [*spaces[:i], spaces[i] - sizes[k], *spaces[i + 1 :]])
        place(k + 1, [*spaces, capacity - sizes[k]])

    place(0, [])
    return best


def test_bin_completion():
    draw = np.random.default_rng(8)
    for capacity, n, trials in ((100, 200, 5), (30, 9, 120)):
        for _ in range(trials):
            sizes = sorted(draw.integers(max(1, capacity // 20), capacity * 6 // 10, n).tolist(), reverse=True)
            counts = Counter(sizes)
            patterns, proven = packing.complete(dict(counts), capacity)
            used = Counter()
            for p, times in patterns:
                assert sum(p) <= capacity
                for s in p:
                    used[s] += times
            assert used == counts
            bins = sum(times for _, times in patterns)
            assert bins <= sum(times for _, times in packing.best_fit(dict(counts), capacity))
            if n < 10:
                assert proven and bins == least_bins(sizes, capacity)


def test_bin_completion_beats_best_fit():
    worse = 0
    draw = np.random.default_rng(1)
    for _ in range(300):
        counts = Counter(draw.integers(10, 50, 12).tolist())
        patterns, proven = packing.complete(dict(counts), 100)
        worse += sum(n for _, n in patterns) < sum(n for _, n in packing.best_fit(dict(counts), 100))
    assert worse  # best-fit decreasing isn't the least for all of them


def test_encoder_is_the_tokenizer():
    files = packing.tokenizer_files()
    fast, slow = packing.encoder(*files), packing.encoder(files[0], None, None)
    for text in ("a b", " lead", "tail ", "two  spaces", "é ü\n\nx", "<|endoftext|> x", "it's 12'3", "\t x", "a b c"):
        assert fast(text) == slow(text)


def test_encoder_on_mixed_white_space():
    files = packing.tokenizer_files()
    fast, slow = packing.encoder(*files), packing.encoder(files[0], None, None)
    draw = np.random.default_rng(11)
    parts = ["a", "word", "é", "12", "!", " ", " ", " ", "\u00a0", "\t", "\n", "\r", "\u2003", "\u3000", "\u0085", "\x1c", "\u200b"]
    for text in ("a \u00a0 \u00a0", "word \u00a0 \u00a0 \u00a0 \u00a0 next", *("".join(draw.choice(parts, 12)) for _ in range(5000))):
        assert fast(text) == slow(text), repr(text)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        docs = out.cache()
        left = {r["doc_id"] for r in docs.collect()}
        assert left and left <= ids
        ids = left
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_pipeline_stages_on_odd_rows(spark):
    draw = np.random.default_rng(17)
    words = lambda n: list(draw.choice([f"w{k}" for k in range(3000)], int(n)))
    passage, base = words(51), words(300)
    copy = list(base)
    copy[150] = "other"
    texts = {1: base, 2: copy, 3: base, 4: words(90) + passage + words(80), 5: words(70) + passage, 6: words(60), 7: ["long"] * 30_000}
    rows = [(k, " ".join(t), "en", "s", 0, 1) for k, t in texts.items()] + [(8, None, None, None, None, 1), (9, "", "en", "s", 0, 1), (6, " ".join(texts[6]), "en", "s", 0, 1), (None, "no id", "en", None, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int")
    near, passages = (dict(corpus_pipeline.STAGES)[n] for n in ("minhash near-dedup", "suffix-array dedup"))
    kept = near(spark, docs, SF)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9]  # one of each group, and of the rows that share an id
    found = {r["doc_id"]: r for r in passages(spark, kept.cache(), SF).collect()}
    assert 7 not in found and found[8]["text"] is None and found[9]["text"] == "" and found[None]["text"] == "no id"
    assert found[4]["text"].split() == texts[4][:90] + texts[4][141:] and found[5]["text"].split() == texts[5][:70]
    assert found[1]["text"] == " ".join(base) and found[4]["n_chars"] == len(found[4]["text"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).count() <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").count().count() == 10
