"""Whitening, hard negatives and the factorisation machine against brute force, and in defined cases."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("larder.llm.registry")

from larder.llm import factor_machine, negatives, whitening  # noqa: E402
from larder.llm.registry import QUERIES, SQL  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, x string, z string, index string, v string"
CLASH = ("a", "b", "c", "d")


def vectors(spark, rows, files=3):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(files)


def on_disk(spark, folder, rows, schema=None):
    spark.createDataFrame(rows, schema or "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def drawn(n, d, seed=1, labels=4):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    return [(k, [float(np.float32(x)) for x in rng.normal(size=d)], pick.randrange(labels)) for k in range(n)]


BAD = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 5, 1), (903, [float("inf")] * 5, 2)]


# --- whitening


def brute_whitening(rows, components=16):
    kept = [(i, v) for i, v, *_ in rows if usable(v)]
    d = max((len(v) for _, v in kept), default=0)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (d - len(v))]] for _, v in kept], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, total = len(fit), fit.sum(0)
    away = n * x - total
    a = (n * fit - total).astype(float) / n
    e, q = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-e)[:components]
    return kept, n, (away * away).sum(1).tolist(), away.astype(float) / n, e[order], q[:, order], float(np.trace(a.T @ a / n))


def held_against_brute(found, rows, components=16):
    kept, n, deviation, centred, e, q, trace = brute_whitening(rows, components)
    assert len(found) == len(kept) * len(e)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.component, r.n, r.deviation) for r in found) == sorted((i if i is not None else -1, k + 1, n, dev) for (i, _), dev in zip(kept, deviation, strict=True) for k in range(len(e)))
    z = centred @ q / np.sqrt(e)
    for k in range(len(e)):
        mine = np.array(sorted(r.whitened for r in found if r.component == k + 1))
        want = np.sort(z[:, k])
        assert np.allclose(mine, want, atol=1e-8) or np.allclose(mine, np.sort(-z[:, k]), atol=1e-8)
        assert all(r.explained == pytest.approx(e[k] / trace, rel=1e-9) for r in found if r.component == k + 1)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


def test_whitening_equals_brute_force(spark, tmp_path):
    rows = drawn(150, 20) + [(7, drawn(150, 20)[7][1], 0), (8, drawn(150, 20)[9][1], 1), (None, drawn(2, 20, 5)[1][1], None)] + BAD
    held_against_brute(QUERIES["op11_block_whitening"](spark, on_disk(spark, tmp_path, rows)).collect(), rows)


def test_whitening_of_given_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    held_against_brute(QUERIES["op11_block_whitening"](spark, "/root/testdata/sf0.001").collect(), rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_whitening_over_several_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(whitening, "LEAST_ROWS", 16)
    monkeypatch.setattr(whitening, "ENOUGH_BLOCKS", 5)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(whitening, "TASK_BYTES", 1024)
    rows = drawn(130, 11, seed)
    held_against_brute(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_defined_cases(spark, tmp_path):
    # Short vectors are padded; a dimension that doesn't vary can't be whitened; equal rows count once.
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0, 0.0], 0), (3, [3.0, 1.0, 0.0], 0), (4, [-1.0, 0.5], 0), (4, [-1.0, 0.5], 0)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.n for r in found} == {3} and len(found) == 15
    assert {r.component for r in found if r.whitened is None} == {3}
    assert found[0].identity_error < 1e-9
    by_id = {(r.vec_id, r.component): r.whitened for r in found}
    assert by_id[1, 1] == pytest.approx(by_id[2, 1])
    alone = whitening.whiten(vectors(spark, [(5, [1.0, 2.0], 0)] * 3)).collect()
    assert len(alone) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.n == 1 and r.deviation == 0 for r in alone)
    for empty in ([], BAD, [(1, [], 0)]):
        assert whitening.whiten(vectors(spark, empty)).collect() == []
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e30], 0), (2, [0.0], 0)])).collect()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(k, [float(k * 2**30)], 0) for k in range(8)])).collect()


def test_whitening_common_vector(spark):
    rows = [(k, [0.5, 0.25, -1.0], 0) for k in range(300)] + drawn(40, 3)
    held_against_brute(whitening.whiten(vectors(spark, rows)).collect(), rows)


# --- hard negatives


def brute_negatives(rows, anchors=lambda i: i % 100 == 0, positives=5, wanted=10):
    known = sorted({(i, label, tuple(float(math.floor(256 * c)) for c in v)) for i, v, label in rows if i is not None and label is not None and usable(v)})
    product = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, label, v in known:
        if not anchors(i):
            continue
        others = sorted((-product(v, w), j, m) for j, m, w in known if j != i)
        for p, j, _ in [x for x in others if x[2] == label][:positives]:
            inside = [(s, k) for s, k, m in others if m != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(inside[:wanted], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("tree_block", "anchor_block"), [(4096, 1024), (40, 3), (7, 1)])
def test_negatives_equal_brute_force(spark, tree_block, anchor_block):
    rows = drawn(400, 6) + [(50, drawn(400, 6)[50][1], drawn(400, 6)[50][2]), (51, [0.5] * 6, 1), (None, [0.5] * 6, 1), (7, [0.5] * 6, None)] + BAD
    whole = negatives.whole_rows(vectors(spark, rows))
    found = negatives.hard_negatives(whole, whole.filter("vec_id % 9 = 0"), tree_block=tree_block, anchor_block=anchor_block)
    want = brute_negatives(rows, lambda i: i % 9 == 0)
    assert want and told(found) == want


def test_negatives_with_ties_copies_and_one_label(spark):
    # A third of the rows is one vector; another label is hot; ids stand twice with other vectors, anchors' too.
    rows = [(k, [1.0, 0.5, 0.25], k % 2) for k in range(120)] + [(k, v, 3) for k, v, _ in drawn(260, 3, 4)]
    rows += [(k, [0.75, 0.5, 0.25 * (k % 3)], 2) for k in range(100, 160)]
    whole = negatives.whole_rows(vectors(spark, rows))
    found = negatives.hard_negatives(whole, whole.filter("vec_id % 20 = 0"), tree_block=32, anchor_block=4, positives=3, negatives=4)
    assert told(found) == brute_negatives(rows, lambda i: i % 20 == 0, 3, 4)


def test_negatives_whole_numbers_of_any_size(spark):
    rows = [(k, [x * 2.0**17 for x in v], label) for k, v, label in drawn(60, 3, 8, labels=2)]
    whole = negatives.whole_rows(vectors(spark, rows))
    found = negatives.hard_negatives(whole, whole.filter("vec_id % 10 = 0"), tree_block=16)
    assert told(found) == brute_negatives(rows, lambda i: i % 10 == 0)
    huge = negatives.whole_rows(vectors(spark, [(1, [1e30], 0), (2, [1e30], 0), (3, [1e30], 1)]))
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(huge, huge).collect()


def test_negatives_defined_cases(spark):
    empty = negatives.whole_rows(vectors(spark, BAD))
    assert negatives.hard_negatives(empty, empty).collect() == []
    # No positive; a positive with a negative score; labels alone; vectors of other lengths.
    rows = [(0, [1.0, 0.0], 0), (1, [0.5], 1), (2, [-1.0], 0), (3, [0.3], 2), (4, [1.0, 5.0], 1)]
    whole = negatives.whole_rows(vectors(spark, rows))
    assert told(negatives.hard_negatives(whole, whole)) == brute_negatives(rows, lambda i: True)
    assert negatives.hard_negatives(whole, whole.filter("vec_id = 3")).collect() == []


def test_query_of_negatives_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = drawn(1500, 8, 6, labels=10) + [(200, drawn(3, 8)[1][1], 5), (300, drawn(1500, 8, 6)[300][1], drawn(1500, 8, 6, labels=10)[300][2])] + BAD
    folder = on_disk(spark, tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    found = told(QUERIES["op13_packed_tree_negatives"](spark, folder))
    assert found == sorted(con.sql(SQL["op13_packed_tree_negatives"]).fetchall())
    shifted = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert found == brute_negatives(shifted)


def test_boxes_bound_scores():
    rng = np.random.default_rng(3)
    rows, anchors = rng.integers(-256, 256, (500, 5)).astype(float), rng.integers(-256, 256, (9, 5)).astype(float)
    tree = negatives.Tree(np.arange(500), np.zeros(500, np.int64), rows)
    low, high = negatives._intervals(anchors, *tree.leaf_boxes)
    for k, (a, b) in enumerate(zip(tree.leaves, tree.ends, strict=True)):
        scores = anchors @ rows[a:b].T
        assert (low[:, k] <= scores.min(1)).all() and (scores.max(1) <= high[:, k]).all()


def test_queue_passes_over_boxes():
    # Clusters far apart: most leaves aren't opened.
    rng = np.random.default_rng(4)
    centres = rng.choice([-200.0, 200.0], (16, 8))
    rows = np.repeat(centres, 256, axis=0) + rng.integers(-8, 8, (4096, 8))
    order = negatives._leaf_order(np.zeros(4096, np.int64), rows)
    tree = negatives.Tree(np.arange(4096), np.zeros(4096, np.int64), rows[order])
    search = negatives.Search(tree, np.array([-1]), np.array([1]), centres[:1])
    opened, score = [], search.scores
    search.scores = lambda slot, a, b: opened.append(a) or score(slot, a, b)
    found = search.run(0, 10, [(-(2**63), 2**63 - 1, -(2**63))], same=False)[0]
    products = rows[order] @ centres[0]
    assert found == sorted((-int(p), k) for k, p in enumerate(products))[:10]
    assert len(opened) < len(tree.leaves) // 2


# --- factorisation machine


def test_interactions_in_linear_time():
    rng = np.random.default_rng(5)
    machine = factor_machine.Machine(0.3, rng.normal(size=factor_machine.BUCKETS + factor_machine.PLACES), rng.normal(size=(factor_machine.BUCKETS + factor_machine.PLACES, factor_machine.FACTORS)))
    docs = [(p := np.sort(rng.choice(2000, 12, replace=False)), rng.normal(size=len(p))) for _ in range(5)]
    starts = np.arange(5) * 12
    found = machine.margins(*(np.concatenate(x) for x in zip(*docs, strict=True)), starts)
    for (places, values), margin in zip(docs, found, strict=True):
        linear = sum(machine.linear[p] * x for p, x in zip(places, values, strict=True))
        pairs = sum(float(machine.factors[places[i]] @ machine.factors[places[j]]) * values[i] * values[j] for i, j in combinations(range(len(places)), 2))
        assert margin == pytest.approx(0.3 + linear + pairs)


def test_machine_learns_an_interaction():
    # Neither place tells the label; the pair does.
    rng = random.Random(6)
    rows, labels = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((np.array([1 if a else 2, 3 if b else 4]), np.ones(2)))
        labels.append(float(a == b))
    machine = factor_machine.fit(rows, np.array(labels), np.ones(600), epochs=60)
    assert ((machine.probabilities(rows) >= 0.5) == np.array(labels)).mean() > 0.99


WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "ck ld mp nd rt st sh".split()]


def labelled(spark, n=260):
    pick = random.Random(9)
    prose = lambda k: " ".join(pick.choice(WORDS) for _ in range(k))
    texts = {k: prose(40) if k % 4 else " ".join(w + pick.choice(["###", "%%%"]) for w in prose(40).split()) for k in range(n)}
    docs = [(k, t, len(t), "clash", "clash") for k, t in texts.items()]
    docs += [(1000, None, None, "", None), (1001, "", 0, None, ""), (1002, " \n\t", 3, "", ""), (1003, "one", 3, "", ""), (1003, "one", 3, "", ""), (None, "one two", None, "", ""), (1004, "long text " * 60_000, None, "", "")]
    labels = [(k, int(k % 4 > 0), 0) for k in range(n)] + [(None, 1, 0), (5, None, 0), (1004, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long, score string, places string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_scores(spark):
    docs, labels = labelled(spark)
    machine = factor_machine.learn(docs, labels, metadata=("n_chars",))
    out = factor_machine.score(docs, machine, metadata=("n_chars",)).withColumn("held_out", factor_machine.held_out()).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 260]
    assert len(held) > 30 and all(r.predicted == int(r.doc_id % 4 > 0) for r in held)
    assert len({r.score for r in out if r.doc_id == 1003}) == 1 and "places" in out[0].asDict()
    # The same rows by a plain loop over all pairs.
    tool = factor_machine.Features()
    for r in out[:20]:
        places, values = tool.of(r.text or "", [r.n_chars])
        pairs = sum(float(machine.factors[places[i]].astype(float) @ machine.factors[places[j]]) * values[i] * values[j] for i, j in combinations(range(len(places)), 2))
        margin = machine.offset + float(machine.linear[places] @ values) + pairs
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-5)
    again = factor_machine.learn(docs.repartition(5), labels.repartition(2), metadata=("n_chars",))
    assert np.array_equal(again.factors, machine.factors) and again.offset == machine.offset


def test_quality_without_labels(spark):
    docs, labels = labelled(spark, 20)
    for some, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0"), 0.0)):
        scores = [r.score for r in factor_machine.score(docs, factor_machine.learn(docs, some)).collect()]
        assert scores == pytest.approx([want] * len(scores), abs=1e-8)
    empty = docs.limit(0)
    assert factor_machine.score(empty, factor_machine.learn(empty, labels)).collect() == []


def test_held_out_rows_are_not_learned_from(spark):
    docs, labels = labelled(spark)
    spoilt = labels.withColumn("quality", F.when(factor_machine.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (factor_machine.learn(docs, x) for x in (labels, spoilt))
    assert np.array_equal(one.factors, two.factors)


def test_held_out_accuracy_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op12_factor_machine"](spark, folder).collect()
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert len(rows) == 1000 and sum(p == q for p, q in held) >= 0.93 * len(held)
    assert all(p == 1 for p, q in held if q == 1)
