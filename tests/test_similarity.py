"""Similar pairs: exact with pruning, and by hashing with a stated recall, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import similarity


def frame(spark, rows, kind="long"):
    return spark.createDataFrame([(k if kind == "long" else f"k{k:05d}", None if v is None else [float(x) for x in v]) for k, v in rows], f"id {kind}, v array<double>").repartition(3)


def brute(rows, threshold):
    known = [(k, np.array(v)) for k, v in rows if v is not None and len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    out = set()
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


def pairs(df):
    return {(r.left_id, r.right_id) for r in df.collect()}


def clusters(n, of, d, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, d))
    return [(k, centres[k % n] / np.linalg.norm(centres[k % n]) + rng.normal(size=d) * spread) for k in range(n * of)]


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_exact_pairs_equal_brute_force(spark, block):
    rows = clusters(12, 20, 10, 0.08) + [(500, [0.0] * 10), (501, None), (502, []), (503, [float("nan")] * 10), (504, [1.0, 2.0]), (505, [2.0, 4.1]), (506, [1.0, 2.0]), (507, [float("inf")] + [1.0] * 9)]
    found = similarity.similar_pairs(frame(spark, rows), "id", "v", 0.9, block=block).collect()
    assert {(r.left_id, r.right_id) for r in found} == brute(rows, 0.9) and len(found) == len(brute(rows, 0.9)) > 1000
    by_id = dict(rows)
    for r in found[:50]:
        x, y = np.array(by_id[r.left_id]), np.array(by_id[r.right_id])
        assert r.similarity == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))


def test_blocks_that_cannot_meet_do_not(spark):
    rows = clusters(40, 50, 8, 0.03)
    blocks = similarity.packed_blocks(similarity._unit_rows(frame(spark, rows), "id", "v", 0.95), block=50)
    told = similarity.block_pairs(blocks, 0.95).collect()
    n = blocks.count()
    assert len(told) == n * (n + 1) // 2 == len({(r.p, r.q) for r in told})
    # Most pairs of blocks are ruled out by their summaries (two thirds here), none that holds a pair.
    assert sum(r.near for r in told) < 0.4 * len(told)
    where = {i: r.block for r in blocks.select("block", "ids").collect() for i in r.ids}
    near = {(r.p, r.q) for r in told if r.near}
    assert all(tuple(sorted((where[a], where[b]))) in near for a, b in brute(rows, 0.95))


def test_summaries_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(similarity, "GROUP", 3)
    rows = clusters(10, 12, 6, 0.05, 3)
    assert pairs(similarity.similar_pairs(frame(spark, rows), "id", "v", 0.9, block=10)) == brute(rows, 0.9)


def test_pairs_of_texts_and_empty_tables(spark):
    rows = clusters(4, 6, 5, 0.05)
    named = frame(spark, rows, "string")
    want = {(f"k{a:05d}", f"k{b:05d}") for a, b in brute(rows, 0.9)}
    assert pairs(similarity.similar_pairs(named, "id", "v", 0.9)) == want == pairs(similarity.lsh_pairs(named, "id", "v", 0.9, recall=0.9999))
    for method in (similarity.similar_pairs, similarity.lsh_pairs):
        assert method(named.limit(0), "id", "v", 0.9).collect() == []
        with pytest.raises(ValueError, match="threshold"):
            method(named, "id", "v", 0.0)


@pytest.mark.parametrize("recall", [0.95, 0.999])
def test_recall_of_hashing(spark, recall):
    # Pairs at the threshold itself, where they are found least.
    rng, n, d, threshold = np.random.default_rng(4), 1500, 24, 0.9
    base = rng.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=(n, d))
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    other = (threshold + 1e-6) * base + np.sqrt(1 - (threshold + 1e-6) ** 2) * aside
    rows = [(k, v) for k, v in enumerate(np.concatenate([base, other]))]
    found = pairs(similarity.lsh_pairs(frame(spark, rows), "id", "v", threshold, recall=recall))
    planted = {(k, k + n) for k in range(n)}
    assert len(found & planted) >= (recall - 0.015) * n and (recall - 0.015) >= 0.93
    assert found <= pairs(similarity.similar_pairs(frame(spark, rows), "id", "v", threshold))


def test_candidates_grow_with_the_table(spark):
    rng, compared = np.random.default_rng(5), []
    for n in (1000, 4000, 16000):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(rng.normal(size=(n, 12)).tolist())], "id long, v array<double>")
        bits, bands = similarity.lsh_shape(n, 0.9, 0.95)
        cells = similarity.lsh_cells(similarity._unit_rows(rows, "id", "v", 0.9), bits, bands)
        compared.append(cells.groupBy("band", "hash", "d", "p", "q").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] / n)
    # All pairs would be 16 times as many a row at 16 times the rows.
    assert compared[1] < 2.5 * compared[0] and compared[2] < 2.5 * compared[1] and compared[2] < 16000 / 4


def test_common_vector_is_dealt_out(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(150)] + clusters(5, 10, 3, 0.01)[10:]
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    unit_rows = similarity._unit_rows(frame(spark, rows), "id", "v", 0.99)
    cells = similarity.lsh_cells(unit_rows, 6, 4, part=20)
    assert cells.groupBy("band", "hash", "d", "p", "q").count().agg(F.max("count")).first()[0] < 90
    assert cells.filter("p <> q").count() > 0
    similarity_part, similarity.PART = similarity.PART, 20
    try:
        assert pairs(similarity.lsh_pairs(frame(spark, rows), "id", "v", 0.99, recall=0.9999)) == brute(rows, 0.99)
    finally:
        similarity.PART = similarity_part


def test_shape_of_hashing():
    bits = [similarity.lsh_shape(n, 0.9, 0.95)[0] for n in (10, 10_000, 10_000_000, 10_000_000_000)]
    assert bits == sorted(bits) and bits[0] == 4 and bits[-1] > 28
    for n in (1000, 10_000_000):
        b, bands = similarity.lsh_shape(n, 0.9, 0.95)
        found = 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** b) ** bands
        assert 0.95 <= found < 0.97
    assert similarity.lsh_shape(1000, 1.0, 0.95)[1] == 1


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_norm_is_added_up_once(spark):
    rows = frame(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None)])
    found = rows.select("id", similarity.unit("v").alias("u"))
    assert {r.id: r.u for r in found.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [], 4: None}
    assert "CASE WHEN (SQRT(" not in optimized(found) and "SQRT(" not in optimized(similarity._unit_rows(rows, "id", "v", 0.9))


def test_rows_of_length_one(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None), (5, [1.0, float("inf")]), (6, [float("nan"), 1.0]), (7, [1e200, 1.0]), (8, [0.0, 0.0, -2.0])]
    with_null = frame(spark, rows).unionByName(spark.sql("SELECT 9L AS id, array(1.0D, CAST(NULL AS DOUBLE)) AS v"))
    assert {r.id: r.v for r in similarity._unit_rows(with_null, "id", "v", 0.9).collect()} == {1: [0.6, 0.8], 8: [0.0, 0.0, -1.0]}


def test_a_block_moves_once_for_each_cell(spark):
    pairs = spark.range(24).alias("a").crossJoin(spark.range(24).alias("b")).selectExpr("a.id * 1024 AS p", "b.id * 1024 AS q").filter("p <= q")
    cells, n = similarity.tiled(pairs, 4)
    held = cells.selectExpr("x", "y", "size(pairs) AS pairs", "size(array_distinct(flatten(transform(pairs, z -> array(z.p, z.q))))) AS blocks").collect()
    assert len(held) == n == 21 and sum(r.pairs for r in held) == 300
    assert all(r.blocks == (4 if r.x == r.y else 8) for r in held)  # 156 blocks move, not 600


@pytest.mark.parametrize("tile,tiles", [(1, 1), (3, 2), (16, 1)])
def test_pairs_in_tiles_equal_brute_force(spark, monkeypatch, tile, tiles):
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "TILES", tiles)
    rows = clusters(10, 12, 6, 0.05, 3) + [(500 + k, [1.0, float(k)]) for k in range(5)]
    found = similarity.similar_pairs(frame(spark, rows), "id", "v", 0.9, block=10).collect()
    assert {(r.left_id, r.right_id) for r in found} == brute(rows, 0.9) and len(found) == len(brute(rows, 0.9))


def test_pairs_are_compared_once_for_a_sorted_list(spark):
    rows = frame(spark, clusters(4, 6, 5, 0.05)).withColumn("name", F.col("id").cast("string"))
    found = similarity.suggest_merges(rows, "id", "name", rows, "v", threshold=0.9)
    assert "MapInArrow" not in optimized(found) and found.count() == len(brute(clusters(4, 6, 5, 0.05), 0.9))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_pairs_are_sorted_out_and_not_pairs(spark):
    rows = frame(spark, clusters(4, 30, 5, 0.05)).withColumn("name", (F.col("id") % 7).cast("string"))
    plan = executed(similarity.suggest_merges(rows, "id", "name", rows, "v", threshold=0.9))
    # Pairs come out of lists above the one exchange, and no join moves them.
    assert plan.count("- Exchange ") == 1 and plan.index("Generate inline") < plan.index("- Exchange ") and "SortMergeJoin" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sorted_pairs_of_names_equal_brute_force(spark, monkeypatch, kind):
    for size, value in (("STRIP", 7), ("LIST", 16), ("MARK", 4), ("AT_ONCE", 64), ("TILES", 2)):
        monkeypatch.setattr(similarity, size, value)
    # Beside clusters 70 copies of one vector: more pairs of one similarity than a part of the order holds.
    vectors = clusters(6, 12, 5, 0.1) + [(100 + k, [1.0, 2.0, 0.0, 0.5, 3.0]) for k in range(70)] + [(300, None), (301, [0.0] * 5), (302, [1.0, 2.0])]
    told = lambda k: k if kind == "long" else f"k{k:05d}"
    # An id can have two names, no name, or no row.
    names = [(k, f"n{k % 9}") for k, _ in vectors if k not in (3, 104)] + [(5, "n0"), (5, None), (107, "other"), (104, None), (999, "n1")]
    master = spark.createDataFrame([(told(k), n) for k, n in names], f"id {kind}, name string")
    found = similarity.suggest_merges(master, "id", "name", frame(spark, vectors, kind), "v", threshold=0.9, method="exact")
    assert found.columns == ["left_id", "left_name", "right_id", "right_name", "similarity", "suggested_name", "approved", "memo"]
    by_id, of = dict(vectors), {}
    for k, n in names:
        of.setdefault(k, []).extend([n] if n is not None else [])
    cosine = lambda a, b: float(np.dot(by_id[a], by_id[b]) / np.linalg.norm(by_id[a]) / np.linalg.norm(by_id[b]))
    want = [(told(a), x, told(b), y, round(cosine(a, b), 4)) for a, b in brute(vectors, 0.9) for x in of.get(a, []) for y in of.get(b, []) if x != y]
    parts = [[tuple(r)[:5] for r in part] for part in found.rdd.glom().collect()]
    rows = [r for part in parts for r in part]
    assert sorted(rows) == sorted(want) and len(want) > 2000
    assert [(-r[4], r[0], r[2]) for r in rows] == sorted((-r[4], r[0], r[2]) for r in rows)
    assert len(parts) > 20 and max(map(len, parts)) <= 3 * 64


def test_merges_of_nothing(spark):
    rows = frame(spark, clusters(3, 4, 5, 0.05)).withColumn("name", F.lit("one"))
    assert similarity.suggest_merges(rows, "id", "name", rows, "v").collect() == [] == similarity.suggest_merges(rows.limit(0), "id", "name", rows, "v").collect()


def test_floats_move_as_floats(spark):
    rows = frame(spark, clusters(6, 20, 10, 0.08))
    floats = rows.select("id", F.col("v").cast("array<float>").alias("v"))
    met = {k: similarity._meeting(v, "id", "v", 0.9, 50, 4).selectExpr("sum(length(vectors)) AS n", "count(*) AS blocks").first() for k, v in (("float", floats), ("double", rows))}
    assert met["double"].blocks == met["float"].blocks and met["double"].n == 2 * met["float"].n
    # Norms and cosines are those of doubles.
    as_doubles = floats.select("id", F.col("v").cast("array<double>").alias("v"))
    told = [sorted(map(tuple, similarity.similar_pairs(x, "id", "v", 0.9).collect())) for x in (floats, as_doubles)]
    assert told[0] == told[1] and len(told[0]) > 500
