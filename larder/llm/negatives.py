"""Operator 13: hard negatives by a packed R-tree.

Components become whole numbers, floor(256 x). Rows are packed by sort-tile-recursive: the label is the first axis, tiles of the two components
that vary most come next, the third orders what is left, and ranges of that order are the blocks, so no label, however common, and no
vector, however often it stands, makes a large block. Inside a block the same packing gives leaves of LEAF rows and nodes of FANOUT leaves,
each with its minimum bounding box. The product of an anchor with a box has an interval for each coordinate; their sums bound the scores in the box.

A search takes an anchor and windows of scores with a number of wanted rows each. Its queue gives the box with the highest upper bound first and
passes over boxes whose interval lies outside all windows or strictly below the k-th score of each window that it meets, and
boxes without a row of a wanted label. Anchors are packed alike; a pair of an anchor block and a tree block is a cell of bounded size. Positives are searched in cells that share a label.
For negatives every anchor block first searches the tree block that promises most; the k-th scores found there travel with the anchors, cells
that by their blocks' boxes can't give a row are dropped before any vector moves, and the best rows of the other cells are merged.

Defined cases: rows with null id, null label, null vector or a null or non-finite component take no part; shorter vectors count as padded with
zeros; rows alike in id, label and vector count once; other rows that share an id are rows of their own and, if it is an anchor's,
anchors of their own, but no row serves an anchor of its id; ties go to the smaller id; anchors without positives give
no rows, and neither do positives with a negative score (their window is empty); empty tables give no rows. Where sums can pass 2^53, boxes rule nothing out
and whole numbers of any size score; a score that no long holds times 100 is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import removed, written

TREE_BLOCK, ANCHOR_BLOCK = 4096, 1024
LEAF, FANOUT = 64, 8
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of its positive's.
WINDOW = (30, 90)
EXACT = 2.0**53
ANY = (float("-inf"), float("inf"))


def whole_rows(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and v, whole numbers as doubles, of the rows that take part, each once."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull()).filter(finite)
    large = lambda v: F.lit(256.0) * v.cast("double")
    # Doubles from 2^53 are whole, and floor() gives a long. Adding 0 makes one zero of two.
    cut = F.transform(embedding, lambda v: F.when(F.abs(large(v)) < EXACT, F.floor(large(v)).cast("double")).otherwise(large(v)) + F.lit(0.0))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), cut.alias("v")).dropDuplicates()


def tiled(rows: DataFrame, n_blocks: int, dimensions: int) -> DataFrame:
    """rows dealt into n_blocks ranges of the packing's order: label, tiles of two components, a third one, id."""
    told = rows.agg(F.approx_count_distinct("label").alias("labels"), *[F.var_pop(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(dimensions)]).first()
    spread = sorted(range(dimensions), key=lambda k: (-(told[f"v{k}"] or 0.0), k))
    x, y, z = (F.coalesce(F.get("v", F.lit(spread[min(k, dimensions - 1)])), F.lit(0.0)) for k in range(3))
    tiles = max(1, round((n_blocks / max(1, told.labels)) ** (1 / 3)))
    steps = [k / tiles for k in range(1, tiles)]
    if steps:
        cuts = rows.agg(F.percentile_approx(x, steps, 1000)).first()[0] or []
        slab = lambda c, at: F.aggregate(at, F.lit(0), lambda s, cut: s + (c > cut).cast("int"))
        rows = rows.withColumn("_x", slab(x, F.array(*[F.lit(c) for c in cuts])))
        # tiles rows of tiles - 1 cuts.
        inner = {r["_x"]: r["cuts"] for r in rows.groupBy("_x").agg(F.percentile_approx(y, steps, 1000).alias("cuts")).collect()}
        table = F.array(*[F.array(*[F.lit(float(c)) for c in inner.get(k, [0.0] * len(steps))]) for k in range(tiles)])
        rows = rows.withColumn("_y", slab(y, F.get(table, F.col("_x"))))
    else:
        rows = rows.withColumns({"_x": F.lit(0), "_y": F.lit(0)})
    return rows.withColumn("_z", z).repartitionByRange(n_blocks, "label", "_x", "_y", "_z", "vec_id", F.xxhash64("v")).select("vec_id", "label", "v")


def _leaf_order(labels: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive inside a block: labels, slabs of the component that varies most, the next inside each slab."""
    if len(v) <= leaf or not v.shape[1]:
        return np.argsort(labels, kind="stable")
    spread = np.argsort(-v.astype(np.float64).var(0), kind="stable")
    x, y = v[:, spread[0]], v[:, spread[min(1, len(spread) - 1)]]
    slabs = max(1, round((len(v) / leaf) ** 0.5))
    first = np.lexsort((x, labels))
    slab = np.empty(len(v), np.int64)
    slab[first] = np.arange(len(v)) * slabs // len(v)
    return np.lexsort((y, slab, labels))


PACKED = "block long, ids binary, labels binary, vectors binary, low binary, high binary, first_label long, last_label long"


def packed(rows: DataFrame, n_blocks: int, dimensions: int, name: str) -> DataFrame:
    """A written row for each block: ids, labels and vectors in leaf order (16 or 32 bits where they suffice), and the block's box."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = []
        for batch in batches:
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            v = np.zeros((len(at) - 1, dimensions))
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                v[k, : b - a] = flat[a:b]
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), v))
        if not sum(len(ids) for ids, _, _ in held):
            return
        ids, labels, v = (np.concatenate(x) for x in zip(*held, strict=True))
        if np.isinf(v).any():
            raise OverflowError("a component is too large: its 256-fold is no double")
        order = _leaf_order(labels, v)
        ids, labels, v = ids[order], labels[order], v[order]
        largest = np.abs(v).max(initial=0)
        v = v.astype(np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.float64)
        row = [TaskContext.get().partitionId(), ids.tobytes(), labels.tobytes(), v.tobytes(), v.min(0).astype(float).tobytes(), v.max(0).astype(float).tobytes(), int(labels[0]), int(labels[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "ids", "labels", "vectors", "low", "high", "first_label", "last_label"])

    return written(tiled(rows, n_blocks, dimensions).mapInArrow(pack, PACKED), name)


def _matrix(data: bytes, n: int, dimensions: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // max(1, n * dimensions)] if n * dimensions else np.float64
    return np.frombuffer(data, kind).reshape(n, dimensions).astype(np.float64)


def _intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each anchor with each box: sums of the coordinates' intervals."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


class Tree:
    """Leaves and nodes over the rows of a block, which stand in leaf order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.leaves = np.arange(0, len(ids), LEAF)
        self.ends = np.append(self.leaves[1:], len(ids))
        boxes = [f.reduceat(vectors, self.leaves, axis=0) for f in (np.minimum, np.maximum)]
        self.nodes = np.arange(0, len(self.leaves), FANOUT)
        self.leaf_boxes, self.node_boxes = boxes, [f.reduceat(b, self.nodes, axis=0) for f, b in zip((np.minimum, np.maximum), boxes, strict=True)]
        self.first, self.last = np.minimum.reduceat(labels, self.leaves), np.maximum.reduceat(labels, self.leaves)
        self.largest = np.abs(vectors).max(initial=0.0)


class Search:
    """Searches of a block of anchors in a tree."""

    def __init__(self, tree: Tree, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray):
        self.tree, self.ids, self.labels, self.anchors = tree, ids, labels, anchors
        most = max(tree.largest, np.abs(anchors).max(initial=0.0))
        self.wide = most >= 2.0**500 or most * most * max(1, anchors.shape[1]) >= EXACT
        if not self.wide:
            self.leaf, self.node = _intervals(anchors, *tree.leaf_boxes), _intervals(anchors, *tree.node_boxes)

    def scores(self, slot: int, a: int, b: int) -> np.ndarray:
        if not self.wide:
            return self.tree.vectors[a:b] @ self.anchors[slot]
        anchor = [int(x) for x in self.anchors[slot].tolist()]
        return np.array([sum(int(x) * y for x, y in zip(row, anchor, strict=True)) for row in self.tree.vectors[a:b].tolist()], object)

    def run(self, slot: int, k: int, windows: list[tuple[float, float, float]], same: bool) -> list[list[tuple[int, int]]]:
        """For each window (low, high, score to reach) the best k of (-score, id) in its bounds; labels equal the anchor's, or differ."""
        tree, label, own = self.tree, int(self.labels[slot]), int(self.ids[slot])
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        floors = [max(low, known) for low, _, known in windows]
        wanted = (lambda i: tree.first[i] <= label <= tree.last[i]) if same else (lambda i: tree.first[i] != label or tree.last[i] != label)
        if self.wide:
            queue = [(0, True, i) for i in range(len(tree.leaves))]
        else:
            (node_low, node_high), (leaf_low, leaf_high) = ((x[0][slot], x[1][slot]) for x in (self.node, self.leaf))
            useful = lambda low, high: any(f <= high and low <= top for f, (_, top, _) in zip(floors, windows, strict=True))
            queue = [(-high, False, i) for i, (low, high) in enumerate(zip(node_low.tolist(), node_high.tolist(), strict=True)) if useful(low, high)]
            heapq.heapify(queue)
        while queue:
            bound, is_leaf, i = heapq.heappop(queue)
            if not self.wide and -bound < min(floors):
                break
            if not is_leaf:
                for j in range(tree.nodes[i], min(tree.nodes[i] + FANOUT, len(tree.leaves))):
                    if wanted(j) and useful(leaf_low[j], leaf_high[j]):
                        heapq.heappush(queue, (-leaf_high[j], True, j))
                continue
            if not wanted(i):
                continue
            a, b = tree.leaves[i], tree.ends[i]
            scores = self.scores(slot, a, b)
            at = np.flatnonzero(scores >= min(floors))
            if not len(at):
                continue
            at = at[((tree.labels[a + at] == label) == same) & (tree.ids[a + at] != own)]
            found = [(-int(s), int(d)) for s, d in zip(scores[at].tolist(), tree.ids[a + at].tolist(), strict=True)]
            for w, (_, high, _) in enumerate(windows):
                new = [x for x in found if floors[w] <= -x[0] <= high]
                if new:
                    best[w] = sorted(best[w] + new)[:k]
                    if len(best[w]) == k:
                        floors[w] = max(floors[w], -best[w][-1][0])
        return best


def _cells(pairs: DataFrame, tree: DataFrame, n_tree: int) -> DataFrame:
    """Anchor blocks of pairs beside the vectors of their tree block; a tree block travels once, to the task of its number."""
    blocks = tree.select(F.col("block").alias("c"), F.col("ids").alias("tree_ids"), F.col("labels").alias("tree_labels"), F.col("vectors").alias("tree_vectors"))
    n = 3 * n_tree
    return pairs.repartition(n, "c").join(blocks.repartition(n, "c"), "c").drop("c")


def _opened(cell: dict, dimensions: int) -> tuple[Search, np.ndarray]:
    ids, tree_ids = np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["tree_ids"], np.int64)
    tree = Tree(tree_ids, np.frombuffer(cell["tree_labels"], np.int64), _matrix(cell["tree_vectors"], len(tree_ids), dimensions))
    return Search(tree, ids, np.frombuffer(cell["labels"], np.int64), _matrix(cell["vectors"], len(ids), dimensions)), ids


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _checked(score: int) -> int:
    if not -(2**63) <= 100 * score < 2**63:
        raise OverflowError("a score is too large for a long")
    return score


def nearest_of_label(tree: DataFrame, anchors: DataFrame, n_tree: int, dimensions: int, k: int) -> DataFrame:
    """q, slot, rank, positive_id, positive_score: the best k rows of each anchor's label."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cell_rows(batches):
            searches, ids = _opened(cell, dimensions)
            rows = [(cell["q"], slot, d, _checked(-s)) for slot in range(len(ids)) for s, d in searches.run(slot, k, [(*ANY, ANY[0])], same=True)[0]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["q", "slot", "positive_id", "positive_score"])

    # Blocks that hold a label, and anchor blocks that ask for it.
    decoded = lambda df, n: df.mapInArrow(_labels_of, f"{n} long, label long")
    here, asked = decoded(tree.select("block", "labels"), "c"), decoded(anchors.select("block", "labels"), "q")
    pairs = asked.join(here, "label").select("q", "c").distinct()
    sent = pairs.join(anchors.select(F.col("block").alias("q"), "ids", "labels", "vectors"), "q")
    found = _cells(sent, tree, n_tree).mapInArrow(search, "q long, slot long, positive_id long, positive_score long")
    order = Window.partitionBy("q", "slot").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _labels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            known = np.unique(np.frombuffer(labels, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), block)), pa.array(known)], [batch.schema.names[0].replace("block", "c"), "label"])


def hard_negatives(rows: DataFrame, anchors: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, tree_block: int = TREE_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows and anchors have vec_id, label and v (see whole_rows)."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows, anchors = written(rows, "negatives-rows"), written(anchors, "negatives-anchors")
    size, asked = ((r.n, r.d or 0) for r in (df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first() for df in (rows, anchors)))
    dimensions, n_tree, n_anchors = max(1, size[1], asked[1]), -(-size[0] // tree_block) or 1, -(-asked[0] // anchor_block) or 1
    tree, boxed = packed(rows, n_tree, dimensions, "negatives-tree"), packed(anchors, n_anchors, dimensions, "negatives-asked")
    removed(rows, anchors)
    best = written(nearest_of_label(tree, boxed, n_tree, dimensions, positives), "negatives-positives")
    # At most anchor_block times positives of them for an anchor block.
    windows = best.groupBy(F.col("q").alias("block")).agg(F.collect_list(F.struct("slot", "rank", "positive_id", "positive_score")).alias("positives"))
    asking = written(boxed.join(windows, "block").withColumnRenamed("block", "q"), "negatives-windows")
    removed(best, boxed)
    low, high = window
    bounds = lambda score: (-(-low * score // 100), high * score // 100)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For an anchor block and a tree block's box the greatest score that one of the anchors' windows leaves, if any does."""
        for cell in _cell_rows(batches):
            d = np.frombuffer(cell["low"])
            ids, labels = np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["labels"], np.int64)
            vectors = _matrix(cell["vectors"], len(ids), dimensions)
            known = {(x["slot"], x["rank"]): x["known"] for x in cell["known"] or []}
            boxes = [(x["block"], x["first_label"], x["last_label"], np.frombuffer(x["low"]), np.frombuffer(x["high"])) for x in cell["boxes"]]
            least, greatest = _intervals(vectors, np.array([b[3] for b in boxes]), np.array([b[4] for b in boxes]))
            largest = max(np.abs(vectors).max(initial=0.0), max(np.abs(b[3:5]).max() for b in boxes))
            wide = largest * largest * len(d) >= EXACT if largest < 2.0**500 else True
            kept = []
            for i, (block, first, last, *_) in enumerate(boxes):
                promise = -np.inf
                for x in cell["positives"]:
                    a, b = bounds(x["positive_score"])
                    a = max(a, known.get((x["slot"], x["rank"]), a))
                    if a <= b and not first == last == labels[x["slot"]] and (wide or (a <= greatest[x["slot"], i] and least[x["slot"], i] <= b)):
                        promise = max(promise, float(b) if wide else min(float(b), greatest[x["slot"], i]))
                if promise > -np.inf:
                    kept.append((cell["q"], block, promise))
            if kept:
                q, c, promise = zip(*kept, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(promise, pa.float64())], ["q", "c", "promise"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cell_rows(batches):
            searches, ids = _opened(cell, dimensions)
            known = {(x["slot"], x["rank"]): x["known"] for x in cell["known"] or []}
            by_slot: dict[int, list[dict]] = {}
            for x in cell["positives"]:
                by_slot.setdefault(x["slot"], []).append(x)
            out = []
            for slot, wanted in by_slot.items():
                asked_for = [(*bounds(x["positive_score"]), known.get((slot, x["rank"]), ANY[0])) for x in wanted]
                keep = [k for k, (a, b, _) in enumerate(asked_for) if a <= b]
                for k, found in zip(keep, searches.run(slot, negatives, [asked_for[k] for k in keep], same=False) if keep else [], strict=True):
                    x = wanted[k]
                    out += [(cell["q"], slot, x["rank"], int(ids[slot]), x["positive_id"], x["positive_score"], d, _checked(-s)) for s, d in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["q", "slot", "of", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = "q long, slot long, of long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    order = Window.partitionBy("q", "slot", "of").orderBy(F.desc("negative_score"), "negative_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    none = F.lit(None).cast("array<struct<slot:long,rank:long,known:long>>")
    # Boxes of BOXES tree blocks at a time meet each anchor block; vectors of the tree stay where they are.
    boxes = tree.groupBy(F.floor(F.col("block") / BOXES).alias("g")).agg(F.collect_list(F.struct("block", "first_label", "last_label", "low", "high")).alias("boxes"))
    meeting = boxes.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_anchors - 1).cast("long"))))
    paired = lambda df: meeting.join(df, "q").repartition(max(1, n_anchors)).select("q", "low", "ids", "labels", "vectors", "positives", "known", "boxes").mapInArrow(pair, "q long, c long, promise double")
    first = written(paired(asking.withColumn("known", none)).groupBy("q").agg(F.max_by("c", F.struct("promise", "c")).alias("c")), "negatives-first")
    sent = ["q", "ids", "labels", "vectors", "positives", "known"]
    seeds = written(top(_cells(first.join(asking.withColumn("known", none), "q").select("c", *sent), tree, n_tree).mapInArrow(search, found)), "negatives-seeds")
    # The k-th score of a full window.
    beaten = seeds.filter(F.col("rank") == negatives).groupBy("q").agg(F.collect_list(F.struct("slot", F.col("of").alias("rank"), F.col("negative_score").alias("known"))).alias("known"))
    knowing = written(asking.join(beaten, "q", "left"), "negatives-knowing")
    removed(asking)
    rest = paired(knowing).join(first, ["q", "c"], "left_anti").select("q", "c").join(knowing, "q").select("c", *sent)
    others = _cells(rest, tree, n_tree).mapInArrow(search, found)
    return top(seeds.drop("rank").unionByName(others)).select(names)


#: Boxes of tree blocks that travel together.
BOXES = 256


def op13_packed_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_rows(vectors.withColumn("label", shifted))
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


OP13_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)) + 0.0) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT row_number() OVER () AS n, * FROM usable WHERE vec_id % 100 = 0),
scored AS (
  SELECT a.n, a.vec_id AS anchor_id, a.label AS anchor_label, o.vec_id, o.label, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM anchors a JOIN usable o ON o.vec_id <> a.vec_id),
positives AS (
  SELECT n, anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS k
  FROM scored WHERE label = anchor_label),
windowed AS (
  SELECT p.n, p.k, p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.n, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.n = p.n AND s.label <> p.anchor_label
  WHERE p.k <= 5 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM windowed WHERE rank <= 10
"""
