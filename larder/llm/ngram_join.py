"""Operator 4: n-gram Jaccard self-join with signature trees.

1. Each text becomes the sorted set of hashes of its word shingles. Texts with equal sets are one class; only
   classes are joined, so copies cost nothing more.
2. Sets that are similar enough share a hash among the first ``n - ceil(t n) + 1`` of both in any order that is the same
   for all (prefix filter). The order is rare first: shingles that are frequent in any part of the corpus come last, so that
   texts which only share a common passage don't meet. Each class is dealt out by its first hashes. Within such a bucket a signature tree is built: nodes hold the OR of
   the token bitmaps below them, a range of set sizes, and the components they belong to. A dual traversal
   descends only into node pairs whose largest possible overlap can reach the threshold; pairs of leaves that
   are left are candidates, which are checked on the whole sets of their texts. Shingles are 64-bit hashes and equal sets meet by
   128-bit sums of these, so results are exact but for collisions.
3. The first round takes the few smallest hashes of each class, parts large buckets at random, and gives only enough candidates to
   connect what may be linked inside a part, which joins nearly all groups. The second takes all prefix hashes, but only buckets that still
   hold several components, and gives every candidate whose ends lie in different ones. So no link between
   components is lost, and dense groups don't give all their pairs.

Large buckets are split into blocks, and pairs of blocks are dealt out as cells of bounded size; blocks of one
large component aren't paired with each other.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; a text without words, or a
null one, has the empty set, is its own component and is linked with nothing; equal texts are linked; component ids
are the smallest id of the component, nulls left aside (null if all are); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import documents, or_empty, removed, small_batches, written
from larder.llm.components import components

BITS = 1024
BLOCK = 1024
FIRST_HASHES = 3
LEAF, FAN = 8, 4
#: Classes whose texts are asked for are broadcast up to this size, joined by a shuffle beyond.
BROADCAST_BYTES = 8_000_000
#: A shingle is frequent if it is in so many of the texts that hold COUNTED shingles; the order tells this many apart.
OFTEN, COUNTED, FREQUENT = 8, 2_000_000, 65_536
#: Pairs of one cell that are checked in one place; more are dealt out.
CELL_PAIRS = 2048
#: Pairs of nodes or sets whose bitmaps are compared at once.
AT_ONCE = 32_768
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles, A-Z in lower case."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(words) - k + 1
    if m < 1:
        return _mix(np.array([(hashes * _MULTIPLIERS[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))
    total = np.zeros(m, np.uint64)
    for i in range(k):
        total += hashes[i : i + m] * _MULTIPLIERS[i]
    return np.unique(_mix(total))


def frequent_shingles(docs: DataFrame, k: int, *, text: str) -> np.ndarray:
    """The most frequent shingle hashes of the corpus, at most FREQUENT of them, the rarest first.

    Each task counts all its texts, COUNTED shingles at a time, and tells those that are in OFTEN of them or more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def told() -> pa.RecordBatch:
            ordered = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            n = np.diff(np.append(first, len(ordered)))
            return pa.RecordBatch.from_arrays([pa.array(ordered[first][n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], ["hash", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(shingle_set(t, k))
                size += len(held[-1])
                if size >= COUNTED:
                    yield told()
                    held, size = [], 0
        if size:
            yield told()

    found = docs.select(or_empty(text).alias("text")).mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()  # a bounded number of hashes
    return np.array([r.hash for r in reversed(rows)], np.int64).view(np.uint64)


def rare_first(hashes: np.ndarray, frequent: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A set's sorted hashes with the frequent ones last; frequent is sorted, and places has the rank of each."""
    if not len(frequent) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    common = frequent[at] == hashes
    if not common.any():
        return hashes
    return np.concatenate([hashes[~common], hashes[common][np.argsort(places[at[common]])]])


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def index_length(n, num: int, den: int):
    """How many of its smallest hashes the smaller of two similar sets needs to share with the prefix of the larger."""
    return n - F.ceil(2 * num * n / (num + den)) + 1


def _bitmap(hashes: np.ndarray, width: int = BITS) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(hashes % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _parity(hashes: np.ndarray, width: int = BITS) -> bytes:
    """A bit for each place of the width: whether an odd number of the hashes falls there. Hashes that two sets share cancel out, so bits that differ are hashes of one set alone."""
    bits = np.bincount((hashes % np.uint64(width)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def _wide(n: int) -> int:
    """Bits of a set's own bitmap: a power of two, at least twice the size of the set."""
    return max(512, 1 << (2 * n - 1).bit_length()) if n else 512


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """The least number of hashes that one of two sets has alone, from parities in the narrower width: the wider ones are folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def with_sets(docs: DataFrame, k: int, num: int, den: int, *, text: str, doc_id: str) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a 128-bit key of the set, its smallest and its prefix hashes (32 bits), a bitmap with parities of fixed width, and parities of own width."""
    ranked = frequent_shingles(docs, k, text=text)
    order = np.argsort(ranked)
    shared = docs.sparkSession.sparkContext.broadcast((ranked[order], order))  # at most FREQUENT hashes and their ranks

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, places = shared.value
        short = lambda s: (s >> np.uint64(24)).astype(np.uint32).view(np.int32)
        for batch in batches:
            n, low, high, least, prefix, bitmap, wide = [], [], [], [], [], [], []
            for t in batch.column(2).to_pylist():
                s = shingle_set(t, k)
                n.append(len(s))
                low.append(s.sum(dtype=np.uint64).astype(np.int64))
                high.append(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
                least.append(short(s[: min(FIRST_HASHES, prefix_length(len(s), num, den))]))
                prefix.append(short(rare_first(s, frequent, places)[: prefix_length(len(s), num, den)]))
                bitmap.append(_bitmap(s) + _parity(s))
                wide.append(_parity(s, _wide(len(s))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(least, pa.list_(pa.int32())), pa.array(prefix, pa.list_(pa.int32())), pa.array(bitmap, pa.binary()), pa.array(wide, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "low", "high", "least", "prefix", "bitmap", "wide"],
            )

    rows_in = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(or_empty(text)).alias("text_hash"), or_empty(text).alias("text"))
    kind = rows_in.schema["doc_id"].dataType.simpleString()
    return rows_in.mapInArrow(rows, f"doc_id {kind}, text_hash long, n_shingles long, low long, high long, least array<int>, prefix array<int>, bitmap binary, wide binary")


class SignatureTree:
    """Rows in order of component and size, and levels of nodes above them: OR bitmaps, size ranges, component ranges."""

    def __init__(self, cls: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: np.ndarray, index: np.ndarray):
        order = np.lexsort((cls, size, comp))
        self.cls = cls[order]
        bits, self.parity = bits[order, : BITS // 64], bits[order, BITS // 64 :]
        rows = {"bits": bits, "index": index[order], "low": size[order], "high": size[order], "first": comp[order], "last": comp[order]}
        rows["slack"] = rows["low"] - np.bitwise_count(rows["bits"]).sum(1).astype(np.int64)  # tokens that share a bit
        self.levels = [rows]
        for fan in (LEAF, *[FAN] * 12):
            below = self.levels[-1]
            if len(below["low"]) == 1:
                break
            at = np.arange(0, len(below["low"]), fan)
            self.levels.append({
                "bits": np.bitwise_or.reduceat(below["bits"], at), "low": np.minimum.reduceat(below["low"], at), "high": np.maximum.reduceat(below["high"], at),
                "first": np.minimum.reduceat(below["first"], at), "last": np.maximum.reduceat(below["last"], at), "slack": np.maximum.reduceat(below["slack"], at), "index": np.maximum.reduceat(below["index"], at), "fan": fan,
            })


def _possible(a: dict, i: np.ndarray, b: dict, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether node i of a and node j of b can hold a pair in different components that reaches the threshold."""
    keep = (a["first"][i] != a["last"][i]) | (b["first"][j] != b["last"][j]) | (a["first"][i] != b["first"][j])
    keep &= (a["index"][i] | b["index"][j]) > 0
    keep &= (den * a["high"][i] >= num * b["low"][j]) & (den * b["high"][j] >= num * a["low"][i])
    where = np.flatnonzero(keep)
    for part in (where[k : k + AT_ONCE] for k in range(0, len(where), AT_ONCE)):
        x, y = i[part], j[part]
        common = np.bitwise_count(a["bits"][x] & b["bits"][y]).sum(1).astype(np.int64)
        most = np.minimum(common + np.minimum(a["slack"][x], b["slack"][y]), np.minimum(a["high"][x], b["high"][y]))
        # overlap >= num / (num + den) * (sizes)
        keep[part] = (num + den) * most >= num * (a["low"][x] + b["low"][y])
    return keep


def _differing(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that differ between rows i of a and j of b."""
    return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(a[i[k : k + AT_ONCE]] ^ b[j[k : k + AT_ONCE]]).sum(1).astype(np.int64) for k in range(0, len(i), AT_ONCE))])


def dual_traversal(a: SignatureTree, b: SignatureTree, same: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a and in b) of leaf pairs that may reach the threshold; for a tree with itself only i < j."""
    p, q = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        if same:
            keep = i <= j if p or q else i < j
            i, j = i[keep], j[keep]
        keep = _possible(a.levels[p], i, b.levels[q], j, num, den)
        i, j = i[keep], j[keep]
        if (not p and not q) or not len(i):
            return i, j
        if p >= q or same:
            i, j = _children(i, j, a.levels[p]["fan"], len(a.levels[p - 1]["low"]))
            p -= 1
        if q and (q > p or same):
            j, i = _children(j, i, b.levels[q]["fan"], len(b.levels[q - 1]["low"]))
            q -= 1


def _children(i: np.ndarray, j: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    down = (i[:, None] * fan + np.arange(fan)).ravel()
    other = np.repeat(j, fan)
    return down[down < n], other[down < n]


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which pairs, in order, connect what was not connected before."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)], keep[k] = min(x, y), True
    return keep


def _cell(cls: np.ndarray, size: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: np.ndarray, index: np.ndarray, spanning: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one cell: side 0 against itself, or sides 0 and 1 against each other."""
    if (comp[0] == comp).all() or not index.any():
        return cls[:0], cls[:0]
    one = SignatureTree(cls[side == 0], size[side == 0], comp[side == 0], bits[side == 0], index[side == 0])
    two = SignatureTree(cls[side == 1], size[side == 1], comp[side == 1], bits[side == 1], index[side == 1]) if side.any() else one
    i, j = dual_traversal(one, two, two is one, num, den)
    a, b = one.levels[0], two.levels[0]
    # What one set has alone is sizes less twice the overlap, so at most (den - num) / (den + num) of the sizes in a pair that is similar enough.
    apart = _differing(one.parity, two.parity, i, j)
    keep = (num + den) * apart <= (den - num) * (a["low"][i] + b["low"][j])
    i, j, apart = i[keep], j[keep], apart[keep]
    x, y = one.cls[i], two.cls[j]
    smaller = (a["low"][i] < b["low"][j]) | ((a["low"][i] == b["low"][j]) & (x < y))
    keep = np.where(smaller, a["index"][i], b["index"][j]) > 0
    x, y = x[keep], y[keep]
    if spanning and len(x):
        names, places = np.unique(np.concatenate([x, y]), return_inverse=True)
        # The likeliest pairs first, so that what is chosen are links.
        i, j, apart = i[keep], j[keep], apart[keep]
        order = np.lexsort((np.maximum(x, y), np.minimum(x, y), apart / (a["low"][i] + b["low"][j])))
        x, y = x[order], y[order]
        keep = _spanning(places[: len(x)][order], places[len(x) :][order], len(names))
        x, y = x[keep], y[keep]
    return np.minimum(x, y), np.maximum(x, y)


def candidates(cells: DataFrame, *, spanning: bool, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of classes, each with the first of its cells, from rows (bucket, x, y, side, cls, n, comp, bitmap, index); a cell is (bucket, x, y)."""

    def flush(parts: list[pa.Table]) -> pa.RecordBatch | None:
        rows = pa.concat_tables(parts).combine_chunks()
        bucket, x, y, side, cls, n, comp = (rows.column(k).to_numpy() for k in range(7))
        bits = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint64).reshape(len(cls), 2 * BITS // 64)
        index = rows.column(8).to_numpy()
        new = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        runs = [(s, e) for s, e in zip([0, *new], [*new, len(cls)], strict=True) if e - s > 1]
        found = [_cell(cls[s:e], n[s:e], comp[s:e], side[s:e], bits[s:e], index[s:e], spanning, num, den) for s, e in runs]
        if not sum(len(f[0]) for f in found):
            return None
        at = np.repeat([s for s, _ in runs], [len(f[0]) for f in found])
        a, b = (np.concatenate(f) for f in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, bucket[at].astype(np.int64), x[at], y[at])], ["a", "b", "bucket", "x", "y"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            cut = np.flatnonzero((np.diff(key) != 0).any(0))
            first, table = tuple(key[:, 0]), pa.Table.from_batches([batch])
            # Whole cells leave; the last cell of a batch may go on in the next.
            if last is not None and first != last and held:
                if (out := flush(held)) is not None:
                    yield out
                held = []
            if len(cut):
                at = int(cut[-1]) + 1
                if (out := flush([*held, table.slice(0, at)])) is not None:
                    yield out
                held = [table.slice(at)]
            else:
                held.append(table)
            last = tuple(key[:, -1])
        if held and (out := flush(held)) is not None:
            yield out

    dealt = cells.select("bucket", "x", "y", "side", "cls", "n", "comp", "bitmap", "index").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    pairs = dealt.mapInArrow(rows, "a long, b long, bucket long, x long, y long")
    return pairs.groupBy("a", "b").agg(F.min(F.struct("bucket", "x", "y")).alias("cell")).select("a", "b", "cell.*")


def _in_cells(pairs: DataFrame, values: DataFrame, read, decide) -> DataFrame:
    """The pairs (a, b, bucket, x, y) for which decide(value of a, value of b) holds; values has cls, n and value.

    Pairs are dealt out by the first of the cells that found them, which groups of similar texts share, so that a value travels
    once for each cell and not for each pair; cells of many pairs are dealt out further by both texts of the pair, as a grid of parts, so that one text's partners
    are in many tasks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known = None, {}
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                if (key := (row["bucket"], row["x"], row["y"], row["part"])) != cell:
                    cell, known = key, {}
                if row["b"] is None:
                    known[row["a"]] = read(row["n"], row["value"])
                keep.append(row["b"] is not None and decide(known[row["a"]], known[row["b"]]))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "bucket", "x", "y"])

    parts = pairs.groupBy("bucket", "x", "y").agg(F.ceil(F.count(F.lit(1)) / CELL_PAIRS).alias("parts")).filter("parts > 1")
    side = F.ceil(F.sqrt(F.coalesce("parts", F.lit(1))))
    part = F.pmod(F.xxhash64("a"), side) * side + F.pmod(F.xxhash64("b"), side)
    pairs = pairs.join(parts, ["bucket", "x", "y"], "left").withColumn("part", part.cast("long")).drop("parts")
    members = pairs.select("bucket", "x", "y", "part", F.explode(F.array("a", "b")).alias("cls")).distinct().join(values, "cls")
    both = members.withColumnRenamed("cls", "a").withColumn("b", F.lit(None).cast("long")).unionByName(pairs, allowMissingColumns=True)
    dealt = both.select("bucket", "x", "y", "part", "a", "b", "n", "value").repartition("bucket", "x", "y", "part")
    return dealt.sortWithinPartitions("bucket", "x", "y", "part", F.asc_nulls_first("b")).mapInArrow(rows, "a long, b long, bucket long, x long, y long")


def possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that may reach the threshold by the parities of their own width: each bit that differs is a hash of one set alone."""

    def decide(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> bool:
        return (num + den) * _apart(a[1], b[1]) <= (den - num) * (a[0] + b[0])

    values = classes.select("cls", "n", F.col("wide").alias("value"))
    return _in_cells(pairs, values, lambda n, value: (n, np.frombuffer(value, np.uint64)), decide)


def linked(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose texts reach the threshold, checked exactly; texts has cls, n and value, a text of each class."""

    def decide(a: np.ndarray, b: np.ndarray) -> bool:
        u, v = sorted((a, b), key=len)
        at = np.minimum(np.searchsorted(v, u), len(v) - 1)
        common = int(np.count_nonzero(v[at] == u))
        return den * common >= num * (len(u) + len(v) - common)

    return _in_cells(pairs, texts, lambda _, text: shingle_set(text, k), decide).select("a", "b")


def cells_of(rows: DataFrame) -> DataFrame:
    """Deals rows (bucket, cls, n, comp, comp_size, bitmap, index) with their bucket's plan out to cells of pairs of blocks.

    Blocks (c, s) hold part s of a component c above BLOCK classes, or with c = -1 part s of all the others. Blocks of the same
    large component aren't paired.
    """
    large = F.col("comp_size") > BLOCK
    parts = F.ceil(F.col("comp_size") / BLOCK).cast("int")
    own = F.struct(F.when(large, F.col("comp")).otherwise(F.lit(-1)).alias("c"), F.when(large, F.pmod(F.xxhash64("cls"), parts)).otherwise(F.pmod(F.xxhash64("cls"), F.col("rest_parts"))).cast("int").alias("s"))
    numbered = lambda c, n: F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.struct(c.alias("c"), s.cast("int").alias("s")))
    others = F.concat(numbered(F.lit(-1).cast("long"), F.col("rest_parts")), F.flatten(F.transform("large", lambda b: numbered(b["comp"], b["parts"]))))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    rows = rows.filter((F.col("own.c") == -1) | (F.col("own.c") != F.col("other.c")))
    return rows.select("bucket", "cls", "n", "comp", "bitmap", "index", F.xxhash64(F.least("own", "other")).alias("x"), F.xxhash64(F.greatest("own", "other")).alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def parts_of(rows: DataFrame) -> DataFrame:
    """Deals rows of buckets out to cells of one block each, by a hash of bucket and class: blocks of different buckets overlap."""
    block = F.xxhash64(F.pmod(F.xxhash64("bucket", "cls"), F.col("rest_parts")))
    return rows.select("bucket", "cls", "n", "comp", "bitmap", "index", block.alias("x"), block.alias("y"), F.lit(0).alias("side"))


def bucket_plan(rows: DataFrame, *, mixed_only: bool) -> DataFrame:
    """Buckets with several classes (and, if so asked, several components), with the blocks that they need."""
    large = F.col("comp_size") > BLOCK
    part = F.struct("comp", F.ceil(F.col("comp_size") / BLOCK).cast("int").alias("parts"))
    plan = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.max("index").alias("index"), F.min("comp").alias("first"), F.max("comp").alias("last"),
        F.sum(F.when(large, 0).otherwise(1)).alias("rest"), F.array_sort(F.collect_set(F.when(large, part))).alias("large"),
    )
    plan = plan.filter("first <> last" if mixed_only else "rows > 1").filter("index = 1")
    return plan.select("bucket", F.greatest(F.lit(1), F.ceil(F.col("rest") / BLOCK)).cast("int").alias("rest_parts"), "large")


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and representative of each row; texts link at a Jaccard index of num / den or more.

    representative: whether the row's id and text are the first of its component (all rows without words are).
    """
    small_batches(docs.sparkSession)
    done: list[DataFrame] = []  # tables that nothing reads any more once ids are written

    def kept(df: DataFrame, name: str) -> DataFrame:
        done.append(written(df, name))
        return done[-1]

    sets = written(with_sets(docs, k, num, den, text=text, doc_id=doc_id), "jaccard-sets")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")
    grouped = sets.filter("n_shingles > 0").groupBy("low", "high").agg(one, F.first("n_shingles").alias("n"), F.first("least").alias("least"), F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap"), F.first("wide").alias("wide"))
    classes = kept(grouped.select(F.monotonically_increasing_id().alias("cls"), "low", "high", "one.doc_id", "one.text_hash", "n", "least", "prefix", "bitmap", "wide"), "jaccard-classes")

    def texts_for(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        wanted = kept(classes.select("cls", F.col("doc_id").alias("id"), "text_hash").join(wanted, "cls", "left_semi"), "jaccard-wanted")
        rows = docs.select(F.col(doc_id).alias("id2"), or_empty(text).alias("text")).withColumn("text_hash2", F.xxhash64("text"))
        # 24 bytes for each class that is in question; beyond that many the texts are dealt out.
        wanted = F.broadcast(wanted) if 24 * wanted.count() <= BROADCAST_BYTES else wanted
        found = rows.join(wanted, (F.col("text_hash2") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("id2")))
        texts = found.select("cls", F.lit(None).cast("long").alias("n"), F.col("text").alias("value"))
        return kept(texts.dropDuplicates(["cls"]), "jaccard-texts")

    def exact(cells: DataFrame, spanning: bool) -> DataFrame:
        pairs = kept(candidates(cells, spanning=spanning, num=num, den=den), "jaccard-pairs")
        pairs = kept(possible(pairs, classes, num, den), "jaccard-possible")
        return kept(linked(pairs, texts_for(pairs), k, num, den), "jaccard-links")

    def in_buckets(rows: DataFrame, mixed_only: bool) -> DataFrame:
        """A row for each class and hash of prefix whose bucket may hold links, with the bucket's plan."""
        each = rows.select("cls", "n", "comp", "comp_size", F.posexplode("prefix").alias("at", "bucket"))
        indexed = F.lit(1) if not mixed_only else (F.col("at") < index_length(F.col("n"), num, den)).cast("int")
        each = each.withColumn("index", indexed).drop("at")
        plan = kept(bucket_plan(each, mixed_only=mixed_only), "jaccard-buckets")
        # Buckets grow with the corpus, so the join is by a shuffle at every size; skewed ones are split by adaptive execution.
        hits = each.select("bucket", "cls", "index").hint("merge").join(plan, "bucket")
        return hits.join(rows.select("cls", "n", "comp", "comp_size").join(classes.select("cls", "bitmap"), "cls"), "cls")

    alone = classes.select("cls", "n", F.col("cls").alias("comp"), F.lit(1).cast("long").alias("comp_size"), F.col("least").alias("prefix"))
    links = exact(parts_of(in_buckets(alone, False)), spanning=True)

    joined = kept(components(links), "jaccard-components")  # stars
    sizes = joined.groupBy("root").agg(F.count(F.lit(1)).alias("comp_size"))
    known = joined.join(sizes, "root").select(F.col("node").alias("cls"), F.col("root").alias("comp"), "comp_size")
    placed = classes.select("cls", "n", "prefix").join(known, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).withColumn("comp_size", F.coalesce("comp_size", F.lit(1).cast("long")))
    more = exact(cells_of(in_buckets(kept(placed, "jaccard-placed"), True)), spanning=False)

    final = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)).select(F.col("node").alias("cls"), "root")
    ids = classes.join(final, "cls", "left").select("low", "high", "doc_id", "text_hash", F.coalesce("root", "cls").alias("root"))
    ids = written(ids, "jaccard-ids")
    removed(*done)
    smallest = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one"))
    ids = ids.join(smallest, "root").select("low", "high", "component_id", "one")
    rows = sets.filter("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "low", "high").join(ids, ["low", "high"])
    first = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_hash") == F.col("one.text_hash"))
    rows = rows.withColumn("representative", first).drop("low", "high", "one")
    empty = sets.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("representative"))
    return rows.unionByName(empty)


def op4_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return jaccard_components(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reached AS (SELECT doc_id AS node, doc_id AS root FROM sizes UNION SELECT y, root FROM reached JOIN links ON node = x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM sizes JOIN (SELECT node, min(root) AS component_id FROM reached GROUP BY node) ON node = doc_id
"""
