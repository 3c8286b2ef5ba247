"""Vector similarity (F23, F24, J07, C04): merge candidates above a cosine threshold, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import col
from larder.operators.snapshots import snapshot

#: Rows of a block, pivots of a dimension, and blocks whose summaries meet at once.
BLOCK, PIVOTS, GROUP = 2048, 32, 256
#: Blocks of a tile at most, and tiles that a table is cut into before tiles grow.
TILE, TILES = 16, 16
#: Unrelated rows of a bucket of LSH, and rows of a part of a larger bucket.
OCCUPANCY, PART = 8, 1024
#: Rows that are compared with a block at once, pairs of a list (places in its names are short numbers), pairs of which one is a mark, and pairs that a task lists or sorts at once.
STRIP, LIST, MARK, AT_ONCE = 512, 16384, 1024, 1 << 21
#: A similarity of 1 in the numbers of rounded ones.
ONE = 10**4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where lengths differ, a vector is empty or its norm is 0."""
    a, b = col(a), col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def unit(v: str | Column) -> Column:
    """a vector by its norm; a zero norm counts as 1."""
    v = col(v)
    # The norm is bound once; a function of entries would add it up anew for each.
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda norm: F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0)))[0]


def _units(v: np.ndarray) -> np.ndarray:
    """Rows by their norms, as doubles; a zero norm counts as 1."""
    v = v.astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(norm > 0, norm, 1.0)


def _unit_rows(vectors: DataFrame, key: str, vector: str, threshold: float, raw: bool = False) -> DataFrame:
    """id and v, of length 1, of the rows that can be similar to one: vectors of length 0 have the cosine 0, and others hold what is no number. raw: v as it is, floats where the table has floats,
    which are half as wide as entries of length 1."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    entry = "float" if raw and vectors.select(vector).dtypes[0][1] == "array<float>" else "double"
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{entry}>").alias("v")).filter(F.size("v") > 0)
    kind = rows.schema["id"].dataType.simpleString()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(1).values.null_count:
                batch = batch.filter(pa.array([None not in v for v in batch.column(1).to_pylist()], pa.bool_()))
            for part in _by_dimension(batch):
                given = _stacked(part.column(1))
                v = _units(given)
                with np.errstate(all="ignore"):
                    squares = (v * v).sum(1)
                keep = (squares >= 0.5) & (squares <= 1.5)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), _lists((given if raw else v)[keep])], ["id", "v"])

    return rows.mapInArrow(units, f"id {kind}, v array<{entry}>")


def _close(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> pa.RecordBatch | None:
    """Pairs of ids a and b whose unit vectors x and y have a cosine of threshold or more; same: both sides are one block."""
    scores = x @ y.T
    i, j = np.nonzero(scores >= threshold)
    left, right, s = a[i], b[j], scores[i, j]
    keep = left < right if same else left != right
    if not keep.any():
        return None
    low, high = np.minimum(left, right)[keep], np.maximum(left, right)[keep]
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(s[keep])], ["left_id", "right_id", "similarity"])


def _stacked(column: pa.Array) -> np.ndarray:
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].reshape(len(at) - 1, -1)


def _lists(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel())


def _by_dimension(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) of each length of v."""
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    for d in np.unique(sizes):
        yield batch.filter(pa.array(sizes == d))


def packed_blocks(rows: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """A written row for each block of rows of one dimension: ids and vectors as bytes, as wide as the rows have them, and where the block lies on the sphere: its centre, the largest angle to it,
    and the range of its angles to each pivot. Rows fall to their nearest pivot, and the order of pivots and angles is cut into blocks.

    Pivots are rows of the table, as many as asked for each dimension at most, by hashes of their ids.
    """
    kind, entries = (rows.schema[c].dataType.simpleString() for c in ("id", "v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each dimension
    # The hash decides which rows are pivots; a few for each dimension reach the driver.
    chosen = rows.withColumn("_h", F.xxhash64("id", F.lit("pivot"))).withColumn("_k", F.row_number().over(Window.partitionBy(F.size("v")).orderBy("_h", "id"))).filter(F.col("_k") <= pivots)
    held: dict[int, np.ndarray] = {}
    for r in chosen.select("v").collect():
        held.setdefault(len(r["v"]), []).append(r["v"])
    held = {d: _units(np.array(v)) for d, v in held.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes_ = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(sizes_):
                part = batch.filter(pa.array(sizes_ == d))
                cosines = np.clip(_units(_stacked(part.column(1))) @ held[int(d)].T, -1, 1)
                best = cosines.argmax(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(best), d, np.int32)), pa.array(best.astype(np.int32)), pa.array(np.arccos(cosines[np.arange(len(best)), best]))], ["id", "v", "d", "pivot", "angle"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, dims, at = batch.column(0), batch.column(2).to_numpy(), 0
            # Rows come sorted by dimension; a range can hold several.
            for d, n in zip(*np.unique(dims, return_counts=True), strict=True):
                part = batch.slice(at, n)
                parts.setdefault(int(d), []).append((ids.slice(at, n), _stacked(part.column(1))))
                at += n
        for k, (d, held_rows) in enumerate(parts.items()):
            given = np.concatenate([x for _, x in held_rows])
            v, ids = _units(given), pa.concat_arrays([x for x, _ in held_rows])
            middle = v.sum(0)
            norm = np.linalg.norm(middle)
            middle = middle / norm if norm > 1e-9 else v[0]
            radius = float(np.arccos(np.clip(v @ middle, -1, 1)).max())
            angles = np.arccos(np.clip(v @ held[d].T, -1, 1))
            row = [TaskContext.get().partitionId() * 1024 + k, d, len(v), ids.to_pylist(), given.tobytes(), middle.tobytes(), radius, angles.min(0).tobytes(), angles.max(0).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.list_(ids.type), *[None] * 5), strict=True)], ["block", "d", "n", "ids", "vectors", "centre", "radius", "low", "high"])

    total = sum(r["n"] for r in sizes)
    told = rows.mapInArrow(nearest, f"id {kind}, v {entries}, d int, pivot int, angle double")
    dealt = told.repartitionByRange(max(1, -(-total // block)), "d", "pivot", "angle", "id").sortWithinPartitions("d")
    return snapshot(dealt.mapInArrow(pack, f"block long, d int, n int, ids array<{kind}>, vectors binary, centre binary, radius double, low binary, high binary"), "similar-blocks")


def block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """p, q (p <= q) and near: pairs of blocks of one dimension, and whether they can hold a pair of threshold or more.

    On the sphere angles are distances. Two rows of an angle a at most lie in blocks whose centres are no further apart than both radii and a, and for no pivot do
    the ranges of their blocks' angles leave a gap above a. Only these summaries meet, GROUP of them at a time.
    """
    most = float(np.arccos(min(1.0, threshold))) + 1e-7
    keys = blocks.select("block", "d", "centre", "radius", "low", "high").withColumn("g", F.pmod(F.xxhash64("block"), F.lit(1 << 30)))
    n = max(1, -(-blocks.count() // GROUP))  # a row for each block
    groups = keys.groupBy(F.pmod("g", F.lit(n)).alias("g")).agg(F.collect_list(F.struct("block", "d", "centre", "radius", "low", "high")).alias("of"))
    meeting = groups.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    other = groups.select(F.col("g").cast("long").alias("other"), F.col("of").alias("with"))
    cells = meeting.join(other, "other").filter(F.col("g") <= F.col("other")).select((F.col("g") == F.col("other")).alias("same"), "of", "with").repartition(max(1, n * (n + 1) // 2))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = lambda rows, f: np.array([np.frombuffer(r[f]) for r in rows])
        for row in (r for batch in batches for r in batch.to_pylist()):
            for d in {x["d"] for x in row["of"]} & {x["d"] for x in row["with"]}:
                one, two = ([x for x in row[side] if x["d"] == d] for side in ("of", "with"))
                a, b = (np.array([x["block"] for x in rows]) for rows in (one, two))
                apart = np.arccos(np.clip(arrays(one, "centre") @ arrays(two, "centre").T, -1, 1))
                reach = np.array([x["radius"] for x in one])[:, None] + np.array([x["radius"] for x in two]) + most
                near = apart <= reach
                low, high = ([arrays(rows, f) for rows in (one, two)] for f in ("low", "high"))
                for k in range(low[0].shape[1]):
                    near &= (low[0][:, k, None] - high[1][:, k] <= most) & (low[1][:, k] - high[0][:, k, None] <= most)
                i, j = np.nonzero(a[:, None] <= b if row["same"] else np.ones_like(near))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.array(near[i, j])], ["p", "q", "near"])

    return cells.mapInArrow(compare, "p long, q long, near boolean")


def _meeting(vectors: DataFrame, key: str, vector: str, threshold: float, block: int, pivots: int) -> DataFrame:
    """Packed blocks, dealt out and sorted by the cells x, y in which they meet, each with the pairs of blocks that its cell compares."""
    # Written, since sizes, pivots, the sample of the order and the blocks each read the rows.
    rows = snapshot(_unit_rows(vectors, key, vector, threshold, raw=True), "similar-rows")
    blocks = packed_blocks(rows, block, pivots)
    pairs = block_pairs(blocks, threshold).filter("near").select("p", "q")
    cells, n = tiled(pairs, max(1, min(TILE, -(-blocks.count() // TILES))))
    members = cells.withColumn("block", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda x: F.array(x["p"], x["q"]))))))
    held = members.join(blocks.select("block", "d", "ids", "vectors"), "block").select("x", "y", "pairs", "block", "d", "ids", "vectors")
    return held.repartition(n, "x", "y").sortWithinPartitions("x", "y")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[int, tuple[pa.Array, np.ndarray]], list[dict]]]:
    """Ids and unit vectors of the blocks of each cell, and the pairs of blocks that it compares."""
    cell, known, asked = None, {}, []
    for batch in batches:
        for k in range(batch.num_rows):
            x, y, pairs, block, d, ids, vectors = batch.slice(k, 1).columns
            if (now := (x[0].as_py(), y[0].as_py())) != cell:
                if asked:
                    yield known, asked
                cell, known, asked = now, {}, pairs[0].as_py()
            # Copies, so that the batch can go.
            ids, held = ids.flatten(), vectors[0].as_buffer()
            wide = held.size // (len(ids) * d[0].as_py())
            known[block[0].as_py()] = ids.take(pa.array(np.arange(len(ids)))), _units(np.frombuffer(held, f"f{wide}").reshape(len(ids), -1))
    if asked:
        yield known, asked


def similar_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """left_id < right_id with a cosine of threshold or more, exactly. Vectors of other lengths, of norm 0 or without entries are similar to none.

    Vectors are packed once into blocks along pivots; pairs of blocks that the triangle inequality rules out never meet, and each other pair is one product of matrices.
    """
    met = _meeting(vectors, key, vector, threshold, block, pivots)
    kind = met.schema["ids"].dataType.elementType.simpleString()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, asked in _cells(batches):
            known = {b: (ids.to_numpy(zero_copy_only=False), v) for b, (ids, v) in known.items()}
            for pair in asked:
                p, q = pair["p"], pair["q"]
                if (found := _close(*(known[k][i] for i in range(2) for k in (p, q)), threshold, p == q)) is not None:
                    yield found

    return met.mapInArrow(multiply, f"left_id {kind}, right_id {kind}, similarity double")


def _as_lists(found: list[tuple[np.ndarray, ...]], ids: pa.Array, id_of: np.ndarray, names: pa.Array, name_of: np.ndarray, most: int, mark: int) -> pa.RecordBatch:
    """Lists of pairs (rank, and the places of the left and the right row): each of one rank and a range of left ids, with so many pairs at most. ids and names: the different ones in order; id_of
    and name_of: which of them a row has. first and last: the ends of its left ids; marks: one for each mark pairs, any of theirs."""
    rank, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(id_of[a] - rank * len(ids), kind="stable")
    rank, a, b, n = rank[order], a[order], b[order], len(order)
    sizes = lambda starts: np.diff(np.append(starts, n))
    ranks = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
    place = (np.arange(n) - np.repeat(ranks, sizes(ranks))) % most
    starts, marked = np.flatnonzero(place == 0), np.flatnonzero(place % mark == 0)
    marks = a[marked + np.random.default_rng(n).integers(sizes(marked))]
    first, last = a[starts], a[starts + sizes(starts) - 1]
    # Inside a list by names, so that they pack well.
    of = np.repeat(np.arange(len(starts)), sizes(starts))
    order = np.argsort((of * len(names) + name_of[a]) * len(names) + name_of[b], kind="stable")
    a, b = a[order], b[order]
    # The different names of each list, and where in them those of a pair are.
    of = np.tile(of, 2)
    entries, at = np.unique(of * len(names) + name_of[np.concatenate([a, b])], return_inverse=True)
    begin = np.searchsorted(entries, np.arange(len(starts) + 1) * len(names))
    at = (at - begin[of]).astype(np.int16)
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
    told, edges = lambda rows: ids.take(pa.array(id_of[rows])), np.append(starts, n)
    columns = {
        "rank": pa.array(rank[starts].astype(np.int32)), "pairs": pa.array(sizes(starts).astype(np.int32)), "first": told(first), "last": told(last), "marks": lists(np.append(np.searchsorted(marked, starts), len(marked)), told(marks)),
        "lefts": lists(edges, told(a)), "rights": lists(edges, told(b)), "names": lists(begin, names.take(pa.array(entries % len(names)))), "left_at": lists(edges, pa.array(at[:n])), "right_at": lists(edges, pa.array(at[n:])),
    }
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def similar_lists(rows: DataFrame, threshold: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """The pairs of similar_pairs among rows (id, name, v), without those of one name, as lists of one rounded similarity (rank, of ONE), since there can be nearly as many as pairs of rows: lefts
    and rights are ids, left_at and right_at places in the list's names."""
    met = _meeting(rows.select(F.struct("id", "name").alias("row"), "v"), "row", "v", threshold, block, pivots)
    kind, named = (f.dataType.simpleString() for f in met.schema["ids"].dataType.elementType.fields)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, asked in _cells(batches):
            at = dict(zip(known, np.cumsum([0, *(len(ids) for ids, _ in known.values())]), strict=False))
            held = [pa.concat_arrays([ids.field(k) for ids, _ in known.values()]) for k in (0, 1)]
            (ids, id_of), (names, name_of) = (np.unique(x.to_numpy(zero_copy_only=False), return_inverse=True) for x in held)
            told = pa.array(ids, held[0].type), id_of, pa.array(names, held[1].type), name_of
            found, n = [], 0
            for p, q, cut in ((pair["p"], pair["q"], cut) for pair in asked for cut in range(0, len(known[pair["p"]][1]), STRIP)):
                scores = known[p][1][cut : cut + STRIP] @ known[q][1].T
                i, j = np.nonzero(scores >= threshold)
                a, b = i + (at[p] + cut), j + at[q]
                keep = (id_of[a] < id_of[b] if p == q else id_of[a] != id_of[b]) & (name_of[a] != name_of[b])
                a, b, rank = a[keep], b[keep], np.floor(scores[i[keep], j[keep]] * ONE + 0.5).astype(np.int64)
                turned = id_of[a] > id_of[b]
                found.append((rank, np.where(turned, b, a), np.where(turned, a, b)))
                n += len(a)
                if n >= AT_ONCE:
                    yield _as_lists(found, *told, LIST, MARK)
                    found, n = [], 0
            if n:
                yield _as_lists(found, *told, LIST, MARK)

    ids = f"array<{kind}>"
    return met.mapInArrow(multiply, f"rank int, pairs int, first {kind}, last {kind}, marks {ids}, lefts {ids}, rights {ids}, names array<{named}>, left_at array<smallint>, right_at array<smallint>")


def list_parts(lists: DataFrame) -> tuple[DataFrame, int]:
    """rank, low, high and part: which left ids of a similarity belong to which part of the sorted pairs (null: no limit), and the number of parts. Marks stand for the pairs; a part has about
    AT_ONCE at most, but for those of one left id and one similarity."""
    spark, kind = lists.sparkSession, lists.schema["lefts"].dataType.elementType.simpleString()
    total = lists.agg(F.sum("pairs")).first()[0] or 0
    share = min(AT_ONCE, max(LIST, total // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    marks = lists.select("rank", F.col("pairs").alias("of"), F.posexplode("marks").alias("k", "mark")).withColumn("n", F.least(F.lit(MARK), F.col("of") - F.col("k") * MARK))
    cut = F.floor((F.sum("n").over(Window.partitionBy("rank").orderBy("mark")) - 1) / share)
    # ONE rows at most, and one for each share.
    cuts = marks.withColumn("cut", cut).groupBy("rank", "cut").agg(F.sum("n").alias("n"), F.min("mark").alias("low")).orderBy(F.desc("rank"), "cut").collect()
    rows, part, held = [], 0, 0
    for k, c in enumerate(cuts):
        if held and held + c["n"] > share:
            part, held = part + 1, 0
        held += c["n"]
        low = c["low"] if k and cuts[k - 1]["rank"] == c["rank"] else None
        high = cuts[k + 1]["low"] if k + 1 < len(cuts) and cuts[k + 1]["rank"] == c["rank"] else None
        rows.append((c["rank"], low, high, part))
    return spark.createDataFrame(rows, f"rank int, low {kind}, high {kind}, part int").coalesce(1), part + 1


def sorted_pairs(lists: DataFrame) -> DataFrame:
    """left_id, left_name, right_id, right_name and similarity of written lists, the most similar first, then by ids. Lists move and not pairs, which are some times as wide."""
    parts, n = list_parts(lists)
    of = ["lefts", "rights", "left_at", "right_at"]
    # Only similarities of more pairs than a part holds have limits; their lists are cut where they reach over one.
    reached = F.coalesce(F.col("last") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("first") < F.col("high"), F.lit(True))
    inside = lambda x: F.coalesce(x["lefts"] >= F.col("low"), F.lit(True)) & F.coalesce(x["lefts"] < F.col("high"), F.lit(True))
    cut = F.when((F.col("first") < F.col("low")) | (F.col("last") >= F.col("high")), F.filter(F.arrays_zip(*of), inside))
    met = lists.join(F.broadcast(parts), "rank").filter(reached).withColumn("cut", cut)
    dealt = met.select("part", "rank", "names", *[F.coalesce(F.col("cut")[c], F.col(c)).alias(c) for c in of]).repartitionById(n, "part")
    pairs = dealt.select("rank", "names", F.inline(F.arrays_zip(*of)))
    rows = pairs.select("rank", F.col("lefts").alias("left_id"), F.col("names")[F.col("left_at")].alias("left_name"), F.col("rights").alias("right_id"), F.col("names")[F.col("right_at")].alias("right_name"))
    rows = rows.sortWithinPartitions(F.desc("rank"), "left_id", "right_id")
    return rows.select("left_id", "left_name", "right_id", "right_name", (F.col("rank") / float(ONE)).alias("similarity"))


def tiled(pairs: DataFrame, wide: int) -> tuple[DataFrame, int]:
    """x, y and pairs: the pairs (p, q) of blocks by the tiles of wide neighbouring blocks that hold p and q, and the number of cells. A block moves once for
    each cell and not for each pair; a cell holds two tiles at most."""
    tile = lambda block: F.floor(F.shiftright(block, 10) / wide)
    cells = snapshot(pairs.groupBy(tile("p").alias("x"), tile("q").alias("y")).agg(F.collect_list(F.struct("p", "q")).alias("pairs")), "similar-cells")
    return cells, max(1, cells.count())


def lsh_shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a band and number of bands. Bits grow with the table, so that a bucket of unrelated rows holds about OCCUPANCY of them whatever its size; a pair at
    the angle a shares a band of b bits with probability (1 - a / pi) ** b, and there are so many bands that one at the threshold shares one with probability recall."""
    bits = min(62, max(4, int(np.ceil(np.log2(max(1, n) / OCCUPANCY)))))
    shared = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** bits
    return bits, 1 if shared >= 1 else max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-shared))))


def lsh_cells(rows: DataFrame, bits: int, bands: int, seed: int = 7, part: int | None = None) -> DataFrame:
    """band, hash, p, q, own and id: rows that share a band meet in cells of bounded size. A bucket of more than part rows, such as of one common vector, is dealt into
    parts, and each pair of parts is a cell."""
    kind = rows.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(sizes):
                chosen = batch.filter(pa.array(sizes == d))
                plane = planes.setdefault(int(d), np.random.default_rng(seed).normal(size=(int(d), bands * bits)))
                up = (_stacked(chosen.column(1)) @ plane > 0).reshape(chosen.num_rows, bands, bits)
                hashes = (up * weights).sum(2)
                yield pa.RecordBatch.from_arrays([chosen.column(0), pa.array(np.full(chosen.num_rows, d, np.int32)), pa.ListArray.from_arrays(np.arange(0, hashes.size + 1, bands, dtype=np.int32), hashes.ravel())], ["id", "d", "hashes"])

    signed = rows.mapInArrow(sign, f"id {kind}, d int, hashes array<bigint>").select("id", "d", F.posexplode("hashes").alias("band", "hash"))
    bucket = ["band", "hash", "d"]
    sizes = signed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / (part or PART)).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cells = signed.join(sizes, bucket).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cells.select(*bucket, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id")


def lsh_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, *, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """J07 by locality-sensitive hashing, for tables of any size: signs of random projections in bands (see lsh_shape); rows that share a band are compared
    exactly, and only pairs of threshold or more leave a task. A pair at the threshold is found with probability recall, a nearer one rather."""
    rows = snapshot(_unit_rows(vectors, key, vector, threshold), "lsh-rows")
    kind = rows.schema["id"].dataType.simpleString()
    bits, bands = lsh_shape(rows.count(), threshold, recall)
    cell = ["band", "hash", "d", "p", "q"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = lsh_cells(rows, bits, bands, seed).join(rows, "id").repartition(n, *cell).sortWithinPartitions(*cell)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []

        def out() -> Iterator[pa.RecordBatch]:
            own, ids, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            p, q = own == last[3], own == last[4]
            if (found := _close(ids[p], ids[q], v[p], v[q], threshold, last[3] == last[4])) is not None:
                yield found

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in cell], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                now = tuple(keys[a].tolist())
                if now != last and parts:
                    yield from out()
                    parts = []
                last, part_rows = now, batch.slice(a, b - a)
                parts.append((part_rows.column("own").to_numpy(), part_rows.column("id").to_numpy(zero_copy_only=False), _stacked(part_rows.column("v"))))
        if parts:
            yield from out()

    found = cells.select(*cell, "own", "id", "v").mapInArrow(compare, f"left_id {kind}, right_id {kind}, similarity double")
    return found.groupBy("left_id", "right_id").agg(F.max("similarity").alias("similarity"))


def suggest_merges(master: DataFrame, key: str, name: str, vectors: DataFrame, vector: str, *, threshold: float = 0.9, method: str = "exact") -> DataFrame:
    """Candidate pairs with different names, most similar first, with three blank columns for review. method: "exact", or "lsh" for large tables."""
    if method not in ("exact", "lsh"):
        raise ValueError("method must be exact or lsh")
    names = master.select(F.col(key).alias("id"), F.col(name).alias("name"))
    if method == "exact":
        # Names are compared with the vectors, and pairs are written once, as lists, since there can be nearly as many as pairs of rows.
        rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).join(names.filter("name is not null"), "id")
        ordered = sorted_pairs(snapshot(similar_lists(rows, threshold), "merge-lists", compression="zstd"))
    else:
        # Written, since the sort reads its rows twice, and the comparisons would be made twice.
        pairs = snapshot(lsh_pairs(vectors, key, vector, threshold).withColumn("similarity", F.round("similarity", 4)), "merge-pairs")
        side = lambda s: names.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"))
        rows = pairs.join(side("left"), "left_id").join(side("right"), "right_id").filter("left_name <> right_name")
        ordered = rows.select("left_id", "left_name", "right_id", "right_name", "similarity").orderBy(F.desc("similarity"), "left_id", "right_id")
    blank = F.lit("")
    return ordered.withColumns({"suggested_name": blank, "approved": blank, "memo": blank})
