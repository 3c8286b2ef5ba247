"""Operator 8: exact top-k search by columnar branch-and-bound.

Vectors become integers, floor(64 x). Candidates are packed into blocks in vertical layout, one contiguous column
for each dimension, by length: the first block holds the longest vectors; queries are packed into blocks of rows. The first block alone gives
each query a score to beat, its k-th best there, which travels with the query. Every other pair of a query block and a candidate block is a
cell of bounded size, unless the block's longest vector can't reach the score of any query: such pairs are dropped by two numbers, before vectors move. In a cell, a query visits the dimensions in blocks, those with its largest components first: partial
inner products are summed block by block, and by Cauchy and Schwarz what is left is at most the product of the
rests' lengths. Candidates whose partial score plus that bound can't reach the k-th best score known so far are
dropped, and the survivors are compacted before the next block. The best k of all cells are merged by query.

Defined cases: vectors that are null or hold null or non-finite components take no part, and neither do null ids;
shorter vectors count as padded with zeros; ties go to the smaller id; a query's
own rows (of its id) are no candidates; there is one search for each query id and vector, so a query row that stands twice has one list, and two vectors of one query
id have a list each; candidate rows that stand twice both count; empty tables give no rows. Where sums can pass 2^53, floating point with its error bound
only rules candidates out, and whole numbers of any size score the rest; a score among the best k that no long holds,
or a component whose 64-fold no double holds, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import removed, written

CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 2048
DIMENSIONS = 8
#: Sums of whole numbers below this are exact in floating point.
EXACT = 2.0**53


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).filter(finite)
    large = lambda v: F.lit(64.0) * v.cast("double")
    # Doubles from 2^53 are whole, and floor() gives a long.
    cut = F.transform(embedding, lambda v: F.when(F.abs(large(v)) < EXACT, F.floor(large(v)).cast("double")).otherwise(large(v)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), cut.alias("v"))


def _pack(rows: DataFrame, n_blocks: int, dimensions: int) -> DataFrame:
    """One row for each block, the longest vectors first: block, the length of its longest, vec_ids and columns as bytes, dimension after dimension; int32 where that holds them, else doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            at = lists.offsets.to_numpy()
            flat, sizes = lists.values.to_numpy(), np.diff(at)
            v = np.zeros((len(ids), dimensions))
            if len(ids) and (sizes == dimensions).all():
                v[:] = flat[at[0] : at[-1]].reshape(-1, dimensions)
            else:
                for k, size in enumerate(sizes):
                    v[k, :size] = flat[at[k] : at[k] + size]
            held.append((ids, v))
        if not sum(len(ids) for ids, _ in held):
            return
        ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
        if np.isinf(v).any():
            raise OverflowError("a component is too large: its 64-fold is no double")
        v = v.astype(np.int32) if np.abs(v).max(initial=0) < 2**31 else v
        largest = np.abs(v).max(initial=0).astype(np.float64)
        # Where a sum could be rounded, a block is never ruled out by its length.
        longest = float("inf") if largest >= 2.0**400 or largest * largest * dimensions >= EXACT else float(np.sqrt((v.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([longest]), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(v.T).tobytes()], pa.binary())], ["block", "longest", "ids", "columns"])

    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    dealt = rows.withColumn("_length", length).repartitionByRange(n_blocks, F.desc("_length"), "vec_id", F.xxhash64("v")).select("vec_id", "v")
    # Written, so that each block keeps its rows.
    return written(dealt.mapInArrow(pack, "block long, longest double, ids binary, columns binary"), "top-k-blocks")


def _columns(data: bytes, dimensions: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * dimensions * n else np.float64).reshape(dimensions, n)


def _exact_top(query: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate ids and scores of the best k, in whole numbers of any size."""
    whole = [int(x) for x in query.tolist()]
    scored = sorted((-sum(a * int(b) for a, b in zip(whole, v, strict=True) if a), i) for i, v in zip(ids.tolist(), columns.T.tolist(), strict=True))[:k]
    if any(not -(2**63) <= -s < 2**63 for s, _ in scored):
        raise OverflowError("a score among the best is too large for a long")
    return np.array([i for _, i in scored], np.int64), np.array([-s for s, _ in scored], np.int64)


def search_cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, candidate ids, scores) of the best k of each query; columns has a row for each dimension.

    known: for each query a score that k candidates are known to reach; lower ones may be left out, and queries without candidates are.
    """
    dimensions, n = columns.shape
    exact = columns.astype(np.float64)
    largest = np.abs(exact).max(initial=0.0)
    wide = largest * largest * dimensions >= EXACT if largest < 2.0**400 else True
    lengths = np.einsum("ij,ij->j", exact, exact) if largest < 2.0**400 else None
    longest = np.sqrt(lengths.max(initial=0.0)) if lengths is not None else float("inf")
    for slot, (query_id, query, least) in enumerate(zip(query_ids.tolist(), queries.astype(np.float64), np.full(len(queries), -np.inf) if known is None else known, strict=True)):
        order = np.argsort(-np.abs(query), kind="stable")
        alive = np.flatnonzero(ids != query_id)
        most = np.abs(query).max(initial=0.0)
        if lengths is None or most >= 2.0**400:  # squares could be no doubles
            yield slot, *_exact_top(query, ids[alive], exact[:, alive], k)
            continue
        rounded = wide or max(most, largest) * most * dimensions >= EXACT
        if not rounded and np.sqrt(query @ query) * longest * (1 + 1e-9) + 1e-6 < least:
            continue
        # Rounding errors: of a score, at most this; of a squared length, at most slack times the whole.
        slack = (dimensions + 16) * 2.0**-51 if rounded else 0.0
        error = slack * np.sqrt(query @ query) * np.sqrt(lengths[alive])
        score, rest = np.zeros(len(alive)), lengths[alive] * (1 + slack)
        for at in range(0, dimensions, DIMENSIONS):
            block = order[at : at + DIMENSIONS]
            part = exact[block] if len(alive) == n else exact[block[:, None], alive]
            score += query[block] @ part
            rest -= np.einsum("ij,ij->j", part, part)
            if len(alive) <= k or at + DIMENSIONS >= dimensions:
                continue
            later = order[at + DIMENSIONS :]
            length = np.sqrt(query[later] @ query[later])
            bound = length * np.sqrt(np.maximum(rest, 0.0)) * (1 + 1e-9) + 1e-6
            # Full scores of the most promising candidates give the score to beat.
            best = np.argpartition(score, len(score) - k)[-k:]
            beat = (score[best] + query[later] @ exact[later[:, None], alive[best]] - error[best]).min()
            keep = score + bound + error >= (beat if rounded else max(beat, least))
            alive, score, rest, error = alive[keep], score[keep], rest[keep], error[keep]
        if rounded:
            if len(alive) > k:
                alive = alive[score + error >= np.partition(score - error, len(score) - k)[-k]]
            yield slot, *_exact_top(query, ids[alive], exact[:, alive], k)
            continue
        top = np.lexsort((ids[alive], -score))[:k]
        top = top[score[top] >= least]
        if len(top):
            yield slot, ids[alive[top]], score[top].astype(np.int64)


BEST = pa.list_(pa.struct([("slot", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))
FOUND = pa.schema([("q", pa.int64()), ("slot", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _found(q: int, query_ids: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    slots, c, s = (np.concatenate(x) for x in zip(*((np.full(len(c), slot), c, s) for slot, c, s in found), strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(c), q), slots, query_ids[slots], c, s)], schema=FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products of each query with rows of other ids."""
    rows, asked = written(_usable(vectors, vec_id, embedding), "top-k-vectors"), written(_usable(queries, vec_id, embedding).dropDuplicates(), "top-k-queries")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    asked_size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    dimensions = max(1, size.d or 0, asked_size.d or 0)
    n_candidates, n_queries = -(-size.n // candidate_block) or 1, -(-asked_size.n // query_block) or 1
    blocks = _pack(rows, n_candidates, dimensions).withColumnRenamed("block", "c")
    two = _pack(asked, n_queries, dimensions).select(F.col("block").alias("q"), F.col("ids").alias("query_ids"), F.col("columns").alias("queries"))

    removed(rows, asked)

    def search(cell: dict, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        ids, query_ids = np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["query_ids"], np.int64)
        asked_rows = _columns(cell["queries"], dimensions, len(query_ids)).T
        return query_ids, asked_rows, list(search_cell(query_ids, asked_rows, ids, _columns(cell["columns"], dimensions, len(ids)), k, known))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the first block has for a block of queries: results, scores to beat, and the least length of a vector that could reach one of them."""
        for cell in (row for batch in batches for row in batch.to_pylist()):
            query_ids, asked_rows, found = search(cell, None)
            known = np.full(len(query_ids), -np.inf)
            for slot, _, scores in found:
                if len(scores) == k:
                    known[slot] = scores[-1]
            lengths = np.sqrt((asked_rows.astype(np.float64) ** 2).sum(1))
            # A score of 0 or less is within reach of any length.
            need = np.where(known > 0, (known - 1e-6) / (1 + 1e-9) / np.maximum(lengths, 1e-300), -np.inf).min(initial=np.inf)
            held = _found(cell["q"], query_ids, found).select(["slot", "query_id", "vec_id", "score"])
            yield pa.RecordBatch.from_arrays([pa.array([cell["q"]]), pa.array([cell["query_ids"]]), pa.array([cell["queries"]]), pa.array([known.tobytes()]), pa.array([float(need)]), pa.array([held.to_pylist()], BEST)], ["q", "query_ids", "queries", "known", "need", "best"])

    first = blocks.agg(F.min("c")).first()[0]
    first = 0 if first is None else first
    seeds = two.withColumn("c", F.lit(first).cast("long")).join(blocks.filter(F.col("c") == first), "c").select("q", "query_ids", "queries", "ids", "columns").repartition(n_queries)
    row = "struct<slot:bigint,query_id:bigint,vec_id:bigint,score:bigint>"
    two = written(seeds.mapInArrow(seed, f"q long, query_ids binary, queries binary, known binary, need double, best array<{row}>"), "top-k-seeds")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long")))
    pairs = blocks.filter(F.col("c") != first).select("c", "longest", every.alias("q")).join(two.select("q", "need"), "q").filter(F.col("longest") >= F.col("need")).select("c", "q")
    cells = pairs.join(two.drop("need", "best"), "q").join(blocks.drop("longest"), "c").select("q", "ids", "columns", "query_ids", "queries", "known")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in (row for batch in batches for row in batch.to_pylist()):
            query_ids, _, found = search(cell, np.frombuffer(cell["known"]))
            yield _found(cell["q"], query_ids, found)

    kind = "q long, slot long, query_id long, vec_id long, score long"
    best = two.select("q", F.explode("best").alias("b")).select("q", "b.*").unionByName(cells.repartition(n_candidates * n_queries).mapInArrow(others, kind))
    order = Window.partitionBy("q", "slot").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


OP8_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS n, * FROM (SELECT DISTINCT * FROM usable WHERE vec_id % 20 = 0)) q JOIN usable c ON c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
