"""Operator 11: embedding whitening by MLlib's BlockMatrix.

Components become whole numbers, floor(64 c) + 1,000,000. Rows get an index without gaps; centred rows go by their index into the blocks of a
distributed BlockMatrix. The transpose times the matrix is the scatter of the fit list (each distinct vector once); numpy's eigh takes the
small covariance apart; the matrix times the whitening matrix, one more BlockMatrix, projects every row. Centring is exact before it becomes
floating point: n x - S is a whole number.

Only three things reach the driver: sums for each dimension, the covariance (dimensions squared; MOST_DIMENSIONS bounds them), and, within
MLlib, the keys of blocks, which grow to BLOCK_BYTES as the table grows, so that there are few.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; shorter vectors count as padded with entries of 0;
empty vectors alone, or an empty table, give no rows; null ids stay ids; repeated rows each give their rows and count once in the fit list; components of no
variance (below DEGENERATE of the trace) can't be whitened: whitened is null there and they take no part in identity_error; deviations
that no long holds, and entries of 2^50 / 64 or more, are errors; columns other than id and vector are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import removed, written

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**50
COMPONENTS = 16
MOST_DIMENSIONS = 4096
#: Rows of a block at least, blocks that are enough, and bytes of a block at most; columns of a block at most.
LEAST_ROWS, ENOUGH_BLOCKS, BLOCK_BYTES, BLOCK_COLUMNS = 1024, 100_000, 64 << 20, 256
#: Bytes of blocks that one task of a product takes.
TASK_BYTES = 32 << 20
DEGENERATE = 1e-13


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x, an array of longs, of the rows that take part."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col(embedding).isNotNull()).filter(finite)
    scaled = lambda v: F.lit(float(SCALE)) * v.cast("double")
    entry = lambda v: F.when(F.abs(scaled(v)) < LARGEST, F.floor(scaled(v)).cast("long") + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))
    return rows.select(F.col(vec_id).alias("vec_id"), F.transform(embedding, entry).alias("x"))


def indexed(rows: DataFrame) -> DataFrame:
    """rows, written, with an index from 0 without gaps: places within the writing tasks plus the sizes of the tasks before."""
    held = written(rows.withColumn("_at", F.monotonically_increasing_id()), "whitening-rows")
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # A row for each task that wrote.
    sizes = [(r["task"], r["n"]) for r in held.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()]
    before, bases = 0, []
    for k, n in sizes:
        bases.append((k, before))
        before += n
    base = held.sparkSession.createDataFrame(bases, "_task long, _base long")
    return held.withColumn("_task", task).join(F.broadcast(base), "_task").select(*rows.columns, (F.col("_base") + place).alias("index"))


@dataclass
class Whitening:
    """What is known of the fit list: its size, sums, eigenvalues (falling) and unit eigenvectors (columns), and the blocks' shape."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    components: int = COMPONENTS

    @property
    def matrix(self) -> np.ndarray:
        """Dimensions by components: eigenvectors over the roots of their eigenvalues, zeros for degenerate ones."""
        scale = [1 / np.sqrt(e) if usable else 0.0 for e, usable in zip(self.values, self.usable, strict=True)]
        return self.vectors * np.array(scale)

    @property
    def usable(self) -> list[bool]:
        return [bool(e > DEGENERATE * self.trace) for e in self.values]


def _centred(sums: list[int], n: int) -> Column:
    """n x - S, whole numbers."""
    total = F.array(*[F.lit(s) for s in sums])
    return F.zip_with(F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.greatest(F.lit(0), F.lit(len(sums)) - F.size("x")))), total, lambda a, s: F.lit(n) * a - s)


def _blocks(rows: DataFrame, n_rows: int, dimensions: int) -> BlockMatrix:
    """The BlockMatrix of rows (index, v array<double>); rows that are absent are zeros. A product reads its blocks several times, so they are kept until
    _released(); blocks of a lost executor are made anew from the written rows."""
    columns = min(dimensions, BLOCK_COLUMNS)
    tall = int(min(max(LEAST_ROWS, -(-n_rows // ENOUGH_BLOCKS)), max(1, BLOCK_BYTES // (8 * columns))))
    frame = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(frame, n_rows, dimensions).toBlockMatrix(tall, columns).persist(StorageLevel.MEMORY_AND_DISK)


def _released(a: BlockMatrix) -> None:
    a._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _scatter(a: BlockMatrix) -> np.ndarray:
    """Transpose times the matrix. The long middle dimension is dealt out, so that no task holds more than its share of the blocks."""
    blocks = -(-a.numRows() // a.rowsPerBlock)
    share = max(a._java_matrix_wrapper._sc.defaultParallelism, -(-blocks * a.rowsPerBlock * a.colsPerBlock * 8 // TASK_BYTES))
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, int(min(blocks, share)))
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of rows (vec_id, x, index), and the indexes of one row for each distinct x; None where no row has entries."""
    dimensions = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    # Shorter vectors are padded first, so that equal ones are one.
    padded = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.greatest(F.lit(0), F.lit(dimensions) - F.size("x"))))
    once = written(rows.groupBy(padded.alias("x")).agg(F.min("index").alias("index")), "whitening-fit")
    if not dimensions:
        return None, once
    told = once.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[k]) for k in range(dimensions)]).first()
    n, sums = told[0], list(told[1:])
    # Scatter of (x - S / n): exact whole numbers, one rounding for the quotient.
    unrounded = F.transform(_centred(sums, n), lambda v: v.cast("double") / F.lit(float(n)))
    most = rows.agg(F.max("index")).first()[0] + 1
    a = _blocks(once.select("index", unrounded.alias("v")), most, dimensions)
    covariance = _scatter(a) / n
    _released(a)
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, values[order], vectors[:, order], float(np.trace(covariance)), components), once


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """index and z, the array of whitened components, of each row (x, index), written."""
    dimensions, spark = len(model.sums), rows.sparkSession
    unrounded = F.transform(_centred(model.sums, model.n), lambda v: v.cast("double") / F.lit(float(model.n)))
    most = rows.agg(F.max("index")).first()[0] + 1
    a = _blocks(rows.select("index", unrounded.alias("v")), most, dimensions)
    w, tall = model.matrix, a.colsPerBlock
    parts = [((k, 0), DenseMatrix(*w[at : at + tall].shape, w[at : at + tall].flatten(order="F"))) for k, at in enumerate(range(0, dimensions, tall))]
    z = a.multiply(BlockMatrix(spark.sparkContext.parallelize(parts, 1), tall, w.shape[1], dimensions, w.shape[1]))
    step = a.rowsPerBlock

    def rows_of(block: tuple) -> list[tuple[int, list[float]]]:
        (i, _), part = block
        return [(i * step + k, v) for k, v in enumerate(part.toArray().tolist())]

    # Blocks come as they are: toIndexedRowMatrix() would number rows by 32 bits and shuffle them once more.
    out = written(spark.createDataFrame(z.blocks.flatMap(rows_of), "index long, z array<double>"), "whitening-projected")
    _released(a)
    return out


def identity_error(z: DataFrame, usable: list[bool]) -> float | None:
    """Largest absolute entry of the covariance of z minus the identity; None without usable components or rows."""
    at = [k for k, u in enumerate(usable) if u]
    entry = lambda k: F.col("z")[k]
    told = z.agg(F.count(F.lit(1)), *[F.avg(entry(k)) for k in at]).first()
    if not at or not told[0]:
        return None
    mean = dict(zip(at, told[1:], strict=True))
    pairs = [(i, j) for i in at for j in at if i <= j]
    found = z.agg(*[F.avg((entry(i) - mean[i]) * (entry(j) - mean[j])) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


def deviation(model: Whitening) -> Column:
    """Sum over dimensions of (n x - S)^2 as a long; exact in decimals on the way."""
    big = "decimal(38,0)"
    total = F.aggregate(_centred(model.sums, model.n), F.lit(0).cast(big), lambda s, v: (s + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast(big))
    return F.when(total <= F.lit(2**63 - 1).cast(big), total.cast("long")).otherwise(F.raise_error(F.lit("a deviation is too large for a long")).cast("long"))


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that takes part and each component."""
    spark = vectors.sparkSession
    rows = indexed(whole_vectors(vectors, vec_id, embedding))
    model, once = fit(rows, components)
    if model is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    z = project(rows, model)
    error = identity_error(z.join(once.select("index"), "index", "left_semi"), model.usable)
    removed(once)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values]
    told = F.array(*[
        F.struct(F.lit(k + 1).alias("component"), (F.col("z")[k] if model.usable[k] else F.lit(None).cast("double")).alias("whitened"), F.lit(explained[k]).cast("double").alias("explained"))
        for k in range(len(model.values))
    ])
    out = rows.select("vec_id", "index", deviation(model).alias("deviation")).join(z, "index")
    out = out.select("vec_id", "deviation", F.explode(told).alias("c"))
    return out.select("vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
