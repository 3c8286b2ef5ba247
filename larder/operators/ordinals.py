"""Running numbers over tables and groups of any size, by orders of any type.

Rows are sorted in ranges whose bounds Spark samples, so numbers, texts and several columns serve alike, and a group that holds most rows lies in
many ranges. The sorted rows are written once with their range and place; sizes of ranges, added up, turn places into numbers. Both
steps read the written rows, so they can't differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.snapshots import snapshot


def _ranged(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """df, written, with _range and _at, the place in it: ranges follow each other in the order, and so do places."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranges = {"_range": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}
    return snapshot(dealt.withColumns(ranges).drop("_id"), name)


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Numbers from 1 in each group, nulls being a group: a row's place among those of its group and range, after the group's rows in earlier ranges."""
    ranged = _ranged(df, [*keys, *order], "places")
    parts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    # A group has one row for each range it lies in.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = parts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), "_least", before.alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    joined = ranged.join(told, reduce(Column.__and__, same, F.col("_range") == F.col("_of")))
    return joined.withColumn(name, (F.col("_before") + F.col("_at") - F.col("_least") + 1).cast("int")).select(*df.columns, name)


def ordinals(df: DataFrame, order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """Numbers from 1 in a total order over the whole table."""
    ranged = _ranged(df, order, "ordinals")
    # One row for each range.
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return joined.withColumn(name, F.col("_before") + F.col("_at") + 1).select(*df.columns, name)
