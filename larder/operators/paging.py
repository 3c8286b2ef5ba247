"""Lists of groups of any size as pages: a row holds at most so many entries, whatever the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.ordinals import placed
from larder.operators.resolve import named

PAGE = 1000


def pages(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, size: int = PAGE) -> DataFrame:
    """keys, page (from 0) and an array of at most size values, in a total order. A group's rows are numbered by ranges (see placed), so a
    page is a group of bounded size, and no task holds a whole group."""
    rows = placed(df.select(*keys, *[c for c in order if c not in keys], value.alias("_value")), keys, order, "_place")
    page = F.floor((F.col("_place") - 1) / size).cast("int").alias("page")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_value"))), lambda x: x["_value"])
    return rows.groupBy(*keys, page).agg(listed.alias(name))


def duplicate_pages(df: DataFrame, key: str, name: str, *, limit: int | None = None, size: int = PAGE) -> DataFrame:
    """Names of several rows, their number, and pages of their ids in order. With a limit only the largest groups, then by name: groups
    are counted first, and no ids but theirs are gathered."""
    counts = named(df, name).groupBy(name).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")
    if limit:
        counts = F.broadcast(counts.orderBy(F.desc("row_count"), name).limit(limit))
    rows = df.select(key, name).join(counts, name)
    return pages(rows, [name, "row_count"], [key], F.col(key), "ids", size)
