"""Entity resolution by name: merge maps, rewriting of references, deduplication, reports.

The SQL originals update tables in place; here each function takes DataFrames and returns new ones. Orders are total, so
survivors are determined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(df: DataFrame, name: str) -> DataFrame:
    """Rows with a name that is neither null nor empty."""
    return df.filter(F.col(name).isNotNull() & (F.col(name) != ""))


def merge_map(df: DataFrame, key: str, name: str) -> DataFrame:
    """old_id, keep_id, name with the smallest id of each name. A grouped minimum, so one name may hold most rows."""
    rows = named(df, name)
    keep = rows.groupBy(name).agg(F.min(key).alias("keep_id"))
    return rows.join(keep, name).select(F.col(key).alias("old_id"), "keep_id", name)


def rewrite(df: DataFrame, column: str, mapping: DataFrame, old: str = "old_id", new: str = "keep_id") -> DataFrame:
    """Column becomes the mapped id where there is one; other rows, and null, pass."""
    pairs = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(pairs, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def rewrite_edges(edges: DataFrame, base: str, sub: str, mapping: DataFrame) -> DataFrame:
    """Both ends through one map."""
    return rewrite(rewrite(edges, base, mapping), sub, mapping)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order; null keys form groups."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def text_key(keys: Sequence[str | Column]) -> Column:
    """One short value for columns that may be long texts; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.struct(*[(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(keys)])), 256)


def first_occurrence(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row, by a unique column, of each value of a key that can be a long text; only its hash and the order travel."""
    first = df.groupBy(text_key([key]).alias("_key")).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def dedup_children(df: DataFrame, parent: str, child: str, mapping: DataFrame) -> DataFrame:
    """One row for each parent and kept id; the row that already has the kept id wins, then all columns decide.

    Rows whose child is null or not in the map pass untouched.
    """
    pairs = mapping.select(F.col("old_id").alias("_old"), F.col("keep_id").alias("_new"))
    joined = df.join(pairs, F.col(child) == F.col("_old"), "left").drop("_old")
    order = [F.when(F.col(child) == F.col("_new"), 0).otherwise(1), *[F.asc_nulls_last(c) for c in df.columns]]
    mapped = first_by(joined.filter("_new is not null"), [parent, "_new"], order)
    return mapped.withColumn(child, F.col("_new")).drop("_new").unionByName(joined.filter("_new is null").drop("_new"))


def dedup_edges(edges: DataFrame, base: str, sub: str, context: str | None = None) -> DataFrame:
    """One edge for each pair of ends and context (null is one context)."""
    keys = [base, sub, *([context] if context else [])]
    return first_by(edges, keys, [F.asc_nulls_last(c) for c in edges.columns])


def without_merged(df: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Rows whose id was merged into another go."""
    return df.join(mapping.filter("old_id <> keep_id").select(F.col("old_id").alias(key)), key, "left_anti")


def patch(df: DataFrame, key: str, column: str, patches: DataFrame, value: str) -> DataFrame:
    """Column takes the patch's value where that is not null and differs."""
    new = patches.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = df.join(new, F.col(key) == F.col("_key"), "left")
    changed = F.col("_value").isNotNull() & ~F.col("_value").eqNullSafe(F.col(column))
    return joined.withColumn(column, F.when(changed, F.col("_value")).otherwise(F.col(column))).drop("_key", "_value")


def duplicate_groups(df: DataFrame, key: str, name: str, limit: int | None = None) -> DataFrame:
    """Names of several rows, their number and their ids in order; largest first, then by name. With a limit groups are counted first, and only
    the ids of those that stay are gathered. A group's ids stand in one row: for groups of any size see paging.duplicate_pages."""
    listed = F.array_join(F.sort_array(F.collect_list(key)), ",").alias("ids")
    if not limit:
        return named(df, name).groupBy(name).agg(F.count(F.lit(1)).alias("row_count"), listed).filter("row_count > 1")
    counts = named(df, name).groupBy(name).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1").orderBy(F.desc("row_count"), name).limit(limit)
    return df.select(key, name).join(F.broadcast(counts), name).groupBy(name, "row_count").agg(listed).orderBy(F.desc("row_count"), name)


def conflicts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Ids with several names, as a listing."""
    return df.groupBy(key).agg(F.countDistinct(name).alias("names"), F.array_join(F.sort_array(F.collect_set(name)), " | ").alias("listed")).filter("names > 1")


def checked_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """One name for each id; the job fails if an id has several."""
    one = df.groupBy(key).agg(F.min(name).alias(name), F.countDistinct(name).alias("_n"))
    text = F.concat(F.lit("conflicting names for id "), F.col(key).cast("string"))
    return one.withColumn(name, F.when(F.col("_n") > 1, F.raise_error(text)).otherwise(F.col(name))).drop("_n")


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not there yet are added."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def old_to_new(before: DataFrame, after: DataFrame, key: str, name: str) -> DataFrame:
    """For each id before a merge the smallest surviving id of its name, null where the name is gone."""
    keep = after.groupBy(name).agg(F.min(key).alias("new_id"))
    return before.join(keep, name, "left").select(F.col(key).alias("old_id"), "new_id")


def normalize_and_merge(master: DataFrame, children: dict[str, tuple[DataFrame, str, str]], plain: dict[str, tuple[DataFrame, str]], edges: DataFrame, *, key: str, name: str, base: str, sub: str, context: str | None) -> dict[str, DataFrame]:
    """C02 after the names are normalised: all tables with ingredients of one name merged.

    children: tables to deduplicate, with their parent and ingredient columns; plain: tables that are only rewritten.
    """
    mapping = merge_map(master, key, name)
    out = {"merge_map": mapping, "master": without_merged(master, key, mapping)}
    out |= {k: dedup_children(df, parent, child, mapping) for k, (df, parent, child) in children.items()}
    out |= {k: rewrite(df, column, mapping) for k, (df, column) in plain.items()}
    rewritten = rewrite_edges(edges, base, sub, mapping).filter(F.col(base) != F.col(sub))
    return out | {"edges": dedup_edges(rewritten, base, sub, context)}
