"""Recipe tables: duplicates and their children, gaps in ids, existing recipes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.resolve import text_key

#: Ids of a range that is opened at once.
CHUNK = 1 << 20


def ranked_duplicates(recipes: DataFrame, keys: Sequence[str], recipe_id: str, time: str | None = None) -> DataFrame:
    """A10: the row that stays of each group of equal keys (null is a key): earliest time, nulls last, then smallest id.

    Keys can be whole texts: they travel as SHA-256 values, with the ids alone, which must be unique.
    """
    order = [*([F.col(time).isNull(), F.col(time)] if time else []), F.col(recipe_id)]
    stay = recipes.groupBy(text_key(keys).alias("_key")).agg(F.min(F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)])).alias("_first"))
    return recipes.join(stay.select(F.col(f"_first._{len(order) - 1}").alias(recipe_id)), recipe_id, "left_semi")


def dedup_recipes(recipes: DataFrame, children: dict[str, tuple[DataFrame, str]], *, keys: Sequence[str], recipe_id: str, time: str | None = None) -> dict[str, DataFrame]:
    """Recipes without duplicates, the ids that go, and child tables without rows of them."""
    stay = ranked_duplicates(recipes, keys, recipe_id, time)
    gone = recipes.select(recipe_id).join(stay.select(recipe_id), recipe_id, "left_anti")
    kept = {name: df.join(gone.select(F.col(recipe_id).alias(fk)), fk, "left_anti") for name, (df, fk) in children.items()}
    return {"recipes": stay, "deleted": gone} | kept


def duplicate_summary(recipes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with duplicates, their members, and rows to delete."""
    groups = recipes.groupBy(text_key(keys)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("deletions"))


def missing_ids(spark: SparkSession, df: DataFrame, key: str, start: int, end: int | Column) -> DataFrame:
    """Ids from start to end that a table lacks; end can be a scalar that is found when the query runs."""
    if isinstance(end, int):
        every = spark.range(start, end + 1).withColumnRenamed("id", key)
    else:
        # Ranges of CHUNK ids are dealt out, then opened.
        last = F.coalesce(end, F.lit(start - 1)).cast("long")
        chunks = spark.range(1).select(F.explode(F.when(last >= start, F.sequence(F.lit(0).cast("long"), F.floor((last - start) / CHUNK)))).alias("_chunk"))
        begin = F.lit(start) + F.col("_chunk") * CHUNK
        every = chunks.repartition("_chunk").select(F.explode(F.sequence(begin, F.least(begin + (CHUNK - 1), last))).alias(key))
    return every.join(df.select(key), key, "left_anti")


def match_existing(rows: DataFrame, recipes: DataFrame, site: str, key: str, title: str, recipe_id: str) -> DataFrame:
    """The id of the recipe with the same site and key, else the smallest id with the same title, else null."""
    by_key = recipes.groupBy(F.col(site).alias("_site"), F.col(key).alias("_key")).agg(F.min(recipe_id).alias("_by_key"))
    by_title = recipes.groupBy(F.col(title).alias("_title")).agg(F.min(recipe_id).alias("_by_title"))
    found = rows.join(by_key, (F.col(site) == F.col("_site")) & (F.col(key) == F.col("_key")), "left").join(by_title, F.col(title) == F.col("_title"), "left")
    return found.withColumn("matched_id", F.coalesce("_by_key", "_by_title")).drop("_site", "_key", "_by_key", "_title", "_by_title")
