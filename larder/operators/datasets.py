"""Training-set curation: names without collisions, caps, capacity, splits, coverage, prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.ordinals import ordinals, placed


def collision_safe(df: DataFrame, stem: str, suffix: str, order: Sequence[str]) -> DataFrame:
    """file is stem and suffix; the n-th row of a stem after the first gets _n before the suffix."""
    n = F.col("_place") - 1
    file = F.concat(F.col(stem), F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(F.lit("")), F.lit(suffix))
    return placed(df, [stem], order, "_place").withColumn("file", file).drop("_place")


def over_cap(df: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """Rows beyond the first cap of each key, in order."""
    return placed(df, keys, order, "place").filter(F.col("place") > cap)


def coverage(df: DataFrame, cls: str, split: str, splits: Sequence[str]) -> DataFrame:
    """Rows of each class by split, with zeros, and their total."""
    counts = [F.count(F.when(F.col(split) == s, F.lit(1))).alias(f"n_{s}") for s in splits]
    return df.groupBy(cls).agg(*counts, F.count(F.lit(1)).alias("total"))


def gaps(classes: DataFrame, files: DataFrame, cls: str, split: str, splits: Sequence[str], *, least: int = 1, all_rows: bool = False) -> DataFrame:
    """Classes whose first split has fewer than least rows, needy ones first."""
    table = classes.join(coverage(files, cls, split, splits), cls, "left").fillna(0, [f"n_{s}" for s in splits] + ["total"])
    needy = F.col(f"n_{splits[0]}") < least
    table = table.withColumn("needs", needy)
    return (table if all_rows else table.filter(needy)).orderBy(F.desc("needs"), cls)


def fill_capacity(items: DataFrame, existing: DataFrame, cls: str, order: Sequence[str | Column], splits: Sequence[str], cap: int) -> DataFrame:
    """New items of a class go to the splits in order while these have room; the rest overflows.

    existing has cls and a count n_<split> for each split.
    """
    room = [F.greatest(F.lit(0), F.lit(cap) - F.coalesce(F.col(f"n_{s}"), F.lit(0))) for s in splits]
    target, upto = F.when(F.lit(False), F.lit("")), F.lit(0)
    for s, r in zip(splits, room, strict=True):
        upto = upto + r
        target = target.when(F.col("place") <= upto, s)
    rows = placed(items.join(existing, cls, "left"), [cls], order, "place")
    return rows.withColumn("target", target.otherwise("overflow")).drop(*[f"n_{s}" for s in splits], "place")


def group_split(df: DataFrame, group: str, shares: Mapping[str, float], rest: str, seed: int) -> DataFrame:
    """Whole groups go to one split: int(n * share) groups to each named one in hash order, others to the rest."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"))), 1, 15)
    groups = df.select(group).distinct().withColumn("_h", F.conv(digits, 16, 10).cast("long"))
    n = groups.agg(F.count(F.lit(1))).scalar()
    split, upto = F.when(F.lit(False), F.lit("")), F.lit(0).cast("long")
    for name, share in shares.items():
        upto = upto + F.floor(n * F.lit(share))
        split = split.when(F.col("_k") <= upto, name)
    chosen = ordinals(groups, ["_h", group], "_k").select(group, split.otherwise(rest).alias("split"))
    return df.join(chosen, group)


def longest_prefix(df: DataFrame, key: str, name: str, exact: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The value of the whole name in exact, else of the longest phrase in prefixes that is a prefix of whole words."""
    from larder.functions.text import word_prefixes

    each = df.select(key, name, F.explode(word_prefixes(name)).alias("prefix"))
    best = each.join(prefixes.withColumnsRenamed({"name": "prefix", "value": "_p"}), "prefix").groupBy(key).agg(F.max_by("_p", F.length("prefix")).alias("_p"))
    found = df.join(exact.withColumnsRenamed({"name": name, "value": "_e"}), name, "left").join(best, key, "left")
    return found.withColumn("value", F.coalesce("_e", "_p")).drop("_e", "_p")


def cap_and_merge(existing: DataFrame, uploads: DataFrame, splits: Sequence[str], *, cap: int = 100) -> dict[str, DataFrame]:
    """What a training set loses and gains; both tables have path, split, class and name.

    victims: files beyond the cap of their split and class, by name (W04). merged: uploads of each class, in order of their own split and name,
    with the split that has room (W09; others overflow) and a file name that no file there has (F14).
    """
    victims = over_cap(existing, ["split", "class"], ["name", "path"], cap)
    kept = existing.join(victims.select("path"), "path", "left_anti")
    have = coverage(kept, "class", "split", splits).drop("total")
    rank = F.array_position(F.array(*map(F.lit, splits)), F.col("split"))
    chosen = fill_capacity(uploads.withColumn("_rank", rank), have, "class", ["_rank", F.lower("name"), "path"], splits, cap)
    stem, suffix = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    named = chosen.withColumns({"_base": F.concat(F.lit("team__"), stem), "_suffix": suffix})
    there = kept.select("class", F.col("split").alias("target"), F.col("name").alias("_file"))
    taken = named.select("class", "target", "_base", "_suffix").distinct().join(there, ["class", "target"]).withColumn("_n", F.when(F.col("_file") == F.concat("_base", "_suffix"), 0).otherwise(F.regexp_extract(F.col("_file"), r"_(\d+)(\.[^.]*)?$", 1).try_cast("int")))
    taken = taken.filter(F.col("_file") == F.concat("_base", F.when(F.col("_n") > 0, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(F.lit("")), "_suffix"))
    used = taken.groupBy("class", "target", "_base", "_suffix").agg(F.array_sort(F.collect_set("_n")).alias("_used"))
    rows = placed(named, ["class", "target", "_base", "_suffix"], ["_rank", "path"], "_k").join(used, ["class", "target", "_base", "_suffix"], "left")
    # The k-th number from 0 on that isn't used.
    number = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), F.col("_k") - 1, lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    file = F.concat("_base", F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(F.lit("")), "_suffix")
    merged = rows.withColumn("file", F.when(F.col("target") != "overflow", file)).select("path", "class", "target", "file")
    return {"victims": victims, "merged": merged}
