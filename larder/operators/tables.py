"""Small operations on any table: drifting schemas, fallbacks, changes, membership, order and reports."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import col
from larder.operators.resolve import named

#: Names of a column with the time of a change, the likeliest first; fixed values.
TIMESTAMPS = ["created_at", "created_date", "creation_date", "updated_at", "updated_date", "last_modified", "timestamp", "date_created", "date_updated"]
LAST_ID = 999999
#: Cells that a source counts for each part of a parallel read.
CELLS = 16


def picked(df: DataFrame, candidates: Sequence[str], required: bool = False) -> str | None:
    """The first of the candidates that is a column; where a required one is absent, the error lists the columns there are."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of the columns {list(candidates)}; there are {sorted(df.columns)}")
    return found


def resolved(df: DataFrame, wanted: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Columns under their wanted names, each from the first candidate that is there; absent ones are left out."""
    found = {name: picked(df, names, name in required) for name, names in wanted.items()}
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in found.items() if source is not None])


def key_column(df: DataFrame, table: str) -> str:
    """The id column of a table without a declared key."""
    return picked(df, [f"{table}_id", f"{table.rstrip('s')}_id", "id"], required=True)


def timestamp_column(df: DataFrame) -> str | None:
    """The column that tells when a row came to be, if any."""
    return picked(df, TIMESTAMPS)


def for_target(df: DataFrame, target: DataFrame) -> DataFrame:
    """The columns of df that the target has, in the target's order; others aren't written."""
    return df.select(*[F.col(f"`{c}`") for c in target.columns if c in df.columns])


def active(c: str | Column) -> Column:
    """An unknown state counts as active."""
    return F.coalesce(col(c), F.lit(True))


def or_else(c: str | Column, other: str | Column) -> Column:
    """The other value where the first is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), col(other))


def changed(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows whose new value differs; two nulls don't."""
    return df.filter(~F.col(old).eqNullSafe(F.col(new)))


def in_listed_order(df: DataFrame, key: str, listed: DataFrame, place: str) -> DataFrame:
    """Rows whose key is listed, in the list's order; of a key that is listed twice the first place counts."""
    return df.join(listed.groupBy(key).agg(F.min(place).alias(place)), key).orderBy(place)


def members(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """P10: rows whose key is in a table of ids."""
    return df.join(ids.select(F.col(id_column).alias(key)), key, "left_semi")


def enriched(df: DataFrame, key: str, other: DataFrame, other_key: str, columns: Sequence[str]) -> DataFrame:
    """Rows that have a partner, with columns of it."""
    return df.join(other.select(F.col(other_key).alias(key), *columns), key)


def with_default(df: DataFrame, key: str, other: DataFrame, other_key: str, defaults: Mapping[str, object]) -> DataFrame:
    """All rows, with columns of a partner, or their defaults where there is none or it has none."""
    joined = df.join(other.select(F.col(other_key).alias(key), *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def without_children_of(children: DataFrame, foreign_key: str, gone: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent stays."""
    return children.join(gone.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")


def audited(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Key and issue of rows that only one side has (missing: the right lacks it; extra: the left does), or whose values differ."""
    one, two = (df.select(F.col(key), F.col(value).alias(v), F.lit(1).alias(v + "_is")) for df, v in ((left, "_l"), (right, "_r")))
    both = one.join(two, key, "full_outer")
    issue = F.when(F.col("_r_is").isNull(), "missing").when(F.col("_l_is").isNull(), "extra").when(~F.col("_l").eqNullSafe(F.col("_r")), "name")
    return both.select(key, issue.alias("issue")).filter("issue is not null")


def outside_vocabulary(df: DataFrame, name: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """Rows whose name the vocabulary lacks; null is no name of it."""
    return df.join(vocabulary.select(F.col(word).alias(name)).distinct(), name, "left_anti")


def row_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows, and distinct names that are not empty."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.when(F.col(name) != "", F.col(name))).alias("n_names"))


def vocabulary_counts(df: DataFrame, name: str) -> DataFrame:
    """Each name and how often it occurs, in order."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(name)


def preview(df: DataFrame, key: str, old: str, new: Column, limit: int = 50) -> DataFrame:
    """The first changes by key: key, old and new value."""
    return changed(df.select(key, old, new.alias("new_" + old)), old, "new_" + old).orderBy(key).limit(limit)


def sample(df: DataFrame, key: str, columns: Sequence[str], limit: int = 50) -> DataFrame:
    """The first rows by key."""
    return df.select(key, *columns).orderBy(key).limit(limit)


def needy_first(df: DataFrame, key: str, needy: Column) -> DataFrame:
    """Rows that need something first (need 0), then by id; rows without an id last."""
    return df.withColumn("need", F.when(needy, 0).otherwise(1)).orderBy("need", F.coalesce(F.col(key), F.lit(LAST_ID)))


def unpivoted(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct (id, name) for each of several id columns."""
    entries = F.explode(F.array(*[F.col(k) for k in keys])).alias("id")
    return df.select(entries, F.col(name).alias("name")).filter("id is not null").distinct()


def report(metrics: Mapping[str, DataFrame | tuple[DataFrame, str]]) -> DataFrame:
    """A row for each metric: the rows of a table, or (with a column) the distinct values of it."""
    rows = []
    for metric, of in metrics.items():
        df, n = (of, F.count(F.lit(1))) if isinstance(of, DataFrame) else (of[0], F.countDistinct(of[1]))
        rows.append(df.agg(n.alias("n")).select(F.lit(metric).alias("metric"), "n"))
    return reduce(DataFrame.unionByName, rows)


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has, and which."""
    one = left.select(key).join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return one.unionByName(right.select(key).join(left.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def distinct_names(df: DataFrame, name: str) -> DataFrame:
    """Names in order, each once."""
    return named(df, name).select(name).distinct().orderBy(name)


def name_lines(df: DataFrame, name: str) -> DataFrame:
    """A line for each row with a name, to be written as text."""
    return named(df, name).select(F.col(name).alias("value"))


def read_table(spark: SparkSession, url: str, name: str, *, split: str | None = None, parts: int = 8, quote: str = '"', **options: str) -> DataFrame:
    """A table of a database by JDBC, in parallel by ranges of a split column (a number, date or timestamp).

    The source is asked for bounds: it counts its rows in cells of equal width between the least and the greatest value, and cells are put together into parts of about equal
    size, so that values that crowd don't make one large part. Rows without a value have a part of their own.
    """
    reader = lambda query: spark.read.format("jdbc").options(url=url, **options).option("dbtable", query)
    if split is None:
        return reader(name).load()
    column, kind = next((c, kind) for c, kind in reader(name).load().dtypes if c.lower() == split.lower())
    split = f"{quote}{column}{quote}"
    ends = reader(f"(SELECT MIN({split}) AS lo, MAX({split}) AS hi FROM {name}) ends").load().first()
    if ends[0] is None:
        return reader(name).load()
    if kind.startswith(("date", "timestamp")):
        return reader(name).options(partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=parts).load()
    low = math.floor(ends[0])
    width = max(1, -(-(math.floor(ends[1]) + 1 - low) // (parts * CELLS)))
    cell = f"FLOOR(({split} - {low}) / {width})"
    # parts * CELLS rows at most.
    counts = reader(f"(SELECT cell, COUNT(*) AS n FROM (SELECT CAST({cell} AS INTEGER) AS cell FROM {name} WHERE {split} IS NOT NULL) c GROUP BY cell) counts").load().collect()
    cells = sorted((int(r[0]), int(r[1])) for r in counts)
    cuts, held, share = [], 0, sum(n for _, n in cells) / parts
    for k, n in cells[:-1]:
        held += n
        if held >= share * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append(low + (k + 1) * width)
    bounds = [None, *cuts, None]
    tests = [" AND ".join(x for x in (f"{split} >= {a}" if a is not None else "", f"{split} < {b}" if b is not None else "") if x) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return spark.read.jdbc(url, name, predicates=[*(t or f"{split} IS NOT NULL" for t in tests), f"{split} IS NULL"], properties=dict(options))


def write_table(df: DataFrame, url: str, name: str, *, mode: str = "append", **options: str) -> None:
    """Rows into a table of a database by JDBC."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def replace_table(df: DataFrame, url: str, name: str, *, rename: str = "ALTER TABLE {old} RENAME TO {new}", **options: str) -> int:
    """A table's rows replaced as a whole, and how many there are. Tasks, which can run twice, write into a staging table; it takes the table's name in one
    transaction once all are there, so readers see the old rows or the new ones. A failed job leaves the old table. rename is the database's statement."""
    spark, staging = df.sparkSession, f"{name}_staging"
    df.write.format("jdbc").options(url=url, dbtable=staging, **options).mode("overwrite").save()
    n = spark.read.format("jdbc").options(url=url, dbtable=staging, **options).load().count()
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url, *[options[k] for k in ("user", "password") if k in options])
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        known = connection.getMetaData().getTables(None, None, "%", None)
        names = []
        while known.next():
            names.append(known.getString("TABLE_NAME").lower())
        if name.lower() in names:
            statement.executeUpdate(f"DROP TABLE {name}")
        statement.executeUpdate(rename.format(old=staging, new=name))
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
    return n
