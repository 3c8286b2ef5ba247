"""Nutrition histories and nearest recipes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Targets of a meal whose analysis is missing, defaults of single values, and a portion of rice.
MEALS = {
    "breakfast": {"calories": 500, "carbs": 60, "protein": 20, "fat": 15, "sugar": 10, "sodium": 400, "cholesterol": 30},
    "lunch": {"calories": 600, "carbs": 70, "protein": 30, "fat": 20, "sugar": 10, "sodium": 500, "cholesterol": 40},
    "dinner": {"calories": 500, "carbs": 60, "protein": 30, "fat": 15, "sugar": 10, "sodium": 400, "cholesterol": 30},
}
DEFAULTS = {"calories": 500, "carbs": 60, "protein": 20, "fat": 15, "sugar": 10, "sodium": 400, "cholesterol": 30}
RICE = {"calories": 200, "carbs": 45, "protein": 4, "fat": 0.4, "sugar": 0, "sodium": 0, "cholesterol": 0}
#: Days of the longer and the shorter look back.
DAYS_BACK = (30, 7)
WEIGHTS = {"calories": 1, "carbs": 4, "protein": 4, "fat": 9, "sugar": 4, "sodium": 0.1, "cholesterol": 0.1}


def mean_with_nulls(c: str | Column, where: Column | None = None) -> Column:
    """The sum of what is known by the number of all rows; 0 without rows. Decimal sums don't depend on order."""
    value = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    inside = F.lit(True) if where is None else where
    n = F.count(F.when(inside, F.lit(1)))
    return F.when(n > 0, F.sum(F.when(inside, value)).cast("double") / n).otherwise(F.lit(0.0))


def looks_back(date: str | Column, as_of: str, days: int) -> Column:
    """whether a moment's day is so many days before as_of or later; null moments are unknown."""
    return F.to_date(date) >= F.date_sub(F.lit(as_of).cast("date"), days)


def window_means(history: DataFrame, user: str, date: str, values: Sequence[str], as_of: str) -> DataFrame:
    """Means of 30 and 7 days up to as_of for each user, in one pass; bounds are midnights and inclusive."""
    month, week = (looks_back(date, as_of, n) for n in DAYS_BACK)
    return history.filter(month).groupBy(user).agg(
        *[mean_with_nulls(v).alias(f"month_{v}") for v in values], *[mean_with_nulls(v, week).alias(f"week_{v}") for v in values]
    )


def distance(nutrients: Mapping[str, Column], target: Mapping[str, Column]) -> Column:
    """weighted distance of a recipe from a target less a portion of rice; terms are added in fixed order."""
    term = lambda n: F.abs(F.coalesce(nutrients[n].cast("double"), F.lit(0.0)) - F.greatest(F.lit(0.0), F.coalesce(target[n].cast("double"), F.lit(float(DEFAULTS[n]))) - RICE[n])) * WEIGHTS[n]
    macro = term("calories") + term("carbs") + term("protein") + term("fat")
    return macro + (term("sugar") + term("sodium") + term("cholesterol"))


def fixed_targets(spark) -> DataFrame:
    """one row for each meal."""
    names = list(DEFAULTS)
    return spark.createDataFrame([(meal, *[float(t[n]) for n in names]) for meal, t in MEALS.items()], ", ".join(["meal string", *[f"{n} double" for n in names]]))


def nearest(recipes: DataFrame, targets: DataFrame, recipe_id: str, k: int = 3) -> DataFrame:
    """The k nearest recipes of each meal. targets has a few rows and is broadcast; each task keeps k of each meal first."""
    names = {n: n for n in DEFAULTS}
    wanted = targets.select("meal", *[F.col(n).alias(f"_{n}") for n in names])
    each = F.collect_list(F.struct("meal", *[f"_{n}" for n in names])).alias("meals")
    rows = recipes.withColumn("_meal", F.explode(wanted.agg(each).scalar()))
    scored = rows.select(recipe_id, F.col("_meal.meal").alias("meal"), distance({n: F.col(n) for n in names}, {n: F.col(f"_meal._{n}").cast("double") for n in names}).alias("score"))
    order = Window.partitionBy("meal").orderBy("score", recipe_id)
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def menu_line(title: str) -> Column:
    """the line of a recipe with its nutrients, unknown ones as 0."""
    value = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("string")
    return F.concat(
        F.lit("- "), F.col(title), F.lit(" (칼로리: "), value("calories"), F.lit("kcal, 탄수화물: "), value("carbs"), F.lit("g, 단백질: "), value("protein"), F.lit("g, 지방: "), value("fat"),
        F.lit("g, 당류: "), value("sugar"), F.lit("g, 나트륨: "), value("sodium"), F.lit("mg, 콜레스테롤: "), value("cholesterol"), F.lit("mg)"),
    )


def menu_lines(recipes: DataFrame, title: str, order: str, group: Column | None = None) -> DataFrame:
    """the lines of a group (of bounded size; see menu_pages for others) in order as one text."""
    key, line = F.lit(0) if group is None else group, menu_line(title)
    lines = recipes.groupBy(key.alias("menu")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))).alias("lines"))
    return lines.select("menu", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def menu_pages(recipes: DataFrame, title: str, order: str, group: Column, size: int) -> DataFrame:
    """F19 for groups of any size: menu, page and a text of at most size lines."""
    from larder.operators.paging import pages

    rows = pages(recipes.select(group.alias("menu"), order, menu_line(title).alias("_line")), ["menu"], [order], F.col("_line"), "lines", size)
    return rows.select("menu", "page", F.array_join("lines", "\n").alias("text"))
