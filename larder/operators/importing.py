"""Import of recipe CSV rows into relational tables, and what follows from their order."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import first_filled, source_key
from larder.operators.ordinals import ordinals
from larder.operators.recipes import match_existing, missing_ids
from larder.operators.resolve import first_by
from larder.operators.snapshots import snapshot

INGREDIENTS = "array<struct<name:string,quantity:string,unit:string,is_optional:boolean>>"
STEPS = "array<struct<text:string,image:string>>"
# Names under which items give their parts; the first that is filled counts.
NAME = ["name", "ingredient", "rawName", "raw_text"]
QUANTITY = ["quantity", "amount", "amountText", "amount_text"]
OPTIONAL = ["isOptional", "is_optional"]
STEP = ["text", "instruction", "instructionText", "instruction_text", "description"]
IMAGE = ["img", "image", "imageUrl", "step_image_url"]
NEW_CATEGORY = ("UNKNOWN", "미분류", 999)


def list_cell(value: str | None) -> list[Any]:
    """a Python literal of a list or dict; else lines, else parts at |, else at ;;, else one item; blanks and hyphens go."""
    text = (value or "").strip()
    if not text:
        return []
    try:
        parsed = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        parsed = None
    if isinstance(parsed, list | dict):
        return parsed if isinstance(parsed, list) else [parsed]
    separator = next((s for s in ("\n", "|", ";;") if s in text), None)
    parts = text.splitlines() if separator == "\n" else text.split(separator) if separator else [text]
    return [p for p in (x.strip(" \t\r\n-") for x in parts) if p]


def _first(item: dict, names: list[str]) -> Any:
    return next((item[n] for n in names if item.get(n)), None)


def _ingredient(item: Any) -> dict:
    if not isinstance(item, dict):
        return {"name": str(item).strip(), "quantity": None, "unit": None, "is_optional": False}
    quantity = _first(item, QUANTITY)
    unit = item.get("unit")
    return {"name": str(_first(item, NAME) or "").strip(), "quantity": str(quantity).strip() or None if quantity is not None else None, "unit": None if unit is None else str(unit), "is_optional": bool(_first(item, OPTIONAL))}


def _step(item: Any) -> dict:
    if not isinstance(item, dict):
        return {"text": str(item).strip(), "image": None}
    image = _first(item, IMAGE)
    return {"text": str(_first(item, STEP) or "").strip(), "image": None if image is None else str(image)}


def ingredient_items(cell: Column) -> Column:
    """F04, F05. A parser of Python literals has no built-in counterpart."""

    def parse(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in cells:
            yield batch.map(lambda c: [_ingredient(x) for x in list_cell(c)])

    parse.__annotations__ = {"cells": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(parse, INGREDIENTS)(cell)


def step_items(cell: Column) -> Column:
    """F04, F06."""

    def parse(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in cells:
            yield batch.map(lambda c: [_step(x) for x in list_cell(c)])

    parse.__annotations__ = {"cells": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(parse, STEPS)(cell)


def skip_reason(title: str, ingredients: str, steps: str, require_steps: bool = False) -> Column:
    """Why a row is left out, else null."""
    reason = F.when(F.coalesce(F.trim(title), F.lit("")) == "", "empty_title").when(F.size(ingredients) == 0, "empty_ingredients")
    return reason.when(F.lit(require_steps) & (F.size(steps) == 0), "empty_steps")


def parsed_rows(raw: DataFrame) -> DataFrame:
    """Rows of S01 with title, texts, key, and parsed items."""
    field = lambda n: F.try_element_at("fields", F.lit(n))
    rows = raw.withColumns({
        "title": first_filled([field("title")]), "image": first_filled([field("img"), field("thumbnail_url"), field("thumbnailUrl")]),
        "servings": first_filled([field("quantity"), field("servings"), field("servings_text")]), "cook_time": first_filled([field("time"), field("cook_time"), field("cook_time_text")]),
        "difficulty": first_filled([field("difficulty")]), "url": first_filled([field("source_url"), field("sourceUrl"), field("url")]),
        "ingredients": ingredient_items(field("ingredients")), "steps": step_items(field("steps")),
    })
    return rows.withColumn("key", source_key("title", "url", "image")).drop("fields")


def import_recipes(raw: DataFrame, recipes: DataFrame, master: DataFrame, *, site: str, require_steps: bool = False) -> dict[str, DataFrame]:
    """New recipes, ingredients and children of raw rows (path, line_no, fields).

    recipes: recipe_id, source_site, source_recipe_key, title; master: ingredient_id, canonical_name. Rows without a known recipe share one
    new recipe for each title: its attributes come from the first such row, and new ids follow these rows in order of file, then line.
    Children come from the last row of a recipe; new ingredients and the statistics from all accepted rows. Rows without fields, which
    couldn't be read, count as failed and skipped. File and line tell a row.

    Cells are parsed once, into a snapshot that all outputs read. Which row stands for which recipe is a second one, of ids and places alone; attributes and
    children are the rows that it names.
    """
    parsed = parsed_rows(raw.withColumn("_unread", F.col("fields").isNull()))
    reason = F.when(F.col("_unread"), "failed").otherwise(skip_reason("title", "ingredients", "steps", require_steps))
    rows = snapshot(parsed.withColumns({"skip_reason": reason, "_n_ingredients": F.size("ingredients"), "_n_steps": F.size("steps")}), "import-rows")
    accepted = rows.filter("skip_reason is null")
    known = recipes.select("recipe_id", F.col("source_site").alias("site"), F.col("source_recipe_key").alias("key"), "title")
    matched = match_existing(accepted.select("path", "line_no", "title", "key", F.lit(site).alias("site")), known, "site", "key", "title", "recipe_id")
    place = F.struct("path", "line_no")
    first = matched.filter("matched_id is null").groupBy("title").agg(F.min(place).alias("p")).select("title", "p.*")
    top = recipes.agg(F.coalesce(F.max("recipe_id"), F.lit(0))).scalar()
    ids = ordinals(first, ["path", "line_no"], "_n").select("title", "path", "line_no", (top + F.col("_n")).alias("new_id"))
    every = matched.join(ids.select("title", "new_id"), "title", "left")
    last = every.groupBy(F.coalesce("matched_id", "new_id").alias("recipe_id")).agg(F.max(place).alias("p")).select("recipe_id", "p.*")
    children = accepted.select("path", "line_no", "ingredients", "steps").join(snapshot(last, "import-last"), ["path", "line_no"])
    new = accepted.drop("title").join(ids, ["path", "line_no"]).select(F.col("new_id").alias("recipe_id"), F.lit(site).alias("source_site"), F.col("key").alias("source_recipe_key"), "title", F.col("image").alias("thumbnail_url"), F.col("difficulty").alias("difficulty_level"), F.col("servings").alias("servings_text"), F.col("cook_time").alias("cook_time_text"), F.col("url").alias("source_url"), F.lit(True).alias("is_active"))
    item = accepted.select(F.explode("ingredients.name").alias("canonical_name")).filter("canonical_name <> ''").distinct()
    fresh = item.join(master.select("canonical_name"), "canonical_name", "left_anti")
    base = master.agg(F.coalesce(F.max("ingredient_id"), F.lit(0))).scalar()
    fresh = ordinals(fresh.withColumn("_h", F.xxhash64("canonical_name")), ["_h", "canonical_name"], "_n")
    fresh = fresh.select((base + F.col("_n")).alias("ingredient_id"), "canonical_name", F.col("canonical_name").alias("normalized_name"), F.lit(NEW_CATEGORY[0]).alias("category_code"), F.lit("g").alias("standard_unit"), F.lit(True).alias("is_active"))
    names = master.select("ingredient_id", "canonical_name").unionByName(fresh.select("ingredient_id", "canonical_name")).groupBy("canonical_name").agg(F.min("ingredient_id").alias("ingredient_master_id"))
    lines = children.select("recipe_id", F.posexplode("ingredients").alias("at", "i"))
    raw_text = F.when(F.col("i.quantity").isNull(), F.col("i.name")).otherwise(F.concat_ws(" ", "i.name", "i.quantity"))
    lines = lines.select("recipe_id", (F.col("at") + 1).alias("sort_order"), raw_text.alias("raw_text"), F.col("i.name").alias("normalized_name_snapshot"), F.col("i.quantity").alias("amount_text"), "i.unit", "i.is_optional").filter("raw_text <> ''")
    lines = lines.join(names, F.col("normalized_name_snapshot") == F.col("canonical_name"), "left").drop("canonical_name")
    steps = children.select("recipe_id", F.posexplode("steps").alias("at", "s")).filter("s.text <> ''")
    steps = steps.select("recipe_id", (F.col("at") + 1).alias("step_no"), F.col("s.text").alias("instruction_text"), F.col("s.image").alias("step_image_url"))
    count = lambda test: F.count(F.when(test, F.lit(1)))
    stats = rows.agg(
        F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("rows"), count(F.col("skip_reason").isNull()).alias("imported"), count(F.col("skip_reason").isNotNull()).alias("skipped"), count(F.col("_unread")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("skip_reason").isNull(), F.col("_n_ingredients"))), F.lit(0)).alias("ingredients"), F.coalesce(F.sum(F.when(F.col("skip_reason").isNull(), F.col("_n_steps"))), F.lit(0)).alias("steps"),
    )
    rejects = rows.filter("skip_reason is not null").drop("_unread", "_n_ingredients", "_n_steps")
    return {"recipes": recipes.unionByName(new, allowMissingColumns=True), "recipe_ingredient": lines, "recipe_step": steps, "ingredient_master": master.unionByName(fresh, allowMissingColumns=True), "rejects": rejects, "statistics": stats}


def ordinal_map(accepted: DataFrame, recipes: DataFrame, site: str, *, required: bool = False) -> DataFrame:
    """Ordinal (file order, then line order) and the recipe's id by key, then title. Without one the id is null, or, if
    ids are required, the job fails."""
    # Cells are parsed to tell which rows are accepted, and bounds of ranges are sampled before rows are dealt out.
    accepted = snapshot(accepted.select("path", "line_no", "key", "title"), "ordinal-rows")
    rows = ordinals(accepted, ["path", "line_no"]).withColumn("site", F.lit(site))
    known = recipes.select("recipe_id", F.col("source_site").alias("site"), F.col("source_recipe_key").alias("key"), "title")
    found = match_existing(rows, known, "site", "key", "title", "recipe_id")
    absent = F.raise_error(F.concat(F.lit("no recipe for ordinal "), F.col("ordinal").cast("string"), F.lit(", title "), F.col("title")))
    return found.select("ordinal", (F.coalesce("matched_id", absent) if required else F.col("matched_id")).alias("recipe_id"))


def recipe_gaps(spark: SparkSession, recipes: DataFrame, mapping: DataFrame, start: int, end: int) -> DataFrame:
    """Ordinals of a range whose id the table lacks, with the recipe that the CSV row matches, if any."""
    missing = missing_ids(spark, recipes, "recipe_id", start, end).withColumnRenamed("recipe_id", "ordinal")
    found = missing.join(mapping, "ordinal")
    return found.withColumn("state", F.when(F.col("recipe_id").isNotNull(), "matched").otherwise("needs_insert"))


def remap_nutrition(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """INSERT lines (line_no, line, ordinal) with new recipe ids. An ordinal without a recipe fails the job; of lines with one target the
    first stays, others are marked as skipped; lines without an ordinal pass."""
    found = lines.join(mapping, "ordinal", "left")
    text = F.concat(F.lit("no recipe for ordinal "), F.col("ordinal").cast("string"))
    target = F.when(F.col("ordinal").isNotNull() & F.col("recipe_id").isNull(), F.raise_error(text)).otherwise(F.col("recipe_id"))
    found = found.withColumn("target", target)
    keep = first_by(found.filter("target is not null"), ["target"], [F.asc("line_no")]).select(F.col("line_no").alias("_keep"))
    found = found.join(keep, F.col("line_no") == F.col("_keep"), "left")
    state = F.when(F.col("target").isNull(), "passed").when(F.col("_keep").isNull(), "skipped").when(F.col("target") == F.col("ordinal"), "unchanged").otherwise("changed")
    new = F.regexp_replace(F.col("line"), F.lit(r"(?i)(VALUES\s*\(\s*)\d+"), F.concat(F.lit("$1"), F.coalesce(F.col("target").cast("string"), F.lit(""))))
    return found.select("line_no", F.when(F.col("target").isNull(), F.col("line")).otherwise(new).alias("line"), state.alias("state"))
