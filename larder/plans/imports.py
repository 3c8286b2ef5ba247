"""Queries of the recipe import; orders and their lines stand for recipe files, and cells are written as the files have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import importing
from larder.operators.snapshots import snapshot, spread
from larder.plans.base import query, table

c = lambda n: F.col(n).cast("string")
quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))


def _cell():
    """A list as a Python literal, a dict, lines, parts at | or ;;, or nothing, by the size of the part."""
    kind = F.col("p_size") % 6
    item = F.concat(F.lit("{'name': "), quoted(F.col("p_name")), F.lit(", 'amount': "), c("p_size"), F.lit(", 'unit': None, 'isOptional': "), F.when(F.col("p_size") > 25, F.lit("True")).otherwise(F.lit("False")), F.lit("}"))
    return (
        F.when(kind == 0, F.concat(F.lit("["), item, F.lit(", "), quoted(F.concat(F.lit(" "), F.col("p_brand"))), F.lit("]")))
        .when(kind == 1, F.concat(F.lit("{'raw_text': "), quoted(F.col("p_type")), F.lit(", 'amount_text': '', 'quantity': ' 3 '}")))
        .when(kind == 2, F.concat(F.lit("- "), F.col("p_name"), F.lit("\n\n-"), F.col("p_brand"), F.lit(" | x")))
        .when(kind == 3, F.concat(F.col("p_name"), F.lit("|"), F.col("p_brand"), F.lit(";;y")))
        .when(kind == 4, F.concat(F.col("p_name"), F.lit(";; "), F.col("p_type"), F.lit(" ;;")))
    )


#: Names, quantities and marks that the cells hold, in order.
ITEMS = """
SELECT p_partkey, p_size % 6 AS kind, CASE p_size % 6
  WHEN 0 THEN [{'name': p_name, 'quantity': CAST(p_size AS VARCHAR), 'opt': p_size > 25}, {'name': p_brand, 'quantity': NULL, 'opt': false}]
  WHEN 1 THEN [{'name': p_type, 'quantity': '3', 'opt': false}]
  WHEN 2 THEN [{'name': p_name, 'quantity': NULL, 'opt': false}, {'name': p_brand || ' | x', 'quantity': NULL, 'opt': false}]
  WHEN 3 THEN [{'name': p_name, 'quantity': NULL, 'opt': false}, {'name': p_brand || ';;y', 'quantity': NULL, 'opt': false}]
  WHEN 4 THEN [{'name': p_name, 'quantity': NULL, 'opt': false}, {'name': p_type, 'quantity': NULL, 'opt': false}]
  ELSE [] END AS items, p_name, p_size FROM part"""


@query("f05", f"SELECT p_partkey, i - 1 AS place, items[i].name AS name, items[i].quantity AS quantity, items[i].opt AS is_optional FROM ({ITEMS}), unnest(range(1, len(items) + 1)) AS t(i)")
def f05(spark, d):
    cells = table(spark, d, "part").select("p_partkey", F.posexplode(importing.ingredient_items(_cell())).alias("place", "i"))
    return cells.select("p_partkey", F.col("place").cast("long").alias("place"), "i.name", "i.quantity", "i.is_optional")


@query("f06", """
SELECT p_partkey, CAST(0 AS BIGINT) AS place, 'cut ' || p_name AS text, CASE WHEN p_size > 20 THEN p_brand || '.png' END AS image FROM part
UNION ALL SELECT p_partkey, 1, p_type, NULL FROM part WHERE p_size % 2 = 0""")
def f06(spark, d):
    first = F.concat(F.when(F.col("p_size") % 3 == 0, "{'instruction_text': '").otherwise("{'text': '', 'description': '"), F.lit("cut "), F.col("p_name"), F.lit("', 'imageUrl': "), F.when(F.col("p_size") > 20, F.concat(F.lit("'"), F.col("p_brand"), F.lit(".png'"))).otherwise("None"), F.lit("}"))
    second = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(", '"), F.col("p_type"), F.lit("'"))).otherwise("")
    cells = table(spark, d, "part").select("p_partkey", F.posexplode(importing.step_items(F.concat(F.lit("["), first, second, F.lit("]")))).alias("place", "s"))
    return cells.select("p_partkey", F.col("place").cast("long").alias("place"), "s.text", "s.image")


@query("f04", f"SELECT p_partkey, len(items) AS n, CASE WHEN len(items) > 0 THEN items[len(items)].name END AS last FROM ({ITEMS})")
def f04(spark, d):
    rows = table(spark, d, "part").withColumn("items", importing.ingredient_items(_cell()))
    return rows.select("p_partkey", F.size("items").cast("long").alias("n"), F.try_element_at("items", F.lit(-1))["name"].alias("last"))


@query("p06", f"""
SELECT p_partkey, CASE WHEN p_size < 5 THEN 'empty_title' WHEN len(items) = 0 THEN 'empty_ingredients' WHEN p_size % 7 = 0 THEN 'empty_steps' END AS reason FROM ({ITEMS})""")
def p06(spark, d):
    rows = table(spark, d, "part").withColumns({
        "title": F.when(F.col("p_size") < 5, F.lit(" ")).otherwise(F.col("p_name")), "ingredients": importing.ingredient_items(_cell()),
        "steps": importing.step_items(F.when(F.col("p_size") % 7 != 0, F.col("p_type"))),
    })
    return rows.select("p_partkey", importing.skip_reason("title", "ingredients", "steps", require_steps=True).alias("reason"))


def _raw(spark, d):
    """Rows of recipe files: a part is a row of the file of its brand; several have one title; some lack ingredients or title."""
    part = spread(table(spark, d, "part"), "p_partkey")
    title = F.when(F.col("p_size") == 1, F.lit(" ")).when(F.col("p_size") < 10, F.concat_ws(" ", "p_name", c("p_size"))).otherwise(F.concat_ws(" ", "p_name", c("p_partkey")))
    amount = F.concat(F.lit("[{'name': "), quoted(F.col("p_name")), F.lit(", 'quantity': '"), c("p_size"), F.lit("g'}, {'name': "), quoted(F.col("p_type")), F.lit("}]"))
    fields = F.create_map(
        F.lit("title"), title, F.lit("img"), F.concat(F.lit("i"), c("p_partkey")), F.lit("source_url"), F.lit(None).cast("string"),
        F.lit("ingredients"), F.when(F.col("p_size") % 9 != 0, amount), F.lit("steps"), F.concat(F.lit("['cook', '"), F.col("p_type"), F.lit("']")),
    )
    return part.select(F.concat(F.col("p_brand"), F.lit(".csv")).alias("path"), F.col("p_partkey").alias("line_no"), F.when(F.col("p_size") != 13, fields).alias("fields"))


#: What the files hold: accepted rows in order, with title, key and what they match among the recipes that are there.
ACCEPTED = """
WITH raw AS (SELECT *, p_brand || '.csv' AS path, CASE WHEN p_size = 1 THEN '' WHEN p_size < 10 THEN p_name || ' ' || p_size ELSE p_name || ' ' || p_partkey END AS title FROM part),
ok AS (SELECT *, substr(sha1(title || '||i' || p_partkey), 1, 32) AS key, row_number() OVER (ORDER BY path, p_partkey) AS ordinal FROM raw WHERE p_size NOT IN (1, 13) AND p_size % 9 <> 0),
old AS (SELECT p_partkey AS recipe_id, key, CASE WHEN p_size < 10 THEN title ELSE 'other' END AS title FROM ok WHERE p_size IN (5, 22)),
m AS (SELECT ok.*, coalesce((SELECT min(recipe_id) FROM old WHERE old.key = ok.key), (SELECT min(recipe_id) FROM old WHERE old.title = ok.title)) AS matched FROM ok),
first AS (SELECT title, min(ordinal) AS pos FROM m WHERE matched IS NULL GROUP BY title),
fresh AS (SELECT title, (SELECT coalesce(max(recipe_id), 0) FROM old) + row_number() OVER (ORDER BY pos) AS new_id FROM first),
every AS (SELECT m.*, coalesce(matched, new_id) AS recipe_id FROM m LEFT JOIN fresh USING (title)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY ordinal DESC) AS k FROM every) WHERE k = 1)
"""


def _known(spark, d):
    rows = importing.parsed_rows(_raw(spark, d).filter("fields is not null")).withColumn("size", F.col("line_no"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), "p_size")
    old = rows.join(part, "line_no").filter("p_size in (5, 22)")
    title = F.when(F.col("p_size") < 10, F.col("title")).otherwise("other")
    return old.select(F.col("line_no").alias("recipe_id"), F.lit("site").alias("source_site"), F.col("key").alias("source_recipe_key"), title.alias("title"))


def _imported(spark, d):
    master = table(spark, d, "part").groupBy(F.col("p_type").alias("canonical_name")).agg(F.min("p_partkey").alias("ingredient_id"))
    return importing.import_recipes(_raw(spark, d), _known(spark, d), master, site="site")


@query("c01", f"""{ACCEPTED}
SELECT 'recipe' AS part, recipe_id, CAST(0 AS BIGINT) AS place, title AS value FROM old UNION ALL SELECT 'recipe', new_id, 0, title FROM fresh
UNION ALL SELECT 'line', recipe_id, 1, p_name || ' ' || p_size || 'g' FROM last UNION ALL SELECT 'line', recipe_id, 2, p_type FROM last
UNION ALL SELECT 'step', recipe_id, 1, 'cook' FROM last UNION ALL SELECT 'step', recipe_id, 2, p_type FROM last""")
def c01(spark, d):
    out = _imported(spark, d)
    rows = lambda name, kind, place, value: out[name].select(F.lit(kind).alias("part"), "recipe_id", place.cast("long").alias("place"), F.col(value).alias("value"))
    lines = rows("recipe_ingredient", "line", F.col("sort_order"), "raw_text")
    return rows("recipes", "recipe", F.lit(0), "title").unionByName(lines).unionByName(rows("recipe_step", "step", F.col("step_no"), "instruction_text"))


@query("c01_ingredients", f"{ACCEPTED} SELECT p_name AS canonical_name, true AS is_new FROM ok GROUP BY p_name UNION SELECT p_type, false FROM part")
def c01_ingredients(spark, d):
    return _imported(spark, d)["ingredient_master"].select("canonical_name", F.coalesce(F.col("category_code") == "UNKNOWN", F.lit(False)).alias("is_new"))


@query("a09", f"""{ACCEPTED}
SELECT count(DISTINCT path) AS files, count(*) AS rows, (SELECT count(*) FROM ok) AS imported, count(*) - (SELECT count(*) FROM ok) AS skipped, count(*) FILTER (WHERE p_size = 13) AS failed,
  2 * (SELECT count(*) FROM ok) AS ingredients, 2 * (SELECT count(*) FROM ok) AS steps FROM raw""")
def a09(spark, d):
    return _imported(spark, d)["statistics"]


def _accepted(spark, d):
    rows = importing.parsed_rows(_raw(spark, d).filter("fields is not null"))
    return rows.filter(importing.skip_reason("title", "ingredients", "steps", True).isNull())


@query("j14", f"{ACCEPTED} SELECT ordinal, matched AS recipe_id FROM m")
def j14(spark, d):
    return importing.ordinal_map(_accepted(spark, d), _known(spark, d), "site")


@query("c06", f"""{ACCEPTED}
SELECT ordinal, matched AS recipe_id, CASE WHEN matched IS NULL THEN 'needs_insert' ELSE 'matched' END AS state FROM m WHERE ordinal BETWEEN 5 AND 1000000 AND ordinal NOT IN (SELECT recipe_id FROM old)""")
def c06(spark, d):
    known = _known(spark, d)
    return importing.recipe_gaps(spark, known, importing.ordinal_map(_accepted(spark, d), known, "site"), 5, 1_000_000)


@query("c07", f"""{ACCEPTED},
lines AS (SELECT o_orderkey AS line_no, CASE WHEN o_orderstatus <> 'P' THEN m.ordinal END AS ordinal, m.recipe_id FROM orders
  JOIN (SELECT row_number() OVER (ORDER BY ordinal) - 1 AS k, ordinal, matched AS recipe_id FROM m WHERE matched IS NOT NULL) m ON o_custkey = k),
placed AS (SELECT *, row_number() OVER (PARTITION BY recipe_id, ordinal IS NULL ORDER BY line_no) AS k FROM lines)
SELECT line_no, CASE WHEN ordinal IS NULL THEN 'x' ELSE 'INSERT INTO recipe_nutrition VALUES (' || recipe_id || ', 1);' END AS line,
  CASE WHEN ordinal IS NULL THEN 'passed' WHEN k > 1 THEN 'skipped' WHEN ordinal = recipe_id THEN 'unchanged' ELSE 'changed' END AS state FROM placed""")
def c07(spark, d):
    from larder.operators.ordinals import ordinals
    from larder.sources.files import insert_ids

    mapping = snapshot(importing.ordinal_map(_accepted(spark, d), _known(spark, d), "site"), "ordinal-map")
    numbered = ordinals(mapping.filter("recipe_id is not null"), ["ordinal"], "k").select((F.col("k") - 1).alias("o_custkey"), "ordinal")
    orders = table(spark, d, "orders").join(numbered, "o_custkey")
    line = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("INSERT INTO recipe_nutrition VALUES ("), c("ordinal"), F.lit(", 1);"))).otherwise("x")
    lines = insert_ids(orders.select(F.col("o_orderkey").alias("line_no"), line.alias("line")), "line", "recipe_nutrition")
    return importing.remap_nutrition(lines, mapping)


@query("p04", """
SELECT p_partkey, p_size % 6 < 4 AND p_size % 5 <> 0 AS approved FROM part""")
def p04(spark, d):
    flags = F.array(*[F.lit(x) for x in (" y", "Yes", "TRUE ", "승인", "no", None)])
    suggestion = F.when(F.col("p_size") % 5 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.approved(F.element_at(flags, (F.col("p_size") % 6 + 1).cast("int")), suggestion).alias("approved"))
