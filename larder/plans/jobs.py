"""Queries of whole jobs; their inputs are derived from the star schema and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import jobs, nutrition, ocr, recognition
from larder.plans.base import SQL, query, table
from larder.plans.rules import T05

EVENT_MEANS = SQL["a06"]


@query("c03", """
WITH s AS (SELECT p_partkey AS id, 'merged ' || p_brand AS name FROM part WHERE p_partkey % 10 = 0 UNION SELECT p_partkey + 1, 'merged ' || p_brand FROM part WHERE p_partkey % 10 = 0),
m AS (SELECT p_partkey, coalesce(s.name, p_name) AS name FROM part LEFT JOIN s ON id = p_partkey), k AS (SELECT p_partkey AS old_id, name, min(p_partkey) OVER (PARTITION BY name) AS keep_id FROM m WHERE name <> '')
SELECT 'master' AS part, old_id AS a, NULL AS b, name AS value FROM k WHERE old_id = keep_id
UNION ALL SELECT 'lines', coalesce(keep_id, l_partkey), l_orderkey, CAST(l_linenumber AS VARCHAR) FROM lineitem LEFT JOIN k ON old_id = l_partkey
UNION ALL SELECT DISTINCT 'edges', coalesce(x.keep_id, l_partkey), coalesce(y.keep_id, l_suppkey), '' FROM lineitem LEFT JOIN k x ON x.old_id = l_partkey LEFT JOIN k y ON y.old_id = l_suppkey""")
def c03(spark, d):
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    key = F.col("p_partkey")
    pairs = part.filter(key % 10 == 0).select(key.cast("string").alias("left_id"), (key + 1).cast("string").alias("right_id"), F.concat(F.lit("merged "), "p_brand").alias("suggested_name"), F.lit(" yes").alias("approved"))
    master = part.select(key.alias("ingredient_id"), F.col("p_name").alias("normalized_name"))
    edges = lines.select(F.col("l_partkey").alias("base_ingredient_id"), F.col("l_suppkey").alias("sub_ingredient_id"))
    out = jobs.apply_approved_pairs(pairs, master, {"lines": (lines, "l_partkey")}, edges)
    rows = lambda name, a, b, value: out[name].select(F.lit(name).alias("part"), F.col(a).alias("a"), b.cast("long").alias("b"), value.cast("string").alias("value"))
    lines_out, edges_out = rows("lines", "l_partkey", F.col("l_orderkey"), F.col("l_linenumber")), rows("edges", "base_ingredient_id", F.col("sub_ingredient_id"), F.lit(""))
    return rows("master", "ingredient_id", F.lit(None), F.col("normalized_name")).unionByName(lines_out).unionByName(edges_out)


@query("c08", f"""
WITH b AS (SELECT meal, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY k) AS ids FROM (
  SELECT *, row_number() OVER (PARTITION BY meal ORDER BY round(score, 9), p_partkey) AS k FROM ({T05})) WHERE k <= 3 GROUP BY meal)
SELECT user_id, month_v, week_v, (SELECT ids FROM b WHERE meal = 'breakfast') AS breakfast, (SELECT ids FROM b WHERE meal = 'dinner') AS dinner FROM ({EVENT_MEANS})""")
def c08(spark, d):
    factors = {"calories": 10.0, "carbs": 2.0, "protein": 1.0, "fat": 0.5, "sugar": 0.25, "sodium": 12.0, "cholesterol": 1.5}
    recipes = table(spark, d, "part").select("p_partkey", *[(F.col("p_size") * x).alias(n) for n, x in factors.items()])
    history = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))
    found = jobs.recommend_meals(history, recipes, nutrition.fixed_targets(spark), user="user_id", date="ts", values=["v"], recipe_id="p_partkey", as_of="2024-01-31")
    return found.select("user_id", "month_v", "week_v", *[F.array_join(F.col("meals")[m], ",").alias(m) for m in ("breakfast", "dinner")])


MIGRATED = """
SELECT l_orderkey AS path, l_linenumber AS line, l_partkey AS class_id, new_id, CASE WHEN new_id IS NULL THEN 'orphan' WHEN new_id = l_partkey THEN 'same' ELSE 'moved' END AS state
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT p_name, min(p_partkey) AS new_id FROM part WHERE p_size > 45 GROUP BY p_name) USING (p_name)"""


def _migrated(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("class_id"))
    return jobs.migrate_classes(part.drop("p_size"), part.filter("p_size > 45").drop("p_size"), files)


@query("c14", MIGRATED)
def c14(spark, d):
    return _migrated(spark, d)["files"]


@query("a14", f"""
SELECT count(*) FILTER (WHERE state = 'moved') AS moved, count(*) FILTER (WHERE state = 'same') AS same, count(*) FILTER (WHERE state = 'orphan') AS orphan,
  count(DISTINCT CASE WHEN state = 'moved' THEN new_id END) AS merged_folders FROM ({MIGRATED})""")
def a14(spark, d):
    return _migrated(spark, d)["statistics"]


@query("c15", """
WITH m AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 7 <> 0), l AS (SELECT p_partkey AS id, CASE WHEN p_size = 3 THEN p_type ELSE p_name END AS name FROM part WHERE p_partkey % 11 <> 0),
a AS (SELECT p_partkey AS id FROM part WHERE p_size < 9), f AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 40)
SELECT id, 'extra_label' AS issue FROM l WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT id, 'missing_label' FROM m WHERE id NOT IN (SELECT id FROM l)
UNION ALL SELECT m.id, 'name_mismatch' FROM m JOIN l USING (id) WHERE m.name IS DISTINCT FROM l.name UNION ALL SELECT id, 'dead_alias' FROM a WHERE id NOT IN (SELECT id FROM m)
UNION ALL SELECT id, 'orphan_folder' FROM f WHERE id NOT IN (SELECT id FROM m)""")
def c15(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_size")
    labels = part.filter("id % 11 <> 0").select("id", F.when(F.col("p_size") == 3, F.col("p_type")).otherwise(F.col("p_name")).alias("name"))
    folders = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("id"))
    return jobs.audit_assets(part.filter("id % 7 <> 0").select("id", F.col("p_name").alias("name")), labels, part.filter("p_size < 9").select("id"), folders)


@query("c20", """
WITH t AS (SELECT string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS titles FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50))
SELECT o_custkey AS user_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS ingredients,
  string_agg(o_orderstatus, ',' ORDER BY o_orderdate DESC, o_orderstatus DESC) AS meals, (SELECT titles FROM t) AS titles FROM orders GROUP BY o_custkey""")
def c20(spark, d):
    orders = table(spark, d, "orders")
    recipes = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    fridge = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name"))
    meals = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("title"))
    found = jobs.report_context(recipes, fridge, meals)
    return found.select("user_id", F.array_join("ingredients", ",").alias("ingredients"), F.array_join("meals", ",").alias("meals"), F.array_join("titles", "|").alias("titles"))


@query("w06", """
SELECT vec_id, round(s[1], 6) AS top1, round(s[1] - s[2], 6) AS margin, (s[1] - s[2] < 0.12 OR s[1] < 0.40) AS uncertain
FROM (SELECT vec_id, list_reverse_sort(CAST(embedding AS DOUBLE[])) AS s FROM embeddings)""")
def w06(spark, d):
    rows = table(spark, d, "embeddings").withColumn("m", recognition.margin(F.transform("embedding", lambda x: x.cast("double"))))
    return rows.select("vec_id", F.round("m.top1", 6).alias("top1"), F.round("m.margin", 6).alias("margin"), "m.uncertain")


@query("t04", """
SELECT vec_id, string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY x DESC, i) AS classes FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings)) WHERE k <= 3 GROUP BY vec_id""")
def t04(spark, d):
    top = recognition.top_classes("embedding", 3)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(top, lambda x: x["class"].cast("string")), ",").alias("classes"))


@query("f44", f"SELECT doc_id, regexp_matches(text, '{'|'.join(ocr.NOISE)}', 'i') AS noise FROM documents")
def f44(spark, d):
    return table(spark, d, "documents").select("doc_id", ocr.is_noise("text").alias("noise"))


@query("a07", """
SELECT doc_id % 50 AS key, CASE WHEN lang IN ('fr', 'es') THEN 'romance' ELSE lang END AS canonical, CAST(sum(n_chars) AS DOUBLE) AS p FROM documents GROUP BY ALL""")
def a07(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("key"), F.create_map("lang", F.col("n_chars").cast("double")).alias("p"))
    mapping = spark.createDataFrame([("fr", "romance"), ("es", "romance")], "label string, canonical string")
    return recognition.merged_labels(rows, "key", "p", mapping)


@query("c12")
def c12(spark, d):
    """Each document's lines as the lines of an image, without boxes."""
    split = F.split("text", "\n")
    docs = ocr.dealt_images(table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), "text"), F.size(split)).select("image_id", F.posexplode(split).alias("line_no", "text"))
    lines = docs.withColumns({"confidence": 1.0 / (1 + F.col("line_no") % 7), "box": F.lit(None).cast("array<array<double>>"), "width": F.lit(300), "height": F.lit(300)})
    return ocr.rank_titles(lines, dealt=True)
