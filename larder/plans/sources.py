"""Queries of scans and sinks: files that are derived from the given tables are written, then read by the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.functions.text import class_key
from larder.operators import candidates, tables
from larder.plans.base import derived, query, table
from larder.sources import files, recipe_pages


@query("s01", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest, lang FROM documents")
def s01(spark, d):
    folder = derived(spark, "recipes")
    files.write_csv(table(spark, d, "documents").select("doc_id", "text", "lang"), folder, mark=True)
    rows = files.recipe_csv(spark, folder)
    field = lambda n: F.try_element_at("fields", F.lit(n))
    return rows.select(field("doc_id").alias("doc_id"), F.md5(field("text")).alias("digest"), field("lang").alias("lang"))


@query("s02", """
SELECT CAST(p_partkey AS VARCHAR) AS left_id, p_name AS left_normalized_name, CASE WHEN p_size < 25 THEN p_brand || ', "' || p_type || '"' END AS suggested_name, CASE WHEN p_size % 2 = 0 THEN 'Y' END AS approved FROM part""")
def s02(spark, d):
    folder = derived(spark, "review")
    suggested = F.when(F.col("p_size") < 25, F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')))
    made = {"left_id": F.col("p_partkey"), "left_normalized_name": F.col("p_name"), "suggested_name": suggested, "approved": F.when(F.col("p_size") % 2 == 0, "Y")}
    files.write_csv(table(spark, d, "part").select(*[made.get(c, F.lit("x")).cast("string").alias(c) for c in files.REVIEW]), folder)
    return files.review_pairs(spark, folder).select(*made)


@query("s03", """
SELECT 'ing_' || p_partkey AS label, CASE WHEN p_size % 3 = 0 THEN 'ing_' || p_partkey ELSE p_name END AS display_name, p_type AS normalized_name, p_brand AS category,
  CASE WHEN p_size % 2 = 0 THEN p_partkey END AS ingredient_id FROM part""")
def s03(spark, d):
    part = table(spark, d, "part")
    size = F.col("p_size") % 3
    entry = F.struct(
        F.when(size == 1, F.col("p_name")).alias("displayName"), F.when(size == 2, F.col("p_name")).alias("display_name"), F.col("p_type").alias("normalized_name"), F.col("p_brand").alias("categorySuggestion"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("none").alias("ingredientId"),
    )
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("ing_"), F.col("p_partkey").cast("string")), entry)))
    folder = derived(spark, "labels")
    part.groupBy("p_brand").agg(F.to_json(F.struct(entries.alias("labels"))).alias("value")).write.partitionBy("p_brand").text(folder)
    return files.label_map(spark, folder).drop("place")


@query("s04", """
SELECT CAST(k - 1 AS INTEGER) AS place, p_name AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS k FROM (SELECT DISTINCT p_type, p_name FROM part))""")
def s04(spark, d):
    folder = derived(spark, "names")
    names = table(spark, d, "part").groupBy("p_type").agg(F.to_json(F.struct(F.sort_array(F.collect_set("p_name")).alias("names"))).alias("value"))
    names.write.partitionBy("p_type").text(folder)
    return files.reference_names(spark, folder)


@query("s04_remap", """
SELECT old, new FROM (SELECT DISTINCT unnest([lower(replace(p_name, ' ', '_')), p_name]) AS old, 'ing_' || lpad(CAST(k AS VARCHAR), 5, '0') AS new
FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name))""")
def s04_remap(spark, d):
    folder = derived(spark, "remap")
    part = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("p_type"))
    target = F.concat(F.lit(" ING_"), F.col("k").cast("string"))
    lines = part.groupBy("p_type").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("p_name", target))).alias("remap"))).alias("value"))
    lines.write.partitionBy("p_type").text(folder)
    return files.remap_entries(spark, folder).select("old", "new")


@query("s05", """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_size % 5 <> 0 AS valid FROM part WHERE p_size <> 7""")
def s05(spark, d):
    part = table(spark, d, "part")
    # One file for each brand: text before, the header, rows of which some lack a field, comments, the end mark and rows of another table.
    name = F.when(F.col("p_size") == 7, F.lit("-- a comment")).otherwise(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") % 5 != 0, F.col("p_type"))))
    body = F.array_join(F.collect_list(name), "\n")
    value = F.concat(F.lit("SET x;\nCOPY s.ingredient_master (id, name, type) FROM stdin;\n"), body, F.lit("\n\\.\nCOPY s.other (id) FROM stdin;\n1\t2\t3\n\\."))
    folder = derived(spark, "dump")
    part.groupBy("p_brand").agg(value.alias("value")).write.partitionBy("p_brand").text(folder)
    rows = files.dump_rows(spark, folder, "ingredient_master", 3)
    return rows.select(F.get("fields", F.lit(0)).alias("id"), F.get("fields", F.lit(1)).alias("name"), "valid")


@query("s06", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS ordinal FROM orders")
def s06(spark, d):
    insert = F.concat(F.lit("INSERT INTO recipe_Nutrition (a, b) values ( "), F.col("o_custkey").cast("string"), F.lit(", "), F.col("o_totalprice").cast("string"), F.lit(");"))
    other = F.concat(F.lit("INSERT INTO recipe VALUES ("), F.col("o_custkey").cast("string"), F.lit(");"))
    lines = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", insert).otherwise(other).alias("line"))
    return files.insert_ids(lines, "line", "recipe_nutrition").select("o_orderkey", "ordinal")


FILES = """
SELECT doc_id, 'root/' || lang || '/' || source || '/' || doc_id || CASE n_chars % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.gif' WHEN 2 THEN '.webp' ELSE '.txt' END AS path, lang, source, n_chars FROM documents"""


def _files(spark, d):
    ending = F.element_at(F.array(*map(F.lit, (".JPG", ".gif", ".webp", ".txt"))), (F.col("n_chars") % 4 + 1).cast("int"))
    path = F.concat(F.concat_ws("/", F.lit("root"), "lang", "source", F.col("doc_id").cast("string")), ending)
    return table(spark, d, "documents").select("doc_id", path.alias("path"))


@query("s07", f"SELECT doc_id, path, lang AS split, source AS class FROM ({FILES}) WHERE n_chars % 4 <> 3")
def s07(spark, d):
    return files.inventory(_files(spark, d), "path", files.UPLOADS)


@query("s07_training", f"SELECT doc_id, path, lang AS split, source AS class FROM ({FILES}) WHERE n_chars % 4 IN (0, 2)")
def s07_training(spark, d):
    return files.inventory(_files(spark, d), "path")


PIXELS = """
WITH p AS (SELECT vec_id, CASE WHEN label % 5 = 0 THEN NULL ELSE list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 200) AS INTEGER) % 256) END AS px FROM embeddings),
g AS (SELECT vec_id, px, list_transform(px, lambda x: (0.299 * x + 0.587 * x + 0.114 * x) / 255.0) AS g FROM p),
l AS (SELECT vec_id, g[i + 8] + g[i - 8] + g[i + 1] + g[i - 1] - 4.0 * g[i] AS v FROM g, (SELECT 8 * r + c + 1 AS i FROM range(1, 7) a(r), range(1, 7) b(c)) WHERE g IS NOT NULL),
s AS (SELECT vec_id, var_pop(v) AS variance FROM l GROUP BY vec_id)
SELECT g.vec_id, variance, list_avg(g) AS luminance FROM g LEFT JOIN s USING (vec_id)"""


def _images(spark, d):
    """Eight by eight pixels of one channel from the first 64 components of each vector; some can't be read."""
    value = lambda x: (F.floor(F.abs(x.cast("double")) * 200) % 256).cast("int")
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 64), lambda x: F.lpad(F.hex(value(x)), 2, "0")), ""))
    bad = F.col("label") % 5 == 0
    size = F.when(bad, -1).otherwise(8)
    return table(spark, d, "embeddings").select(F.struct(F.col("vec_id").cast("string").alias("origin"), size.alias("height"), size.alias("width"), F.lit(1).alias("nChannels"), data.alias("data")).alias("image"))


@query("a15", f"SELECT CAST(vec_id AS VARCHAR) AS origin, round(variance, 6) AS variance, round(luminance, 6) AS luminance FROM ({PIXELS})")
def a15(spark, d):
    return candidates.image_statistics(_images(spark, d)).select("origin", F.round("variance", 6).alias("variance"), F.round("luminance", 6).alias("luminance"))


SCORED = f"""
SELECT vec_id, variance, luminance, greatest(0.0, least(1.0, variance / 0.02)) AS b, 1.0 - least(abs(luminance - 0.5) * 2.0, 1.0) AS e FROM ({PIXELS})"""


@query("s08", f"""
SELECT CAST(vec_id AS VARCHAR) AS origin, CASE WHEN variance IS NULL THEN 0.0 ELSE CAST(round(CAST(b AS DECIMAL(30, 12)), 4) AS DOUBLE) END AS blur, CASE WHEN variance IS NULL THEN 0.5 ELSE CAST(round(CAST(e AS DECIMAL(30, 12)), 4) AS DOUBLE) END AS exposure,
  CASE WHEN variance IS NULL THEN 0.25 ELSE CAST(round(CAST(0.55 * b + 0.45 * e AS DECIMAL(30, 12)), 4) AS DOUBLE) END AS combined,
  CASE WHEN variance IS NULL THEN 'IMAGE_DECODE_FAILED' ELSE concat_ws(',', CASE WHEN variance < 30 THEN 'BLUR_SUSPECT' END, CASE WHEN luminance < 0.08 THEN 'UNDEREXPOSED' END, CASE WHEN luminance > 0.92 THEN 'OVEREXPOSED' END) END AS signals FROM ({SCORED})""")
def s08(spark, d):
    return candidates.image_report(_images(spark, d)).withColumn("signals", F.array_join("signals", ","))


@query("f37", f"""
SELECT CAST(vec_id AS VARCHAR) AS origin, CAST(round(CAST(b AS DECIMAL(30, 12)), 4) AS DOUBLE) AS blur, CAST(round(CAST(e AS DECIMAL(30, 12)), 4) AS DOUBLE) AS exposure, CAST(round(CAST(0.55 * b + 0.45 * e AS DECIMAL(30, 12)), 4) AS DOUBLE) AS combined, variance < 0.01 AS is_blurred FROM ({SCORED}) WHERE variance IS NOT NULL""")
def f37(spark, d):
    from larder.operators.recognition import image_scores

    rows = candidates.image_statistics(_images(spark, d)).filter("variance is not null").withColumn("s", image_scores("variance", "luminance", 0.01))
    return rows.select("origin", "s.blur", "s.exposure", "s.combined", F.array_contains("s.signals", "BLUR_SUSPECT").alias("is_blurred"))


@query("s09", """
SELECT p_partkey, p_name AS title, p_size || '인분' AS quantity, p_type AS time, '' AS difficulty, p_name || ':1|' || p_brand || ':2' AS ingredients, 'mix ' || p_name || '>a' || p_size || '.png' AS steps
FROM part WHERE p_size % 6 <> 0""")
def s09(spark, d):
    part, c = table(spark, d, "part"), lambda n: F.col(n).cast("string")
    box = F.when(F.col("p_size") % 6 == 0, "other").otherwise("divConfirmedMaterialArea")
    html = F.concat(
        F.lit('<html><div class="box view2_summary"><h3> '), c("p_name"), F.lit('</h3><div class="view2_summary_info"><span>'), c("p_size"), F.lit("인분</span><span> "), c("p_type"), F.lit('</span></div></div><div id="'), box,
        F.lit('"><ul><li><div>'), c("p_name"), F.lit("</div><span>1</span></li></ul><ul><li><div> "), c("p_brand"), F.lit('</div><span>2</span></li></ul></div><div id="obx_recipe_step_start"><div>head</div><div><div>mix '), c("p_name"),
        F.lit('</div><div><img src="a'), c("p_size"), F.lit('.png"></div></div><div><div>no image</div></div></div></html>'),
    )
    found = recipe_pages.recipe_records(part.select("p_partkey", html.alias("html")), "p_partkey", "html")
    joined = lambda items, a, b, mark: F.array_join(F.transform(items, lambda x: F.concat(x[a], F.lit(mark), x[b])), "|")
    return found.select("p_partkey", "title", "quantity", "time", "difficulty", joined("ingredients", "name", "quantity", ":").alias("ingredients"), joined("steps", "description", "image", ">").alias("steps"))


@query("s11", """
SELECT p_name AS normalized_name, p_brand AS source_dir, 'ing_' || keep_id AS class FROM part JOIN (SELECT p_name, min(p_partkey) AS keep_id FROM part GROUP BY p_name) USING (p_name) WHERE p_size > 10""")
def s11(spark, d):
    part = table(spark, d, "part")
    manifest = part.select(F.col("p_name").alias("normalized_name"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(" ").alias("source_dir"))
    labels = part.groupBy(F.col("p_name").alias("normalized_name")).agg(F.concat(F.lit("ing_"), F.min("p_partkey").cast("string")).alias("key"))
    return candidates.verified_folders(manifest, labels)


@query("s12", "SELECT 'ing_' || lpad(CAST(p_size AS VARCHAR), 5, '0') AS key, arg_max(p_name, p_partkey) AS display_name FROM part GROUP BY p_size")
def s12(spark, d):
    folder = F.concat(F.when(F.col("p_partkey") % 2 == 0, " ING_").otherwise("ing_000"), F.col("p_size").cast("string"), F.lit(" "))
    rows = table(spark, d, "part").select(folder.alias("﻿class_folder "), F.concat(F.lit(" "), "p_name").alias(" display_name"), F.col("p_partkey").alias("line_no"))
    return candidates.class_reference(rows).select("key", "display_name")


@query("s14", "SELECT doc_id, text, source FROM documents")
def s14(spark, d):
    folder = derived(spark, "sink")
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    files.write_csv(docs, folder)
    return spark.read.csv(folder, schema=docs.schema, header=True, escape='"', multiLine=True)


@query("s15", "SELECT CAST(to_json({'rowCount': count(*), 'distinctNormalizedNames': count(DISTINCT p_name), 'names': list_sort(list(DISTINCT p_name))}) AS VARCHAR) AS value FROM part")
def s15(spark, d):
    return files.vocabulary_json(table(spark, d, "part"), "p_name")


@query("s15_labels", """
SELECT CAST(json_group_object(key, entry) AS VARCHAR) AS value FROM (
  SELECT 'ing_' || lpad(CAST(min(p_partkey) AS VARCHAR), 5, '0') AS key, {'name': p_name, 'n': count(*)} AS entry FROM part GROUP BY p_name ORDER BY key)""")
def s15_labels(spark, d):
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("k"))
    return files.label_json(names.withColumn("key", class_key(F.concat(F.lit("ing_"), F.col("k").cast("string")))), "key", ["name", "n"])


@query("p07", "SELECT p_partkey FROM part WHERE p_size % 3 <> 1")
def p07(spark, d):
    state = F.when(F.col("p_size") % 3 == 0, F.lit(True)).when(F.col("p_size") % 3 == 1, F.lit(False))
    return table(spark, d, "part").filter(tables.active(state)).select("p_partkey")


@query("p08", "SELECT p_partkey AS ingredient_id, p_name AS normalized_name, o.first_date AS stamp FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS first_date FROM lineitem GROUP BY 1) o ON l_partkey = p_partkey")
def p08(spark, d):
    dates = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_shipdate").alias("created_date"))
    drifted = table(spark, d, "part").join(dates, "p_partkey", "left")
    wanted = {"ingredient_id": ["ingredient_id", "id", "p_partkey"], "normalized_name": ["normalized_name", "p_name"], "absent": ["nowhere"], "stamp": [tables.timestamp_column(drifted)]}
    return tables.resolved(drifted, wanted, required=["ingredient_id"])


@query("s13", "SELECT p_partkey, p_name, p_size, p_brand FROM part")
def s13(spark, d):
    # Written under other columns, of which the target has some; the target's schema decides what is kept.
    target = derived(spark, "table")
    part = table(spark, d, "part")
    tables.for_target(part.withColumn("scratch", F.lit(1)), part.select("p_partkey", "p_name", "p_size", "p_brand")).write.parquet(target)
    return spark.read.parquet(target)


@query("s13_jdbc", "SELECT p_partkey, p_name, p_size, p_brand FROM part WHERE p_size > 5")
def s13_jdbc(spark, d):
    """Through a database inside this process, so on a local master only; a table there is replaced, and read back in parallel by its own counts."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("an embedded database is within reach of one process only")
    url, part = f"jdbc:derby:memory:larder{uuid.uuid4().hex};create=true", table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    for rows in (part, part.filter("p_size > 5")):
        tables.replace_table(rows, url, "part", rename="RENAME TABLE {old} TO {new}")
    return tables.read_table(spark, url, "part", split="p_partkey", parts=4)


@query("s04_groups", """
SELECT CASE WHEN k % 2 = 0 THEN 'Fruit' ELSE 'Vegetables' END AS family, p_name AS folder, kind AS name
FROM (SELECT p_name, min(p_partkey) AS k, min(p_type) AS kind FROM part GROUP BY p_name) WHERE k % 5 <> 0""")
def s04_groups(spark, d):
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("kind"))
    name = F.when(F.col("k") % 5 == 0, F.lit(" ")).otherwise(F.col("kind"))
    entries = lambda even: F.map_from_entries(F.collect_list(F.when(F.col("k") % 2 == (0 if even else 1), F.struct("p_name", name))))
    folder = derived(spark, "groups")
    value = F.to_json(F.struct(entries(True).alias("Fruit"), entries(False).alias("Vegetables"))).alias("value")
    names.groupBy((F.col("k") % 7).alias("file")).agg(value).write.partitionBy("file").text(folder)
    return files.grouped_maps(spark, folder, ["Fruit", "Vegetables"]).withColumnRenamed("group", "family")


@query("s07_files", "SELECT DISTINCT 'lang=' || lang AS split, 'source=' || source AS class FROM documents")
def s07_files(spark, d):
    """Over files that are there: one for each class of a split, beside others that are none of the kind."""
    folder = derived(spark, "images")
    rows = table(spark, d, "documents").select("lang", "source").distinct().withColumn("value", F.lit("x")).repartition("lang", "source")
    rows.write.partitionBy("lang", "source").text(folder)
    rows.write.mode("append").partitionBy("lang", "source").json(folder)
    return files.image_files(spark, folder, ["TXT", "txt"]).select("split", "class")
