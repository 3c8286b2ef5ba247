import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators import candidates, datasets, importing, ordinals, paging, similarity, tables
from larder.sources import files


def test_drifting_schemas(spark):
    df = spark.createDataFrame([(1, "a", True)], "recipe_id long, name string, live boolean")
    assert tables.picked(df, ["id", "recipe_id"]) == "recipe_id" and tables.picked(df, ["x"]) is None
    with pytest.raises(ValueError, match="live.*name.*recipe_id"):
        tables.picked(df, ["x", "y"], required=True)
    assert tables.resolved(df, {"id": ["id", "recipe_id"], "gone": ["x"]}, required=["id"]).columns == ["id"]
    assert tables.key_column(df, "recipes") == "recipe_id"
    assert tables.timestamp_column(df) is None and tables.timestamp_column(df.withColumn("last_modified", F.lit(1)).withColumn("created_at", F.lit(1))) == "created_at"
    assert tables.for_target(df, spark.createDataFrame([], "live boolean, recipe_id long, other int")).columns == ["live", "recipe_id"]


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(k, f"n{k}") for k in range(20)], "id long, name string")
    tables.write_table(df, url, "t", mode="overwrite", driver=driver)
    tables.write_table(df.filter("id < 3").withColumn("id", F.col("id") + 100), url, "t", driver=driver)
    whole, parts = tables.read_table(spark, url, "t", driver=driver), tables.read_table(spark, url, "t", split="ID", parts=4, driver=driver)
    assert whole.count() == 23 and parts.rdd.getNumPartitions() == 5 and sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_parallel_reads_follow_the_values(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    # Most values crowd at the low end; some rows have none.
    df = spark.createDataFrame([(float(k) if k < 900 else 10.0**6 + k, k) for k in range(1000)] + [(None, -1), (None, -2), (-7.5, -3)], "at double, k int")
    tables.write_table(df, url, "t", mode="overwrite")
    parts = tables.read_table(spark, url, "t", split="at", parts=6)
    assert sorted(map(str, parts.collect())) == sorted(map(str, df.collect()))
    crowded = spark.createDataFrame([(k * k, k) for k in range(2000)], "at long, k int")
    tables.write_table(crowded, url, "u", mode="overwrite")
    sizes = tables.read_table(spark, url, "u", split="at", parts=4).rdd.glom().map(len).collect()
    assert sum(sizes) == 2000 and sizes[-1] == 0 and max(sizes) < 800  # equal widths would give 1000
    days = spark.sql("SELECT date_add(DATE '2024-01-01', CAST(id AS INT)) AS day, id FROM range(40)")
    tables.write_table(days, url, "d", mode="overwrite")
    assert tables.read_table(spark, url, "d", split="day", parts=3).count() == 40
    tables.write_table(df.limit(0), url, "e", mode="overwrite")
    assert tables.read_table(spark, url, "e", split="at").count() == 0


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    statement = {"rename": "RENAME TABLE {old} TO {new}"}
    df = spark.range(30).withColumn("name", F.lit("a"))
    assert tables.replace_table(df, url, "t", **statement) == 30
    assert tables.replace_table(df.filter("id < 5"), url, "t", **statement) == 5
    assert tables.read_table(spark, url, "t").count() == 5
    failing = df.withColumn("name", F.when(F.col("id") == 29, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(failing, url, "t", **statement)
    assert tables.read_table(spark, url, "t").count() == 5


def test_pages(spark):
    rows = spark.range(2500).select(F.when(F.col("id") % 5 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("name"), (F.col("id") * 7919 % 2503).alias("id"))
    found = paging.duplicate_pages(rows.unionByName(spark.createDataFrame([("one", 1), (None, 2), ("", 3)], "name string, id long")), "id", "name", size=64).collect()
    assert max(len(r.ids) for r in found) == 64 and {r.row_count for r in found if r.name == "hot"} == {2000}
    listed = {}
    for r in sorted(found, key=lambda r: r.page):
        listed.setdefault(r.name, []).extend(r.ids)
    want = {}
    for r in rows.collect():
        want.setdefault(r.name, []).append(r.id)
    assert listed == {k: sorted(v) for k, v in want.items()}
    top = paging.duplicate_pages(rows, "id", "name", limit=2, size=64).select("name").distinct().collect()
    assert {r.name for r in top} == {"hot", "k0"}


def test_plans_compose_without_a_job(spark):
    from larder.operators import jobs, nutrition, recipes

    sc = spark.sparkContext
    values = list(nutrition.DEFAULTS)
    kind = ", ".join(f"{v} double" for v in values)
    food = spark.createDataFrame([(k, *[float(k)] * 7) for k in range(9)], f"recipe_id long, {kind}")
    history = spark.createDataFrame([("u", "2024-01-20", *[1.0] * 7)], f"user string, day string, {kind}").withColumn("day", F.to_date("day"))
    titles = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "id long, title string")
    fridge, eaten = spark.createDataFrame([("u", "egg")], "user_id string, name string"), spark.createDataFrame([("u", 1, "x")], "user_id string, at int, title string")
    sc.setJobGroup("composing", "none may run")
    meals = jobs.recommend_meals(history, food, nutrition.fixed_targets(spark), user="user", date="day", values=values, recipe_id="recipe_id", as_of="2024-01-31")
    context = jobs.report_context(titles, fridge, eaten, n=2)
    gaps = recipes.missing_ids(spark, food, "recipe_id", -2, food.agg(F.max("recipe_id")).scalar() + 3)
    none = recipes.missing_ids(spark, food.limit(0), "recipe_id", 0, food.limit(0).agg(F.max("recipe_id")).scalar())
    ran = list(sc.statusTracker().getJobIdsForGroup("composing"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert ran == []
    assert {len(v) for v in meals.first().meals.values()} == {3} and context.first().titles == ["a", "b"]
    assert sorted(r.recipe_id for r in gaps.collect()) == [-2, -1, 9, 10, 11] and none.collect() == []
    assert jobs.report_context(titles.limit(0), fridge, eaten).first().titles == []


def test_label_maps(spark, tmp_path):
    text = '{"labels": {"ing_1": {"display_name": "가", "normalizedName": "n"}, "ing_2": {"normalized_name": "n", "ingredient_id": "7"}, "bad": null}}'
    (tmp_path / "l.json").write_text(text)
    labels = files.label_map(spark, str(tmp_path / "l.json"))
    assert sorted(map(tuple, labels.drop("place").collect())) == [("ing_1", "가", "n", None, None), ("ing_2", "ing_2", "n", None, 7)]
    assert [tuple(r) for r in files.label_of_names(labels).collect()] == [("n", "ing_2")]


def test_review_pairs_and_marks(spark, tmp_path):
    df = spark.createDataFrame([tuple(f"{c},\n{c}" for c in files.REVIEW)], ", ".join(f"{c} string" for c in files.REVIEW))
    files.write_csv(df, str(tmp_path / "r"), mark=True)
    assert next((tmp_path / "r").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    assert [tuple(r) for r in files.review_pairs(spark, str(tmp_path / "r")).collect()] == [tuple(df.first())]


def test_inventory(spark, tmp_path):
    for name in ("train/ing_1/a.JPG", "train/ing_1/b.gif", "val/ing_2/c.png", "val/ing_2/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = lambda extensions: sorted((r["split"], r["class"], r.path.split("/")[-1]) for r in files.image_files(spark, str(tmp_path), extensions).collect())
    assert found(files.IMAGES) == [("train", "ing_1", "a.JPG"), ("val", "ing_2", "c.png")] and len(found(files.UPLOADS)) == 3


def test_unreadable_images(spark):
    kind = "image struct<origin:string,height:int,width:int,nChannels:int,data:binary>"
    images = spark.createDataFrame([(("a", -1, -1, -1, b""),), (("b", 3, 3, 1, bytes([0, 0, 0, 0, 255, 0, 0, 0, 0])),)], kind)
    rows = {r.origin: tuple(r)[1:] for r in candidates.image_report(images).collect()}
    assert rows["a"] == (0.0, 0.5, 0.25, ["IMAGE_DECODE_FAILED"]) and rows["b"][3] != ["IMAGE_DECODE_FAILED"]


def test_new_ids_follow_files_then_lines(spark):
    cell = "[{'name': 'salt'}]"
    raw = spark.createDataFrame([("b.csv", 0, {"title": "b0", "ingredients": cell}), ("a.csv", 1, {"title": "a1", "ingredients": cell}), ("a.csv", 0, {"title": "a0", "ingredients": cell}), ("a.csv", 2, None)], "path string, line_no long, fields map<string,string>")
    recipes = spark.createDataFrame([], "recipe_id long, source_site string, source_recipe_key string, title string")
    out = importing.import_recipes(raw, recipes, spark.createDataFrame([], "ingredient_id long, canonical_name string"), site="s")
    assert [r.title for r in out["recipes"].orderBy("recipe_id").collect()] == ["a0", "a1", "b0"]
    assert tuple(out["statistics"].select("rows", "imported", "skipped", "failed").first()) == (4, 3, 1, 1)
    accepted = importing.parsed_rows(raw.filter("fields is not null"))
    with pytest.raises(Exception, match="no recipe for ordinal"):
        importing.ordinal_map(accepted, recipes, "s", required=True).collect()


def test_numbers_in_large_groups(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 3 == 0, F.concat(F.lit("k"), (F.col("id") % 9).cast("string"))).alias("key"))
    rows = rows.unionByName(spark.createDataFrame([(k, None) for k in range(4)], "id long, key string"))
    wanted = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    assert sorted(map(str, ordinals.placed(rows, ["key"], ["id"], "n").select("id", "key", "n").collect())) == sorted(map(str, wanted.collect()))


def test_caps_and_merges(spark):
    kind = "path string, split string, class string, name string"
    existing = spark.createDataFrame([("e1", "train", "c", "a.jpg"), ("e2", "train", "c", "team__u.jpg"), ("e3", "train", "c", "z.jpg"), ("e4", "val", "c", "team__u_1.jpg")], kind)
    uploads = spark.createDataFrame([("u1", "train", "c", "u.jpg"), ("u2", "val", "c", "u.jpg"), ("u3", "val", "c", "v.jpg"), ("u4", "val", "c", "w.jpg")], kind)
    out = datasets.cap_and_merge(existing, uploads, ["train", "val"], cap=2)
    assert [r.path for r in out["victims"].collect()] == ["e3"]
    assert sorted((r.path, r.target, r.file) for r in out["merged"].collect()) == [("u1", "val", "team__u.jpg"), ("u2", "overflow", None), ("u3", "overflow", None), ("u4", "overflow", None)]
    more = datasets.cap_and_merge(existing.filter("path in ('e2', 'e4')"), uploads, ["train", "val"], cap=3)
    assert sorted((r.path, r.target, r.file) for r in more["merged"].collect()) == [("u1", "train", "team__u_1.jpg"), ("u2", "train", "team__u_2.jpg"), ("u3", "val", "team__v.jpg"), ("u4", "val", "team__w.jpg")]


def test_lsh_finds_near_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    near = base + rng.normal(size=base.shape) * 0.05
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([base, near]))]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    pairs = lambda df: {(r.left_id, r.right_id) for r in df.collect()}
    assert pairs(similarity.lsh_pairs(vectors, "id", "v", 0.95)) == pairs(similarity.similar_pairs(vectors, "id", "v", 0.95)) and len(pairs(similarity.lsh_pairs(vectors, "id", "v", 0.95))) >= 60
    with pytest.raises(ValueError, match="method"):
        similarity.suggest_merges(vectors, "id", "id", vectors, "v", method="x")


def test_numbers_by_texts_in_many_tasks(spark):
    # One group holds most rows; the order is of text, then of a number, and nulls come first.
    rows = spark.range(4000).select(F.when(F.col("id") % 50 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("cls"), F.when(F.col("id") % 97 > 0, F.concat(F.lit("root/train/"), F.md5(F.col("id").cast("string")))).alias("path"), (F.col("id") * 31 % 4001).alias("id"))
    found = ordinals.placed(rows, ["cls"], ["path", "id"], "n").collect()
    wanted = rows.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("path", "id"))).collect()
    assert sorted(map(str, found)) == sorted(map(str, wanted))
    spread = ordinals._ranged(rows, ["cls", "path", "id"], "test").filter("cls = 'hot'").groupBy("_range").count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 2000
    numbered = ordinals.ordinals(rows, [F.desc("path"), "id"], "n").collect()
    assert [r.n for r in sorted(numbered, key=lambda r: (r.path is None, [-ord(c) for c in r.path or ""], r.id))] == list(range(1, 4001))
    assert ordinals.ordinals(rows.limit(0), ["path"]).collect() == [] == ordinals.placed(rows.limit(0), ["cls"], ["path"], "n").collect()


def test_cells_are_parsed_once(spark):
    parsed = spark.sparkContext.accumulator(0)
    raw = spark.range(500).selectExpr("concat('f', id % 3, '.csv') AS path", "id AS line_no", "map('title', concat('t', id % 90), 'ingredients', '[\"salt\"]', 'steps', '[\"cook\"]') AS fields")

    @F.udf("string")
    def counted(value):
        parsed.add(1)
        return value

    raw = raw.withColumn("fields", F.transform_values("fields", lambda k, v: v)).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("difficulty"), counted(F.col("fields")["title"]))))
    recipes = spark.createDataFrame([(7, "s", "x", "t5")], "recipe_id long, source_site string, source_recipe_key string, title string")
    out = importing.import_recipes(raw, recipes, spark.createDataFrame([], "ingredient_id long, canonical_name string"), site="s")
    counts = {k: v.count() for k, v in out.items()}
    assert parsed.value == 500
    assert counts == {"recipes": 90, "recipe_ingredient": 90, "recipe_step": 90, "ingredient_master": 1, "rejects": 0, "statistics": 1}
    assert sorted(r.recipe_id for r in out["recipes"].collect()) == list(range(7, 97))
    assert out["recipe_ingredient"].filter("ingredient_master_id is null").count() == 0
