import pytest
from pyspark.sql import functions as F

from larder.operators import importing, jobs, nutrition


def raw(spark, rows):
    return spark.createDataFrame([(p, k, f) for p, k, f in rows], "path string, line_no long, fields map<string,string>")


@pytest.fixture(scope="module")
def imported(spark):
    items = "[{'name': '김치', 'quantity': '1컵'}, {'name': '물', 'quantity': None, 'isOptional': True}]"
    rows = [
        ("a.csv", 0, {"title": "찌개", "img": "1", "ingredients": items, "steps": "[{'description': '끓인다', 'image': 'x'}]"}),
        ("a.csv", 1, {"title": "찌개", "img": "2", "ingredients": "소금|설탕", "steps": "- 하나\n- 둘"}),
        ("b.csv", 0, {"title": " ", "ingredients": items}), ("b.csv", 1, {"title": "빈", "ingredients": ""}), ("b.csv", 2, {"title": "옛", "ingredients": "{'name': '', 'quantity': '2'}"}),
    ]
    recipes = spark.createDataFrame([(5, "s", "k", "옛")], "recipe_id long, source_site string, source_recipe_key string, title string")
    master = spark.createDataFrame([(3, "소금")], "ingredient_id long, canonical_name string")
    return importing.import_recipes(raw(spark, rows), recipes, master, site="s")


def test_import(imported):
    assert sorted((r.recipe_id, r.title, r.thumbnail_url) for r in imported["recipes"].collect()) == [(5, "옛", None), (6, "찌개", "1")]
    lines = sorted((r.recipe_id, r.sort_order, r.raw_text, r.ingredient_master_id) for r in imported["recipe_ingredient"].collect())
    assert lines[0] == (5, 1, " 2", None) and [x[:3] for x in lines[1:]] == [(6, 1, "소금"), (6, 2, "설탕")] and lines[1][3] == 3 and lines[2][3] > 3
    assert sorted((r.recipe_id, r.step_no, r.instruction_text) for r in imported["recipe_step"].collect()) == [(6, 1, "하나"), (6, 2, "둘")]
    assert {r.canonical_name for r in imported["ingredient_master"].collect()} == {"소금", "김치", "물", "설탕"}
    s = imported["statistics"].first()
    assert (s.files, s.rows, s.imported, s.skipped, s.ingredients, s.steps) == (2, 5, 3, 2, 5, 3)
    assert sorted(r.skip_reason for r in imported["rejects"].collect()) == ["empty_ingredients", "empty_title"]


def test_list_cells():
    cells = {"a;;b": ["a", "b"], "a|b;;c": ["a", "b;;c"], "- a\n\n-b": ["a", "b"], "plain": ["plain"], "": [], "{'name': 'x'}": [{"name": "x"}], "[1, None]": [1, None], "3": ["3"]}
    assert {k: importing.list_cell(k) for k in cells} == cells


def test_ordinals_gaps_and_remap(spark):
    accepted = spark.createDataFrame([("b", 0, "k3", "t3"), ("a", 5, "k2", "t2"), ("a", 2, "k1", "t1"), ("b", 7, "k9", "t9")], "path string, line_no long, key string, title string")
    recipes = spark.createDataFrame([(10, "s", "k1", "x"), (20, "o", "q", "t2"), (3, "s", "k3", "t3")], "recipe_id long, source_site string, source_recipe_key string, title string")
    mapping = importing.ordinal_map(accepted, recipes, "s")
    assert sorted((r.ordinal, r.recipe_id) for r in mapping.collect()) == [(1, 10), (2, 20), (3, 3), (4, None)]
    gaps = importing.recipe_gaps(spark, recipes, mapping, 1, 4).collect()
    assert sorted((r.ordinal, r.recipe_id, r.state) for r in gaps) == [(1, 10, "matched"), (2, 20, "matched"), (4, None, "needs_insert")]
    text = "INSERT INTO recipe_nutrition VALUES ({}, 1);"
    lines = spark.createDataFrame([(0, "-- x", None), (1, text.format(1), 1), (2, text.format(3), 3), (3, text.format(1), 1)], "line_no long, line string, ordinal long")
    found = importing.remap_nutrition(lines, mapping).orderBy("line_no").collect()
    assert [(r.line, r.state) for r in found] == [("-- x", "passed"), (text.format(10), "changed"), (text.format(3), "unchanged"), (text.format(10), "skipped")]
    with pytest.raises(Exception, match="no recipe for ordinal 4"):
        importing.remap_nutrition(lines.limit(1).withColumn("ordinal", F.lit(4).cast("long")), mapping).collect()


def test_approved_pairs(spark):
    pairs = spark.createDataFrame([("1", "2", "a", " yes "), ("3", "x", "b", "승인"), ("4", "5", "c", "N"), ("5", "6", " ", "Y")], "left_id string, right_id string, suggested_name string, approved string")
    master = spark.createDataFrame([(k, f"n{k}") for k in range(1, 7)], "ingredient_id long, normalized_name string")
    child = spark.createDataFrame([(1, 2), (1, 1), (1, None)], "recipe long, ingredient_id long")
    edges = spark.createDataFrame([(1, 2, None), (2, 1, None), (3, 4, "x")], "base_ingredient_id long, sub_ingredient_id long, cooking_context string")
    out = jobs.apply_approved_pairs(pairs, master, {"child": (child, "ingredient_id")}, edges, context="cooking_context")
    assert sorted((r.ingredient_id, r.normalized_name) for r in out["master"].collect()) == [(1, "a"), (3, "b"), (4, "n4"), (5, "n5"), (6, "n6")]
    assert sorted(r.ingredient_id or 0 for r in out["child"].collect()) == [0, 1, 1]
    assert sorted((r.base_ingredient_id, r.sub_ingredient_id) for r in out["edges"].collect()) == [(1, 1), (3, 4)]
    clash = pairs.unionByName(spark.createDataFrame([("1", "9", "z", "Y")], pairs.schema))
    with pytest.raises(Exception, match="conflicting names"):
        jobs.apply_approved_pairs(clash, master, {}, edges)["master"].collect()


def test_meals(spark):
    history = spark.createDataFrame([(1, "2024-01-30", 10.0), (1, "2024-01-05", None), (1, "2023-12-01", 99.0)], "u long, d string, v double").withColumn("d", F.to_timestamp("d"))
    recipes = spark.createDataFrame([(k, 100.0 * k, 15.0, 16.0, 14.6, 10.0, 400.0, 30.0) for k in range(1, 7)], "id long, calories double, carbs double, protein double, fat double, sugar double, sodium double, cholesterol double")
    found = jobs.recommend_meals(history, recipes, nutrition.fixed_targets(spark), user="u", date="d", values=["v"], recipe_id="id", as_of="2024-01-31").first()
    assert (found.month_v, found.week_v) == (5.0, 10.0) and found.meals["breakfast"] == [3, 2, 4] and found.meals["lunch"][0] == 4


def test_class_jobs(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = jobs.migrate_classes(one([(1, "a"), (2, "a"), (3, "b")], "id long, name string"), one([(1, "a")], "id long, name string"), one([("p", 2), ("q", 1), ("r", 3)], "path string, class_id long"))
    assert tuple(out["statistics"].first()) == (1, 1, 1, 1)
    issues = jobs.audit_assets(one([(1, "a"), (2, "b")], "id long, name string"), one([(1, "x"), (3, "c")], "id long, name string"), one([(9,)], "id long"), one([(1,), (8,)], "id long"))
    assert sorted(map(tuple, issues.collect())) == [(1, "name_mismatch"), (2, "missing_label"), (3, "extra_label"), (8, "orphan_folder"), (9, "dead_alias")]
    seed = one([("마늘", ["Garlic", "garlic ", "clove"])], "name string, terms array<string>")
    template = jobs.alias_template(one([("ing_1", 1, "다진 마늘"), ("ing_2", 2, "물")], "label string, id long, name string"), one([("ing_2", 4)], "label string, n long"), seed)
    assert [(r.label, r.terms) for r in template.collect()] == [("ing_1", ["Garlic", "clove"])]
    plan = jobs.collection_plan(template.select("label", "terms"), one([("ing_1", 7)], "label string, n long"), one([("x",)], "label string"), [" raw"], target=5, cap=10, seed=1).first()
    assert plan.need == 3 and sorted(plan.queries) == ["Garlic", "Garlic raw", "clove", "clove raw"]
    files = one([("d/a.png", "red apple"), ("e/a.png", "red apple"), ("f/b.png", "zzz")], "path string, folder string")
    manifest = jobs.assembly_manifest(files, one([("사과", "ing_7")], "name string, class string"), one([("x", "y")], "name string, value string"), one([("red", "사과")], "name string, value string"), "f360")
    assert sorted((r.path, r.file, r.reason) for r in manifest.collect()) == [("d/a.png", "ing_7/f360__a.jpg", None), ("e/a.png", "ing_7/f360__a_1.jpg", None), ("f/b.png", None, "unmapped")]
    context = jobs.report_context(one([(1, "t")], "id long, title string"), one([(1, "b"), (1, "a")], "user_id long, name string"), one([(1, 1, "m"), (1, 2, "n"), (2, 1, "o")], "user_id long, at long, title string"))
    assert sorted((r.user_id, r.ingredients, r.meals, r.titles) for r in context.collect()) == [(1, ["a", "b"], ["n", "m"], ["t"]), (2, [], ["o"], ["t"])]
