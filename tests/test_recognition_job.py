from larder.operators import candidates, nutrition
from larder.sources import files

ITEM = "array<struct<display_name:string,normalized_name:string,category:string,confidence:double,ingredient_id:long,uncertain:boolean>>"


def test_recognize(spark):
    new = spark.createDataFrame
    item = lambda p, u=False: ("a", "a", None, p, 1, u)
    routes = new([(1, '{"route":"packaged_food","confidence":0.9,"needs_user_confirmation":false}'), (2, '{"route":{"type":"raw_ingredient","confidence":0.8,"needsReview":false}}'), (3, '{"route":"x"}')], "image long, answer string")
    raw = new([(1, [item(0.86)]), (2, [item(0.4, True), item(0.95), item(0.1), item(0.05)])], f"image long, candidates {ITEM}")
    none = new([], f"image long, candidates {ITEM}")
    rows = {r.image: r for r in candidates.recognize(routes, none, raw, none, k=10).collect()}
    assert rows[1].stage == "raw_ingredient_classifier_override" and not rows[1].needs_review and rows[1].anomaly.status == "OK"
    assert [c.confidence for c in rows[2].candidates] == [0.95, 0.4, 0.1] and rows[2].stage == "raw_ingredient_classifier"
    assert rows[3].stage == "unsupported_route" and rows[3].needs_review and rows[3].anomaly.status == "NEEDS_REVIEW"


def test_small_scans(spark, tmp_path):
    one, two, three = (tmp_path / f"{k}.json" for k in range(3))
    one.write_text('{"names": ["나", "가", null]}')
    two.write_text('{"remap": {"Old-Name": "ing_7", "ing_3": "ing_00009", "x": "y", "z": null}}')
    three.write_text('{"Fruit": {"Apple": "사과"}, "Vegetables": {"Leek": "대파", "q": " "}}')
    assert [r.name for r in files.reference_names(spark, str(one)).orderBy("place").collect()] == ["나", "가"]
    assert {r.old: r.new for r in files.remap_entries(spark, str(two)).collect()} == {"old_name": "ing_00007", "Old-Name": "ing_00007", "ing_3": "ing_00009", "ing_00003": "ing_00009"}
    assert sorted(map(tuple, files.grouped_maps(spark, str(three), ["Fruit", "Vegetables"]).collect())) == [("Fruit", "Apple", "사과"), ("Vegetables", "Leek", "대파")]


def test_menu(spark):
    names = ["calories", "carbs", "protein", "fat", "sugar", "sodium", "cholesterol"]
    df = spark.createDataFrame([(2, "b", *[1] * 7), (1, "a", None, *[2] * 6)], "id long, title string, " + ", ".join(f"{n} int" for n in names))
    lines = nutrition.menu_lines(df, "title", "id").first().text.split("\n")
    assert lines[0].startswith("- a (칼로리: 0kcal, 탄수화물: 2g") and lines[1].endswith("콜레스테롤: 1mg)")


def test_candidates_from_probabilities(spark):
    images = spark.createDataFrame([("a", [0.2, 0.5, 0.3], [0.4, 0.3, 0.3]), ("b", [0.05, 0.05, 0.9], [])], "image string, p array<double>, flipped array<double>")
    classes = spark.createDataFrame([(0, "ing_1"), (1, "ing_2"), (2, "leek")], "class int, label string")
    labels = spark.createDataFrame([("ing_00001", "Onion", "onion", "VEG", 1)], "key string, display_name string, normalized_name string, category string, ingredient_id long")
    remap = spark.createDataFrame([("ing_00002", "ing_00001")], "old string, new string")
    vocabulary = spark.createDataFrame([("leek",)], "name string")
    rows = lambda **more: {r.image: [(c.display_name, round(c.confidence, 6), c.ingredient_id, c.uncertain) for c in r.candidates] for r in candidates.classified(images, classes, labels, remap, vocabulary, k=2, **more).collect()}
    # The mean of a's passes is 0.3, 0.4, 0.3; the second class now has the first one's name.
    assert rows() == {"a": [("Onion", 0.4, 1, True), ("Onion", 0.3, 1, True)], "b": [("leek", 0.9, None, False), ("Onion", 0.05, 1, False)]}
    near = spark.createDataFrame([("b", {"Onion": 1.0, "leek": 0.1})], "image string, similarity map<string,double>")
    assert [c[0] for c in rows(similarity=near)["b"]] == ["Onion", "leek"]
