import pytest
from pyspark.sql import functions as F

from larder.operators import ocr, recognition
from larder.sources import files, pages, recipe_pages

PAGE = """<div class="top view2_summary"><h3> Beet stew </h3><div class="view2_summary_info"><span>six bowls</span><span>two hours</span><span>easy</span></div></div>
<div id="divConfirmedMaterialArea"><ul><li><div>beet</div><span>4</span></li><li><div>dill</div><span>a bunch</span></li></ul></div>
<div id="obx_recipe_step_start"><div>steps</div><div><div>Grate the beets<br></div><div><img src="grate.png"></div></div><div><div>no picture</div></div><div><div>never</div><div><img src="n"></div></div></div>
<img id="main_thumbs" src="stew.png">"""


def test_recipe_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, PAGE.replace("divConfirmedMaterialArea", "x")), (3, PAGE.replace("main_thumbs", "x")), (4, None)], "page long, html string")
    rows = {r.page: r for r in recipe_pages.recipe_records(df, "page", "html").collect()}
    assert set(rows) == {1, 3} and rows[3].img is None and rows[1].img == "stew.png"
    assert (rows[1].title, rows[1].quantity, rows[1].time, rows[1].difficulty) == ("Beet stew", "six bowls", "two hours", "easy")
    assert [tuple(x) for x in rows[1].ingredients] == [("beet", "4"), ("dill", "a bunch")] and [tuple(x) for x in rows[1].steps] == [("Grate the beets", "grate.png")]


def test_links(spark):
    df = spark.createDataFrame([(1, '<a href="x">1</a><a href=" ">2</a><a>3</a><a class="c" href="y#z">4</a>')], "page long, html string")
    assert [(r.place, r.url) for r in pages.page_links(df, "page", "html").collect()] == [(1, "x"), (2, "y#z")]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿title,steps\n"김치\n찌개","[{\'a\': 1}]"\nb,\n', encoding="utf-8")
    rows = files.recipe_csv(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.fields["title"]) for r in rows] == [(0, "김치\n찌개"), (1, "b")]
    dump = tmp_path / "d.sql"
    dump.write_text("x\nCOPY s.ingredient_master (a) FROM stdin;\na\tb\n-- no\na\n\\.\nc\td\n")
    assert [(r.fields, r.valid) for r in files.dump_rows(spark, str(dump), "ingredient_master", 2).orderBy("line_no").collect()] == [(["a", "b"], True), (["a"], False)]
    labels = tmp_path / "l.json"
    labels.write_text('{"labels": {"ing_00001": {"displayName": "가", "normalizedName": "나", "ingredientId": "1"}, "x": {"ingredientId": "y"}}}')
    assert {r.label: r.ingredient_id for r in files.label_map(spark, str(labels)).collect()} == {"ing_00001": 1, "x": None}
    lines = spark.createDataFrame([("INSERT INTO recipe_nutrition VALUES (12, 3)",), ("INSERT INTO other VALUES (4)",)], "line string")
    assert [r.ordinal for r in files.insert_ids(lines, "line", "recipe_nutrition").collect()] == [12, None]


def lines(spark, rows):
    schema = "image_id long, line_no int, text string, confidence double, box array<array<double>>, width int, height int"
    return spark.createDataFrame([(1, k, t, c, [[float(x) for x in b]] if b else None, 300, 300) for k, (t, c, b) in enumerate(rows)], schema)


def test_titles(spark):
    # A large name in the middle, a small word of the same product, a date and a weight at the edges, and the name once more without a box.
    rows = [("2031.05.09 까지", 0.97, (5, 5, 60, 15)), ("들깨두유", 0.81, (40, 90, 250, 150)), ("두유", 0.88, (40, 160, 90, 180)), ("고소한 맛", 0.74, (40, 60, 160, 85)), ("190ml", 0.93, (230, 280, 290, 295)), ("들깨두유", 0.99, None)]
    df = lines(spark, rows)
    found = ocr.rank_titles(df).orderBy("place").collect()
    assert found[0].reason == "merged_product_title_lines" and found[0].text == "고소한 맛 들깨두유" and found[0].confidence == pytest.approx((0.81 + 0.74) / 2)
    score = {r.line_no: r.s for r in df.select("line_no", ocr.title_score("text", "confidence", "box", "width", "height").alias("s")).collect()}
    assert score[1] > score[2] > score[3] > score[0] and score[4] < 0.35
    assert [r.text for r in found].count("들깨두유") == 1 and not {"190ml", "2031.05.09 까지"} & {r.text for r in found}


def test_polygons(spark):
    box = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((3, 9), (7, 8), (8, 2), (2, 1))])
    assert tuple(spark.range(1).select(ocr.box_edges(box).alias("e")).first().e) == (2.0, 1.0, 8.0, 9.0)


def test_recognition(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    vector = F.array(*[F.lit(v) for v in (0.2, 0.5, 0.3)])
    assert [tuple(x) for x in one(recognition.top_classes(vector, 2))] == [(1, 0.5), (2, 0.3)]
    m = one(recognition.margin(vector))
    assert m.margin == pytest.approx(0.2) and not m.uncertain and one(recognition.margin(F.array(F.lit(0.9)))).margin == 1.0
    routes = F.create_map(F.lit("Raw-Ingredient"), F.lit(0.55), F.lit("x"), F.lit(0.45))
    assert tuple(one(recognition.route(routes))) == ("raw_ingredient", 0.55, True)
    bad = one(recognition.anomaly(F.lit(0.4), F.lit(True), F.lit(None).cast("double"), F.lit(0), F.lit("unsupported_route"), F.lit(True)))
    assert bad.status == "NEEDS_REVIEW" and bad.score == 0.055 and bad.signals == ["ROUTE_NEEDS_REVIEW", "LOW_ROUTE_CONFIDENCE", "NO_CANDIDATES", "PIPELINE_UNCERTAIN"]
    good = one(recognition.anomaly(F.lit(0.9), F.lit(False), F.lit(0.8), F.lit(2), F.lit("x"), F.lit(False)))
    assert (good.status, good.score, good.signals) == ("OK", 0.72, [])
    assert one(recognition.image_scores(F.lit(0.01), F.lit(0.95))).signals == ["BLUR_SUSPECT", "OVEREXPOSED"]
