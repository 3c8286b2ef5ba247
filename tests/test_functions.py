from pyspark.sql import functions as F

from larder.functions import ingredients, text
from larder.operators import classify, resolve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ingredient_names(spark):
    names = {"후추가루": "후춧가루", "굵은 소금": "소금", "꽃소금": "소금", "꽃게": "꽃게", "깐 마늘": "마늘", "대파 흰부분": "대파", "마늘\n국산": "마늘", "삶은": "삶은", " ": None, "초고추장": "초고추장"}
    df = spark.createDataFrame([(k,) for k in names], "raw string")
    assert {r.raw: r.normalized_name for r in ingredients.normalized(df, "raw").collect()} == names


def test_reductions_and_phrases(spark):
    df = spark.createDataFrame([("집된장",), ("시원한 생수",), ("간 깨",), ("다진 마늘(국산)",), ("대파 또는 다진 파",)], "raw string")
    found = {r.raw: (r.base, r.parts) for r in df.select("raw", ingredients.visual_base("raw").alias("base"), ingredients.phrases("raw").alias("parts")).collect()}
    assert found["집된장"][0] == "된장" and found["시원한 생수"][0] == "생수" and found["간 깨"][0] == "깨" and found["다진 마늘(국산)"][0] == "마늘"
    assert found["대파 또는 다진 파"][1] == ["대파", "다진 파", "파"]


def test_labels_and_keys(spark):
    assert [one(spark, text.label(F.lit(x))) for x in (" 사과 ", "사-과", "Red-Apple")] == ["사과", "사_과", "red_apple"]
    assert [one(spark, text.class_key(F.lit(x))) for x in ("ing_7", "ING_00042", "ing_1234567", "x")] == ["ing_00007", "ing_00042", "ing_1234567", "x"]
    assert one(spark, text.class_id(F.lit("ing_00042"))) == 42


def test_category_quirks_and_shelf_life(spark):
    assert one(spark, classify.category(F.lit("소금"))).code == "MEAT"
    assert one(spark, classify.category(F.lit("양배추"))).code == "FRUIT"
    assert one(spark, classify.category(F.lit("zzz"))).confidence == 0.3
    rows = classify.shelf_life(spark.createDataFrame([("meat", "x"), (None, "room"), (None, None)], "c string, s string"), "c", "s", "2024-01-31").collect()
    assert [(r.base_days, r.needs_review) for r in rows] == [(2, False), (2, True), (2, True)]
    assert str(rows[0].estimated_date) == "2024-02-02"


def test_tags(spark):
    answer = '{"tags":[{"tagType":"COOKING_TYPE","tagCode":"SOUP"},{"tagType":"STYLE","tagCode":"SPICY","confidence":0.91234}]}'
    df = spark.createDataFrame([(1, "김치찌개", answer), (2, "김치찌개", "no json"), (3, "미역국", answer)], "id long, title string, answer string")
    assert sorted((r.id, r.tag_code, r.confidence) for r in classify.recipe_tags(df, "id", "title", "answer").collect()) == [(1, "SPICY", 0.9123), (3, "SOUP", 0.7), (3, "SPICY", 0.9123)]


def test_supplied_substitutions(spark):
    requests = spark.createDataFrame([(1, ["꿀"], ["설탕", "소금", "물"])], "request_id long, owned array<string>, missing array<string>")
    supplied = spark.createDataFrame([(1, "설탕", "SUBSTITUTE_AVAILABLE", "버터"), (1, "소금", "OPTIONAL", "꿀"), (1, "없음", "REQUIRED", None)], "request_id long, missing string, decision string, substitute string")
    found = {r.missing: (r.decision, r.substitute) for r in classify.decide_substitutions(requests, supplied).collect()}
    assert found == {"설탕": ("REQUIRED", None), "소금": ("OPTIONAL", None), "물": ("REQUIRED", None)}


def test_merge_keeps_children_of_unknown_ingredients(spark):
    master = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "id long, name string")
    child = spark.createDataFrame([(10, 1), (10, 2), (10, None), (10, 9), (11, 2)], "recipe long, id long")
    mapping = resolve.merge_map(master, "id", "name")
    assert sorted((r.old_id, r.keep_id) for r in mapping.collect()) == [(1, 1), (2, 1)]
    found = resolve.dedup_children(child, "recipe", "id", mapping).collect()
    assert sorted((r.recipe, r.id or 0) for r in found) == [(10, 0), (10, 1), (10, 9), (11, 1)]
    again = resolve.dedup_children(spark.createDataFrame(found, child.schema), "recipe", "id", mapping)
    assert again.count() == 4


def test_keywords_as_one_tree(spark):
    import random
    import re

    from larder.functions import keywords
    from larder.operators import classify

    pick = random.Random(3)
    words = [w for _, _, group in classify.CATEGORIES for w in group]
    letters = sorted(set("".join(words)))
    texts = ["", *words, *("".join(pick.choice(letters) for _ in range(pick.randrange(9))) for _ in range(400)), *(pick.choice(words) + pick.choice(words) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keywords.first_contained(F.col("t"), words).alias("k"), keywords.contains_any(F.col("t"), words).alias("any")).collect()
    for r in rows:
        want = next((k for k, w in enumerate(words) if w in r.t), None)
        assert r.k == want and r.any == (want is not None), r
    # The longest word at a place, marks of patterns being letters.
    for some in (["a", "ab", "abcd", "b.c", "b|", "(x"], ["aa", "a"], ["x"]):
        for word in some:
            assert re.match(keywords.tree_pattern(some), word + "z").group() == word
    few = spark.createDataFrame([("zb.cz",), ("zabcdz",), ("q",), (None,)], "t string").select(keywords.first_contained(F.col("t"), ["b.c", "bc", "abc", "ab", "cd"]).alias("k")).collect()
    assert [r.k for r in few] == [0, 1, None, None]


def test_class_keys_of_long_numbers_follow_the_sql_in_the_query_alone(spark, tmp_path):
    import duckdb

    from larder.plans.registry import QUERIES, SQL

    rows = spark.createDataFrame([(7, 2), (99999, 2), (123456, 2), (1234567, 4), (123456, 3)], "p_partkey long, p_size int")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    found = QUERIES["f03"](spark, str(tmp_path)).select("p_partkey", "class_key", "class_id").collect()
    order = lambda r: (r[0], str(r[1]))
    assert sorted((tuple(r) for r in found), key=order) == sorted(con.sql(SQL["f03"]).fetchall(), key=order)
    assert rows.select(text.class_key(F.lit("ING_0123456"))).first()[0] == "ing_123456"
