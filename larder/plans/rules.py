"""Queries of rules and nutrition; parts stand for recipes, events for daily nutrition."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import classify, nutrition
from larder.plans.base import query, table


@query("a06", """
SELECT user_id, coalesce(sum(CAST(CASE WHEN event_type <> 'click' THEN value END AS DECIMAL(18, 2))), 0)::DOUBLE / count(*) AS month_v,
  CASE WHEN count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-24') > 0 THEN
    coalesce(sum(CAST(CASE WHEN event_type <> 'click' THEN value END AS DECIMAL(18, 2))) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-24'), 0)::DOUBLE
    / count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-24') ELSE 0.0 END AS week_v
FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-01' GROUP BY user_id""")
def a06(spark, d):
    history = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))
    return nutrition.window_means(history, "user_id", "ts", ["v"], "2024-01-31")


SCORE = """abs(p_size * 10.0 - greatest(0.0, {calories} - 200)) * 1 + abs(p_size * 2.0 - greatest(0.0, {carbs} - 45)) * 4 + abs(p_size * 1.0 - greatest(0.0, {protein} - 4)) * 4
  + abs(p_size * 0.5 - greatest(0.0, {fat} - 0.4)) * 9 + (abs(p_size * 0.25 - greatest(0.0, {sugar} - 0)) * 4 + abs(p_size * 12.0 - greatest(0.0, {sodium} - 0)) * 0.1
  + abs(p_size * 1.5 - greatest(0.0, {cholesterol} - 0)) * 0.1)"""
T05 = " UNION ALL ".join(f"SELECT p_partkey, '{meal}' AS meal, CAST({SCORE.format(**t)} AS DOUBLE) AS score FROM part" for meal, t in nutrition.MEALS.items())


@query("t05", f"""
SELECT p_partkey, meal, round(score, 6) AS score, CAST(k AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY meal ORDER BY round(score, 9), p_partkey) AS k FROM ({T05})) WHERE k <= 3""")
def t05(spark, d):
    factors = {"calories": 10.0, "carbs": 2.0, "protein": 1.0, "fat": 0.5, "sugar": 0.25, "sodium": 12.0, "cholesterol": 1.5}
    recipes = table(spark, d, "part").select("p_partkey", *[(F.col("p_size") * x).alias(n) for n, x in factors.items()])
    return nutrition.nearest(recipes, nutrition.fixed_targets(spark), "p_partkey").withColumn("score", F.round("score", 6))


CODES = "CASE p_size % 9 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(["VEGETABLE", "FRUIT", "MEAT", "SEAFOOD", "DAIRY", "GRAIN", "SEASONING", "other"])) + " END"


@query("f28", f"""
WITH r AS (SELECT p_partkey, {CODES} AS code, CASE p_partkey % 4 WHEN 0 THEN 'room' WHEN 1 THEN 'FROZEN' WHEN 2 THEN 'attic' END AS storage FROM part),
t(code, room, refrigerated, frozen) AS (VALUES {", ".join(f"('{c}', {d[0]}, {d[1]}, {d[2]})" for c, d in classify.DAYS.items())})
SELECT p_partkey, CASE WHEN t.code IS NOT NULL THEN CASE storage WHEN 'room' THEN room WHEN 'FROZEN' THEN frozen ELSE refrigerated END
    WHEN storage = 'room' THEN 2 WHEN storage = 'FROZEN' THEN 30 ELSE 2 END AS base_days,
  CASE WHEN t.code IS NOT NULL THEN 'rule:category+storage' WHEN storage IN ('room', 'FROZEN') THEN 'rule:storage_only' ELSE 'rule:default' END AS estimated_by,
  t.code IS NULL AS needs_review FROM r LEFT JOIN t USING (code)""")
def f28(spark, d):
    codes = F.get(F.array(*map(F.lit, ["VEGETABLE", "FRUIT", "MEAT", "SEAFOOD", "DAIRY", "GRAIN", "SEASONING", "other"])), F.col("p_size") % 9)
    storage = F.get(F.array(F.lit("room"), F.lit("FROZEN"), F.lit("attic")), (F.col("p_partkey") % 4).cast("int"))
    part = table(spark, d, "part").select("p_partkey", codes.alias("code"), storage.alias("storage"))
    return classify.shelf_life(part, "code", "storage", "2024-01-31").select("p_partkey", "base_days", "estimated_by", "needs_review")


@query("f27", """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'e') THEN 'WITH_E' WHEN contains(lower(p_name), 'o') THEN 'WITH_O' ELSE 'ETC' END AS code,
  CASE WHEN contains(lower(p_name), 'e') OR contains(lower(p_name), 'o') THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM part""")
def f27(spark, d):
    found = classify.category("p_name", [("WITH_E", "e", ["e"]), ("WITH_O", "o", ["o"])])
    return table(spark, d, "part").withColumn("c", found).select("p_partkey", "c.code", "c.confidence")


@query("c09", """
WITH r AS (SELECT p_partkey AS request_id, CASE p_size % 4 WHEN 0 THEN '설탕' WHEN 1 THEN '밀가루' WHEN 2 THEN '통깨' ELSE '당근' END AS missing, p_partkey % 2 = 0 AS rich FROM part)
SELECT request_id, missing, CASE WHEN missing = '설탕' AND rich OR missing = '밀가루' AND NOT rich THEN 'SUBSTITUTE_AVAILABLE' WHEN missing = '통깨' THEN 'OPTIONAL' ELSE 'REQUIRED' END AS decision,
  CASE WHEN missing = '설탕' AND rich THEN '꿀' WHEN missing = '밀가루' AND NOT rich THEN '부침가루' END AS substitute FROM r""")
def c09(spark, d):
    missing = F.get(F.array(*map(F.lit, ["설탕", "밀가루", "통깨", "당근"])), F.col("p_size") % 4)
    owned = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("꿀"), F.lit("쌀"))).otherwise(F.array(F.lit("부침가루")))
    return classify.decide_substitutions(table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), owned.alias("owned"), F.array(missing).alias("missing")))


@query("c10", """
SELECT p_partkey, 'STYLE' AS tag_type, 'SPICY' AS tag_code, round(p_size / 100.0, 4)::DOUBLE AS confidence, 'LLM' AS source_type FROM part WHERE p_size % 3 <> 2
UNION ALL SELECT p_partkey, 'COOKING_TYPE', 'SOUP', 0.7::DOUBLE, 'LLM' FROM part WHERE p_size % 3 = 0""")
def c10(spark, d):
    size = F.col("p_size")
    title = F.when(size % 3 == 0, F.lit("소고기국")).otherwise(F.lit("김치볶음밥"))
    confidence = F.when(size % 3 == 2, F.lit('"high"')).otherwise((size / 100.0).cast("string"))
    answer = F.concat(F.lit('x {"tags":[{"tagType":"style","tagCode":"spicy","confidence":'), confidence, F.lit('},{"tagType":"COOKING_TYPE","tagCode":"SOUP"},{"tagType":"STYLE","tagCode":"odd"}]} y'))
    return classify.recipe_tags(table(spark, d, "part").select("p_partkey", title.alias("title"), answer.alias("answer")), "p_partkey", "title", "answer")


MENU = "'- ' || p_name || ' (칼로리: ' || p_size || 'kcal, 탄수화물: ' || p_size || 'g, 단백질: 0g, 지방: ' || p_size || 'g, 당류: ' || p_size || 'g, 나트륨: ' || p_size || 'mg, 콜레스테롤: ' || p_size || 'mg)'"


@query("f19", f"SELECT p_brand AS menu, string_agg({MENU}, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand")
def f19(spark, d):
    part = table(spark, d, "part")
    recipes = part.select("p_partkey", "p_name", "p_brand", *[F.col("p_size").alias(n) for n in nutrition.DEFAULTS if n != "protein"], F.lit(None).cast("int").alias("protein"))
    return nutrition.menu_lines(recipes, "p_name", "p_partkey", F.col("p_brand"))


@query("f15", "SELECT event_id, CAST(ts AS DATE) >= DATE '2024-01-01' AS month, CAST(ts AS DATE) >= DATE '2024-01-24' AS week FROM events")
def f15(spark, d):
    return table(spark, d, "events").select("event_id", *[nutrition.looks_back("ts", "2024-01-31", n).alias(name) for name, n in zip(("month", "week"), nutrition.DAYS_BACK, strict=True)])


@query("f19_pages", f"""
SELECT p_brand AS menu, CAST((k - 1) // 20 AS INTEGER) AS page, string_agg({MENU}, chr(10) ORDER BY p_partkey) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) GROUP BY ALL""")
def f19_pages(spark, d):
    part = table(spark, d, "part")
    recipes = part.select("p_partkey", "p_name", "p_brand", *[F.col("p_size").alias(n) for n in nutrition.DEFAULTS if n != "protein"], F.lit(None).cast("int").alias("protein"))
    return nutrition.menu_pages(recipes, "p_name", "p_partkey", F.col("p_brand"), 20)


#: Every keyword with its place and category.
KEYWORDS = [(k, code, word) for k, (code, word) in enumerate((code, word) for code, _, words in classify.CATEGORIES for word in words)]
KEYWORD_ROWS = f"(VALUES {', '.join(str(x) for x in KEYWORDS)}) AS w(k, code, word)"


@query("f27_all", f"""
WITH n AS (SELECT p_partkey, p_partkey % {len(KEYWORDS)} AS k, CASE p_size % 3 WHEN 0 THEN a.word WHEN 1 THEN p_name || a.word ELSE a.word || b.word END AS name
  FROM part JOIN {KEYWORD_ROWS.replace("AS w", "AS a")} ON a.k = p_partkey % {len(KEYWORDS)} JOIN {KEYWORD_ROWS.replace("AS w", "AS b")} ON b.k = (p_partkey * 7 + p_size) % {len(KEYWORDS)})
SELECT p_partkey, arg_min(w.code, w.k) AS code, arg_min(w.word, w.k) AS keyword FROM n JOIN {KEYWORD_ROWS} ON contains(n.name, w.word) GROUP BY p_partkey""")
def f27_all(spark, d):
    """Each of the keywords, alone, after other text, and before another keyword."""
    words = F.array(*[F.lit(word) for _, _, word in KEYWORDS])
    at = lambda k: F.get(words, (k % len(KEYWORDS)).cast("int"))
    one, two = at(F.col("p_partkey")), at(F.col("p_partkey") * 7 + F.col("p_size"))
    name = F.when(F.col("p_size") % 3 == 0, one).when(F.col("p_size") % 3 == 1, F.concat("p_name", one)).otherwise(F.concat(one, two))
    return table(spark, d, "part").select("p_partkey", classify.category(name).alias("c")).select("p_partkey", "c.code", "c.keyword")


@query("f34", "SELECT p_partkey, p_size % 3 = 0 AS optional FROM part")
def f34(spark, d):
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("쪽파"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", classify.is_optional(name).alias("optional"))
