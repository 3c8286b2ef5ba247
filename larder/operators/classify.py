"""Rule classification: categories, shelf life, substitutions, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.keywords import first_contained
from larder.functions.text import braced_json, col

# Categories in order, each with its keywords in order.
CATEGORIES = [
    ("MEAT", "육류", ["소고기", "돼지고기", "닭고기", "닭", "소", "돼지", "양고기", "오리", "베이컨", "햄", "소시지", "삼겹살", "등심", "안심", "갈비", "불고기", "육류", "스테이크"]),
    ("SEAFOOD", "해산물", ["생선", "연어", "참치", "고등어", "갈치", "조기", "새우", "오징어", "문어", "낙지", "꽃게", "대게", "가재", "홍합", "굴", "조개", "전복", "해산물", "어류", "어패류", "멸치", "황태", "북어"]),
    ("DAIRY", "유제품", ["우유", "치즈", "버터", "요거트", "요구르트", "크림", "생크림", "아이스크림", "두유", "유제품"]),
    ("FRUIT", "과일", ["사과", "배", "딸기", "포도", "수박", "참외", "복숭아", "자두", "살구", "망고", "파인애플", "키위", "레몬", "오렌지", "귤", "바나나", "블루베리", "체리", "멜론", "과일"]),
    ("VEGETABLE", "채소", ["당근", "양파", "마늘", "파", "대파", "쪽파", "생강", "감자", "고구마", "배추", "상추", "시금치", "브로콜리", "콜리플라워", "양배추", "오이", "가지", "호박", "애호박", "토마토", "피망", "고추", "파프리카", "버섯", "표고버섯", "느타리버섯", "팽이버섯", "콩나물", "숙주", "두부", "채소", "야채"]),
    ("GRAIN", "곡류", ["쌀", "현미", "찹쌀", "보리", "밀", "밀가루", "소면", "라면", "파스타", "스파게티", "우동", "냉면", "국수", "떡", "빵", "식빵", "곡류", "잡곡", "귀리", "옥수수"]),
    ("SEASONING", "조미료", ["소금", "설탕", "간장", "된장", "고추장", "고춧가루", "참기름", "들기름", "식용유", "식초", "후추", "조미료", "다시다", "미원", "굴소스", "피시소스", "올리브유"]),
    ("SAUCE", "소스", ["케첩", "마요네즈", "머스타드", "소스", "드레싱", "타바스코", "스리라차", "칠리소스", "바베큐소스", "데리야키"]),
]
OTHER = ("ETC", "기타")
# Days of storage by category for ROOM, REFRIGERATED, FROZEN, ETC; by storage alone; by neither.
STORAGES = ["ROOM", "REFRIGERATED", "FROZEN", "ETC"]
DAYS = {
    "VEGETABLE": [2, 5, 30, 3],
    "FRUIT": [3, 7, 30, 4],
    "MEAT": [1, 2, 30, 1],
    "SEAFOOD": [1, 2, 30, 1],
    "DAIRY": [1, 5, 30, 2],
    "GRAIN": [30, 60, 180, 30],
    "SEASONING": [60, 120, 365, 60],
    "SAUCE": [30, 90, 365, 30],
    "ETC": [2, 5, 30, 2],
}
STORAGE_ALONE = [2, 5, 30, 3]
NEITHER = 2
# Substitutes in order, and words of ingredients that a recipe can do without.
SUBSTITUTES = {"부침가루": ["밀가루"], "밀가루": ["부침가루"], "소금": ["굵은소금"], "설탕": ["올리고당", "꿀"]}
OPTIONAL = ["깨", "후추", "고명", "쪽파", "대파", "소금"]
# Tags and the words that a soup's title must and must not hold.
COOKING_TAGS = ["SOUP", "STEW", "STIR_FRY", "BRAISED", "SEASONED", "PANCAKE"]
STYLE_TAGS = ["SPICY", "LIGHT", "REFRESHING", "SAVORY", "SWEET"]
SOUP_WORDS = ["국", "탕", "냉국"]
NO_SOUP_WORDS = ["국수", "찜", "말이", "부침", "전", "까스", "스테이크", "덮밥", "볶음", "조림", "튀김", "샐러드"]


def category(c: str | Column, rules: list[tuple[str, str, list[str]]] = CATEGORIES) -> Column:
    """struct of code, name, keyword and confidence: the first keyword that the name holds, else ETC at 0.3."""
    name = F.lower(F.trim(col(c)))
    entry = lambda code, title, word, p: F.struct(F.lit(code).alias("code"), F.lit(title).alias("name"), F.lit(word).cast("string").alias("keyword"), F.lit(p).alias("confidence"))
    words = [(code, title, word) for code, title, keywords in rules for word in keywords]
    known = F.array(*[entry(code, title, word, 0.9) for code, title, word in words])
    return F.coalesce(F.get(known, first_contained(name, [word for _, _, word in words])), entry(*OTHER, None, 0.3))


def shelf_life(df: DataFrame, category_code: str, storage: str, as_of: str) -> DataFrame:
    """base_days, estimated_by, needs_review and the date, from as_of on."""
    code, kind = F.upper(F.coalesce(F.col(category_code), F.lit(""))), F.upper(F.coalesce(F.col(storage), F.lit("")))
    by_kind = lambda days: F.create_map(*[x for s, n in zip(STORAGES, days, strict=True) for x in (F.lit(s), F.lit(n))])
    table = F.create_map(*[x for c, days in DAYS.items() for x in (F.lit(c), by_kind(days))])
    mine, alone = F.try_element_at(table, code), F.try_element_at(by_kind(STORAGE_ALONE), kind)
    days = F.when(mine.isNotNull(), F.coalesce(F.try_element_at(mine, kind), F.try_element_at(mine, F.lit("REFRIGERATED")))).otherwise(F.coalesce(alone, F.lit(NEITHER)))
    by = F.when(mine.isNotNull(), "rule:category+storage").when(alone.isNotNull(), "rule:storage_only").otherwise("rule:default")
    return df.withColumns({"base_days": days, "estimated_by": by, "needs_review": mine.isNull()}).withColumn("estimated_date", F.date_add(F.lit(as_of).cast("date"), F.col("base_days")))


def is_optional(c: str | Column) -> Column:
    """whether the name holds a word of what can be left out."""
    return F.exists(F.array(*map(F.lit, OPTIONAL)), lambda k: F.contains(col(c), k))


def owned_substitute(missing: str | Column, owned: str | Column) -> Column:
    """the first substitute in order of the rules that is at hand, else null."""
    rules = F.create_map(*[x for name, subs in SUBSTITUTES.items() for x in (F.lit(name), F.array(*map(F.lit, subs)))])
    return F.get(F.filter(F.try_element_at(rules, col(missing)), lambda s: F.array_contains(col(owned), s)), F.lit(0))


def decide_substitutions(requests: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """Requests (request_id, owned, missing arrays) to one decision for each missing ingredient.

    supplied (request_id, missing, decision, substitute): decisions to check; what they leave out is REQUIRED.
    """
    rows = requests.select("request_id", "owned", F.explode("missing").alias("missing"))
    if supplied is None:
        substitute = owned_substitute("missing", "owned")
        decision = F.when(substitute.isNotNull(), "SUBSTITUTE_AVAILABLE").when(is_optional("missing"), "OPTIONAL").otherwise("REQUIRED")
        return rows.select("request_id", "missing", decision.alias("decision"), substitute.alias("substitute"))
    found = rows.join(supplied, ["request_id", "missing"], "left")
    offered = F.col("decision") == "SUBSTITUTE_AVAILABLE"
    usable = offered & F.coalesce(F.array_contains("owned", F.col("substitute")), F.lit(False))
    decision = F.when(usable | (F.col("decision") == "OPTIONAL"), F.col("decision")).otherwise("REQUIRED")
    return found.select("request_id", "missing", decision.alias("decision"), F.when(usable, F.col("substitute")).alias("substitute"))


def recipe_tags(recipes: DataFrame, recipe_id: str, title: str, answer: str) -> DataFrame:
    """Valid tags of a model's answer; a confidence that is no number empties a recipe's list."""
    kind = "struct<tags:array<struct<tagType:string,tagCode:string,confidence:string>>>"
    parsed = recipes.select(F.col(recipe_id), F.coalesce(title, F.lit("")).alias("_title"), F.from_json(braced_json(answer), kind)["tags"].alias("_tags"))
    bad = F.exists("_tags", lambda t: t["confidence"].isNotNull() & t["confidence"].try_cast("double").isNull())
    tags = parsed.filter(~F.coalesce(bad, F.lit(False))).select(recipe_id, "_title", F.explode("_tags").alias("t"))
    tags = tags.select(recipe_id, "_title", F.upper("t.tagType").alias("tag_type"), F.upper("t.tagCode").alias("tag_code"), F.round(F.coalesce(F.col("t.confidence").try_cast("double"), F.lit(0.7)), 4).alias("confidence"))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(F.col("_title"), k))
    soup = (F.col("tag_code") != "SOUP") | (holds(SOUP_WORDS) & ~holds(NO_SOUP_WORDS))
    valid = ((F.col("tag_type") == "COOKING_TYPE") & F.col("tag_code").isin(COOKING_TAGS) & soup) | ((F.col("tag_type") == "STYLE") & F.col("tag_code").isin(STYLE_TAGS))
    return tags.filter(valid).select(recipe_id, "tag_type", "tag_code", "confidence", F.lit("LLM").alias("source_type"))


def categories(spark: SparkSession) -> DataFrame:
    """The keyword table as rows."""
    return spark.createDataFrame([(code, title, word) for code, title, words in CATEGORIES for word in words], "code string, name string, keyword string")
