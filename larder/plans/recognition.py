"""Queries of names, answers of models, recognition decisions and titles; parts stand for ingredients, images and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import ingredients, text
from larder.operators import candidates, classify, datasets, jobs, nutrition, ocr, recognition
from larder.operators.snapshots import spread
from larder.plans.base import query, table

s = lambda n: F.col(n).cast("string")


def _part(spark, d):
    return table(spark, d, "part")


def by(n: int, *values):
    """One of n values by the size of a part."""
    out = F.when(F.lit(False), values[0])
    for k, v in enumerate(values[:-1]):
        out = out.when(F.col("p_size") % n == k, v)
    return out.otherwise(values[-1])


@query("f07", "SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN NULL ELSE replace(p_name, ' ', '') END AS name FROM part")
def f07(spark, d):
    raw = by(5, F.concat(F.lit(" 굵은 "), "p_name"), F.concat("p_name", F.lit("\n물기짠 것")), F.concat(F.lit("깐"), "p_name", F.lit(" 데친 것")), F.concat(F.lit("꽃꽃"), "p_name", F.lit("　\r3")), F.lit(" \n x"))
    return ingredients.normalized(_part(spark, d).withColumn("raw", raw), "raw", "name").select("p_partkey", "name")


@query("f09", "SELECT p_partkey, p_name || 'y' AS name FROM part")
def f09(spark, d):
    return _part(spark, d).select("p_partkey", text.without_parentheses(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")（"), "p_type", F.lit("）y"))).alias("name"))


@query("f10", "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN '대파' ELSE p_name END AS name FROM part")
def f10(spark, d):
    raw = by(4, F.concat(F.lit("다진 "), "p_name"), F.concat("p_name", F.lit(" 중간 사이즈 (소)")), F.concat(F.lit("시원한 다진 "), "p_name", F.lit(" 줄기")), F.lit("대파흰부분"))
    return spread(_part(spark, d), "p_partkey").select("p_partkey", ingredients.visual_base(raw).alias("name"))


@query("f11", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || '|다진 ' || p_brand || '|' || p_brand WHEN 1 THEN p_name || '|' || p_type ELSE p_name END AS phrases FROM part""")
def f11(spark, d):
    raw = by(3, F.concat("p_name", F.lit(" 또는 다진 "), "p_brand"), F.concat("p_name", F.lit(", "), "p_type", F.lit(" , ")), F.col("p_name"))
    return spread(_part(spark, d), "p_partkey").select("p_partkey", F.array_join(ingredients.phrases(raw), "|").alias("phrases"))


def _seed(spark, d):
    """English terms of each type, some twice in another case."""
    terms = F.array("p_type", F.concat(F.lower("p_type"), F.lit(" ")), F.concat(F.lit("raw "), "p_type"), F.lit(" "))
    return _part(spark, d).select(F.col("p_type").alias("name")).distinct().withColumn("p_type", F.col("name")).select("name", terms.alias("terms"))


@query("f12", "SELECT p_partkey, p_type || '|raw ' || p_type AS terms FROM part WHERE p_size % 2 = 0")
def f12(spark, d):
    names = _part(spark, d).select("p_partkey", F.array("p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("none")).alias("names"))
    return jobs.search_terms(names, "p_partkey", "names", _seed(spark, d)).select("p_partkey", F.array_join("terms", "|").alias("terms"))


@query("f20", "SELECT p_partkey, '{\"a\": \"' || p_name || '\"}' AS body, p_name AS a FROM part")
def f20(spark, d):
    body = F.concat(F.lit('{"a": "'), F.col("p_name"), F.lit('"}'))
    raw = by(3, F.concat(F.lit(" ```json\n"), body, F.lit("\n```\n")), F.concat(F.lit("```"), body, F.lit("```")), body)
    found = text.fenced_json(raw)
    return _part(spark, d).select("p_partkey", found.alias("body"), F.get_json_object(found, "$.a").alias("a"))


@query("f21", "SELECT p_partkey, CASE WHEN p_size % 3 <> 2 THEN '{\"a\": {\"b\": \"' || p_name || '\"}}' END AS body FROM part")
def f21(spark, d):
    body = F.concat(F.lit('{"a": {"b": "'), F.col("p_name"), F.lit('"}}'))
    return _part(spark, d).select("p_partkey", text.braced_json(by(3, F.concat(F.lit("Here:\n"), body, F.lit("\nDone")), body, F.lit("} none {"))).alias("body"))


@query("f22", """
SELECT p_partkey, CAST(0 AS BIGINT) AS place, p_name AS display_name, p_name AS normalized_name, p_type AS category, p_size / 50.0 AS confidence, p_partkey AS ingredient_id FROM part WHERE p_size % 5 = 0
UNION ALL SELECT p_partkey, 0, p_name, p_name, 'given', 0.0, NULL FROM part WHERE p_size % 5 IN (1, 2) UNION ALL SELECT p_partkey, 1, p_brand, p_brand, 'given', 0.0, NULL FROM part WHERE p_size % 5 = 1
UNION ALL SELECT p_partkey, 0, p_name, p_brand, 'given', 0.0, NULL FROM part WHERE p_size % 5 = 3""")
def f22(spark, d):
    whole = F.to_json(F.struct(F.col("p_name").alias("displayName"), (F.col("p_size") / 50.0).alias("score"), F.col("p_type").alias("category"), F.col("p_partkey").alias("ingredientId")))
    partly = F.to_json(F.array(F.struct(F.lit("").alias("name"), F.col("p_name").alias("rawName"), F.col("p_brand").alias("normalized"), F.lit("bad").alias("confidence"))))
    answer = by(5, whole, F.to_json(F.array("p_name", "p_brand")), F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), partly, F.lit(None).cast("string"))
    rows = _part(spark, d).select("p_partkey", F.posexplode(candidates.contract(answer, "given")).alias("place", "c"))
    return rows.select("p_partkey", F.col("place").cast("long").alias("place"), "c.*")


@query("f25", "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 4) AS value FROM lineitem")
def f25(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.rounded(F.ln("l_extendedprice")).alias("value"))


@query("f26", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN -1.0 WHEN 2 THEN CAST(p_size AS DOUBLE) ELSE -1.0 END AS value FROM part")
def f26(spark, d):
    return _part(spark, d).select("p_partkey", text.number_or(by(4, s("p_retailprice"), s("p_name"), F.concat(F.lit(" "), s("p_size"), F.lit(" ")), F.lit(None).cast("string")), -1.0).alias("value"))


DISTANCE = """
abs({c} - {tc}) * 1 + abs({b} - {tb}) * 4 + abs({p} - {tp}) * 4 + abs({f} - {tf}) * 9 + abs({u} - {tu}) * 4 + abs({s} - {ts}) * 0.1 + abs({h} - {th}) * 0.1"""
NUTRIENTS = {"calories": "p_size * 10.0", "carbs": "p_size * 2.0", "protein": "p_size * 1.0", "fat": "p_size * 0.5", "sugar": "p_size * 0.25", "sodium": "p_size * 12.0", "cholesterol": "p_size * 1.5"}


def _distance_sql(targets: dict[str, float]) -> str:
    letters = dict(zip("cbpfush", NUTRIENTS, strict=True))
    less = {n: max(0.0, targets[n] - nutrition.RICE[n]) for n in NUTRIENTS}
    return DISTANCE.format(**{k: NUTRIENTS[n] for k, n in letters.items()}, **{f"t{k}": less[n] for k, n in letters.items()})


def _distance(targets):
    return nutrition.distance({n: F.expr(x) for n, x in NUTRIENTS.items()}, {n: F.lit(targets.get(n)).cast("double") for n in NUTRIENTS})


@query("f29", f"SELECT p_partkey, CAST(round({_distance_sql(nutrition.MEALS['lunch'])}, 6) AS DOUBLE) AS distance FROM part")
def f29(spark, d):
    return _part(spark, d).select("p_partkey", F.round(_distance(nutrition.MEALS["lunch"]), 6).alias("distance"))


@query("f30", f"SELECT p_partkey, CAST(round({_distance_sql(nutrition.DEFAULTS)}, 6) AS DOUBLE) AS distance FROM part")
def f30(spark, d):
    return _part(spark, d).select("p_partkey", F.round(_distance({}), 6).alias("distance"))


@query("f31", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type ELSE 'unknown' END AS route, CASE WHEN p_size % 4 IN (0, 1) THEN p_size / 50.0 ELSE 0.0 END AS confidence,
  CASE p_size % 4 WHEN 0 THEN false WHEN 1 THEN p_size > 25 ELSE true END AS needs_review, CASE WHEN p_size % 4 IN (0, 1) THEN p_name END AS reason, CASE WHEN p_size % 4 IN (0, 1) THEN CAST(0.5 AS DOUBLE) END AS p_a FROM part""")
def f31(spark, d):
    odds = F.create_map(F.lit("a"), F.lit(0.5)).alias("probabilities")
    share = (F.col("p_size") / 50.0).alias("confidence")
    nested = F.to_json(F.struct(F.struct(F.col("p_type").alias("type"), share, F.lit(False).alias("needsReview"), F.col("p_name").alias("reason"), odds).alias("route")))
    flat = F.to_json(F.struct(F.col("p_type").alias("route"), share, (F.col("p_size") > 25).alias("needs_user_confirmation"), F.col("p_name").alias("reason"), odds))
    rows = _part(spark, d).select("p_partkey", candidates.route_fields(by(4, nested, flat, F.lit("{}"), F.lit("no json"))).alias("r"))
    return rows.select("p_partkey", "r.route", "r.confidence", "r.needs_review", "r.reason", F.try_element_at("r.probabilities", F.lit("a")).alias("p_a"))


@query("f32", """
SELECT p_partkey, CASE WHEN greatest(x, y) < 0.45 THEN 'unknown' WHEN x > y THEN 'raw_ingredient' ELSE 'packaged_food' END AS route, greatest(x, y, 0.45) AS confidence, greatest(x, y) < 0.6 AS needs_review
FROM (SELECT p_partkey, p_size / 60.0 AS x, (50.5 - p_size) / 60.0 AS y FROM part)""")
def f32(spark, d):
    odds = F.create_map(F.lit(" Raw-Ingredient"), F.expr("p_size / 60.0D"), F.lit("PACKAGED food"), F.expr("(50.5D - p_size) / 60.0D"), F.lit("other"), F.lit(0.45))
    return _part(spark, d).select("p_partkey", recognition.route(odds).alias("r")).select("p_partkey", "r.*")


@query("f33", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '밀가루' WHEN 1 THEN CASE WHEN p_size > 25 THEN '올리고당' ELSE '꿀' END END AS substitute FROM part""")
def f33(spark, d):
    owned = F.when(F.col("p_size") > 25, F.array(F.lit("꿀"), F.lit("올리고당"), F.lit("밀가루"))).otherwise(F.array(F.lit("꿀"), F.lit("밀가루")))
    return _part(spark, d).select("p_partkey", classify.owned_substitute(by(4, F.lit("부침가루"), F.lit("설탕"), F.lit("소금"), F.col("p_name")), owned).alias("substitute"))


@query("f35", """
SELECT p_partkey, CASE WHEN p_size % 5 = 1 THEN 'STYLE' ELSE 'COOKING_TYPE' END AS tag_type, CASE WHEN p_size % 5 = 1 THEN 'SPICY' ELSE 'SOUP' END AS tag_code, CASE WHEN p_size % 5 = 1 THEN 0.7 ELSE round(p_size / 70.0, 4) END AS confidence
FROM part WHERE p_size % 5 = 1 OR (p_size % 5 = 0 AND p_size % 2 = 0)""")
def f35(spark, d):
    tag = lambda kind, code, p: F.struct(F.lit(kind).alias("tagType"), F.lit(code).alias("tagCode"), p.cast("string").alias("confidence"))
    share = F.expr("p_size / 70.0D")
    tags = by(5, F.array(tag("cooking_type", "soup", share), tag("x", "SOUP", share)), F.array(tag("STYLE", "spicy", F.lit(None)), tag("STYLE", "UNKNOWN", share)), F.array(tag("STYLE", "SOUP", share)), F.array(tag("STYLE", "SWEET", F.lit("bad"))), F.array(tag("COOKING_TYPE", "SWEET", share)))
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_name"), F.lit(" 된장국"))).otherwise(F.concat(F.col("p_name"), F.lit(" 국수")))
    recipes = _part(spark, d).select("p_partkey", title.alias("title"), F.concat(F.lit("answer: "), F.to_json(F.struct(tags.alias("tags")))).alias("answer"))
    return classify.recipe_tags(recipes, "p_partkey", "title", "answer").drop("source_type")


STAGED = """
SELECT p_partkey, CASE route WHEN 'packaged_food' THEN CASE WHEN NOT o AND r AND top >= 0.45 THEN 'raw_ingredient_classifier_override' ELSE 'packaged_food_ocr' END
    WHEN 'raw_ingredient' THEN CASE WHEN (NOT r OR top <= 0.93 OR top - second <= 0.20) AND o THEN 'packaged_food_ocr_fallback_from_raw' ELSE 'raw_ingredient_classifier' END
    ELSE CASE WHEN NOT m THEN 'unsupported_route' WHEN top <= 0.97 AND o THEN 'packaged_food_ocr_fallback_from_direct_master' ELSE 'yolo_master_topk' END END AS stage, route AS asked, o, r, m, top, second, p_name
FROM (SELECT p_partkey, p_name, p_size % 2 = 0 AS o, p_size % 3 <> 0 AS r, p_size % 7 <> 0 AS m, p_size / 50.0 AS top, p_size / 50.0 * CASE WHEN p_size % 4 = 0 THEN 0.5 ELSE 0.9 END AS second,
  CASE CAST(p_retailprice * 10 AS BIGINT) % 4 WHEN 0 THEN 'packaged_food' WHEN 1 THEN 'raw_ingredient' WHEN 2 THEN 'direct_master' ELSE 'unknown' END AS route FROM part)"""
FINAL = "CASE WHEN stage LIKE 'packaged%' THEN 'packaged_food' WHEN stage = 'unsupported_route' THEN asked ELSE 'raw_ingredient' END"


def _staged(spark, d):
    """Routes and candidates of three models for each part."""
    top = F.expr("p_size / 50.0D")
    one = lambda name, p: F.struct(F.lit(name).alias("display_name"), F.col("p_name").alias("normalized_name"), F.lit("c").alias("category"), p.cast("double").alias("confidence"), F.lit(None).cast("long").alias("ingredient_id"), (F.col("p_size") % 5 == 0).alias("uncertain"))
    second = top * F.when(F.col("p_size") % 4 == 0, 0.5).otherwise(0.9)
    raw = F.array(one("raw1", top), one("raw2", second))
    none = F.filter(raw, lambda x: F.lit(False))
    route = F.element_at(F.array(*map(F.lit, ("packaged_food", "raw_ingredient", "direct_master", "unknown"))), ((F.col("p_retailprice") * 10).cast("long") % 4 + 1).cast("int"))
    return _part(spark, d).select(
        F.col("p_partkey").alias("image"), "p_size", route.alias("route"), F.when(F.col("p_size") % 2 == 0, F.array(one("ocr", F.lit(0.6)))).otherwise(none).alias("ocr"),
        F.when(F.col("p_size") % 3 != 0, raw).otherwise(none).alias("raw"), F.when(F.col("p_size") % 7 != 0, F.array(one("direct", top))).otherwise(none).alias("direct"),
    )


@query("f38", f"SELECT p_partkey AS image, stage, {FINAL} AS route FROM ({STAGED})")
def f38(spark, d):
    rows = _staged(spark, d).select("image", candidates.stage("route", "ocr", "raw", "direct").alias("s"))
    return rows.select("image", "s.stage", "s.route")


CHOSEN = f"""
SELECT *, {FINAL} AS route, CASE WHEN stage LIKE 'packaged%' THEN CASE WHEN o THEN 1 ELSE 0 END WHEN stage LIKE 'raw%' THEN CASE WHEN r THEN 2 ELSE 0 END WHEN m THEN 1 ELSE 0 END AS n,
  CASE WHEN stage LIKE 'packaged%' THEN 0.6 ELSE top END AS best FROM ({STAGED})"""


@query("c11", f"""
SELECT image, stage, route, n, first, needs_review, score, signals, CASE WHEN score >= 0.55 AND signals = '' THEN 'OK' WHEN score >= 0.3 OR (NOT needs_review AND n > 0) THEN 'SUSPICIOUS' ELSE 'NEEDS_REVIEW' END AS status FROM (
  SELECT p_partkey AS image, stage, c.route, n, CASE WHEN n = 0 THEN NULL WHEN stage LIKE 'packaged%' THEN 'ocr' WHEN stage LIKE 'raw%' THEN 'raw1' ELSE 'direct' END AS first, review AS needs_review,
    round((CASE WHEN review THEN 0.55 ELSE 1.0 END) * (CASE WHEN n > 0 THEN greatest(0.15, least(1.0, best)) ELSE 0.25 END) * greatest(0.25, least(1.0, rc)), 4) AS score,
    concat_ws(',', CASE WHEN n > 0 AND best < 0.35 THEN 'LOW_TOP1_CONFIDENCE' END, CASE WHEN rr THEN 'ROUTE_NEEDS_REVIEW' END, CASE WHEN rc < 0.5 THEN 'LOW_ROUTE_CONFIDENCE' END, CASE WHEN n = 0 THEN 'NO_CANDIDATES' END,
      CASE WHEN stage = 'unsupported_route' THEN 'PIPELINE_UNCERTAIN' END) AS signals
  FROM (SELECT c.*, p_size / 60.0 AS rc, p_size > 40 AS rr, p_size > 40 OR n = 0 OR p_size % 5 = 0 AS review FROM ({CHOSEN}) c JOIN part USING (p_partkey)) c)""")
def c11(spark, d):
    rows = _staged(spark, d)
    answer = F.to_json(F.struct(F.col("route"), F.expr("p_size / 60.0D").alias("confidence"), (F.col("p_size") > 40).alias("needs_user_confirmation")))
    models = [rows.select("image", F.col(m).alias("candidates")) for m in ("direct", "raw", "ocr")]
    found = candidates.recognize(rows.select("image", answer.alias("answer")), *models)
    return found.select("image", "stage", "route", F.size("candidates").cast("long").alias("n"), F.get("candidates", F.lit(0))["display_name"].alias("first"), "needs_review", "anomaly.score", F.array_join("anomaly.signals", ",").alias("signals"), "anomaly.status")


@query("f36", """
SELECT p_partkey, round((CASE WHEN p_size > 30 THEN 0.55 ELSE 1.0 END) * (CASE WHEN p_size % 3 > 0 THEN greatest(0.15, p_size / 50.0) ELSE 0.25 END) * greatest(0.25, (51 - p_size) / 50.0), 4) AS score,
  concat_ws(',', CASE WHEN p_size % 3 > 0 AND p_size / 50.0 < 0.35 THEN 'LOW_TOP1_CONFIDENCE' END, CASE WHEN p_size % 2 = 0 THEN 'ROUTE_NEEDS_REVIEW' END, CASE WHEN (51 - p_size) / 50.0 < 0.5 THEN 'LOW_ROUTE_CONFIDENCE' END,
    CASE WHEN p_size % 3 = 0 THEN 'NO_CANDIDATES' END, CASE WHEN p_size % 11 = 0 THEN 'PIPELINE_UNCERTAIN' END) AS signals FROM part""")
def f36(spark, d):
    stage = F.when(F.col("p_size") % 11 == 0, "route_review_required").otherwise("yolo_master_topk")
    judged = recognition.anomaly(F.expr("(51 - p_size) / 50.0D"), F.col("p_size") % 2 == 0, F.expr("p_size / 50.0D"), F.col("p_size") % 3, stage, F.col("p_size") > 30)
    return _part(spark, d).select("p_partkey", judged.alias("a")).select("p_partkey", "a.score", F.array_join("a.signals", ",").alias("signals"))


@query("f39", """
SELECT p_partkey, CASE WHEN 0.8 * p_size / 50.0 + 0.2 * 0.1 >= CASE WHEN p_size % 2 = 0 THEN 0.8 * 0.5 + 0.2 * 0.9 ELSE -0.8 + 0.2 * 0.9 END THEN 'a' ELSE 'b' END AS first FROM part WHERE 0.8 * p_size / 50.0 + 0.02 <> 0.58""")
def f39(spark, d):
    one = lambda name, p: F.struct(F.lit(name).alias("name"), F.lit(p).alias("confidence"))
    known = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("a"), F.expr("p_size / 50.0D"), F.lit("b"), F.lit(0.5))).otherwise(F.create_map(F.lit("a"), F.expr("p_size / 50.0D")))
    ranked = recognition.reranked(F.array(one("a", 0.1), one("b", 0.9)), known)
    return _part(spark, d).filter("0.8D * p_size / 50.0D + 0.02D <> 0.58D").select("p_partkey", ranked[0]["name"].alias("first"))


@query("t09", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'a,b,c' WHEN p_size = 25 THEN 'a,b,c' ELSE 'b,a,c' END AS names FROM part")
def t09(spark, d):
    one = lambda name, p: F.struct(F.lit(name).alias("name"), p.cast("double").alias("confidence"))
    ranked = recognition.by_confidence(F.array(one("a", F.expr("p_size / 50.0D")), one("b", F.lit(0.5)), one("c", F.lit(None))))
    return _part(spark, d).select("p_partkey", F.array_join(F.transform(ranked, lambda x: x["name"]), ",").alias("names"))


@query("a12", """
SELECT a.vec_id, round(list_sum(CASE WHEN b.vec_id IS NULL THEN list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) ELSE list_transform(list_zip(a.embedding, b.embedding), lambda x: (CAST(x[1] AS DOUBLE) + CAST(x[2] AS DOUBLE)) * 0.5) END), 4) AS total
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + a.label + 1""")
def a12(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    both = e.join(e.select(F.col("vec_id").alias("other"), F.col("p").alias("q")), F.col("other") == F.col("vec_id") + F.col("label") + 1, "left").withColumn("q", F.coalesce("q", F.array().cast("array<double>")))
    mean = recognition.averaged("p", "q")
    return both.select("vec_id", F.round(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("f40", """
WITH m AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name), l AS (SELECT p_partkey, 'ing_' || p_partkey AS label, p_size, p_name, p_type, p_brand, CASE WHEN p_size > 40 THEN k END AS moved FROM part JOIN m USING (p_name))
SELECT a.p_partkey AS image, a.label, coalesce(b.p_name, a.label) AS display_name, coalesce(b.p_type, a.label) AS normalized_name, b.p_brand AS category, b.p_partkey AS ingredient_id,
  CASE WHEN a.moved IS NOT NULL THEN 'ing_' || lpad(CAST(a.moved AS VARCHAR), 5, '0') END AS resolved
FROM l a LEFT JOIN l b ON b.p_partkey = coalesce(a.moved, a.p_partkey) AND b.p_size % 2 = 0""")
def f40(spark, d):
    part = _part(spark, d)
    key = lambda c: text.class_key(F.concat(F.lit("ing_"), F.col(c).cast("string")))
    smallest = part.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    remap = part.filter("p_size > 40").join(smallest, "p_name").select(key("p_partkey").alias("old"), key("k").alias("new"))
    labels = part.filter("p_size % 2 = 0").select(key("p_partkey").alias("key"), F.col("p_name").alias("display_name"), F.col("p_type").alias("normalized_name"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("ingredient_id"))
    top = part.select(F.col("p_partkey").alias("image"), F.lit(1).alias("place"), F.concat(F.lit("ing_"), s("p_partkey")).alias("label"), F.lit(0.5).alias("p"))
    vocabulary = part.select(F.col("p_name").alias("name")).distinct()
    return candidates.resolved_labels(top, labels, remap, vocabulary).drop("place", "p")


@query("f41", """
SELECT p_partkey AS key, CASE WHEN p_size < 5 THEN 'borderline' WHEN p_size % 3 = 0 OR p_size = 7 THEN 'proposed' END AS proposal FROM part""")
def f41(spark, d):
    part = _part(spark, d)
    labels = part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 3 == 0, "소스").otherwise(F.col("p_type")).alias("category"))
    return candidates.packaged_proposal(labels, part.filter("p_size = 7").select(F.col("p_partkey").alias("key")), part.filter("p_size < 5").select(F.col("p_partkey").alias("key"))).select("key", "proposal")


def _paths(spark, d):
    """A path of folders for each part, and what some folders stand for."""
    part = _part(spark, d)
    files = part.select("p_partkey", F.concat_ws("/", F.lit("root"), F.upper("p_name"), "p_brand", F.concat(s("p_partkey"), F.lit(".jpg"))).alias("path"))
    names = part.filter("p_size = 1").select(text.label("p_name").alias("folder")).distinct().withColumn("value", F.concat(F.lit("name "), "folder"))
    brands = part.filter("p_brand like '%1'").select(text.label("p_brand").alias("folder")).distinct().withColumn("value", F.concat(F.lit("brand "), "folder"))
    return files, names.unionByName(brands)


ROUTED = """
SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'brand ' || lower(p_brand) WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 1) THEN 'name ' || replace(p_name, ' ', '_') END AS value FROM part"""


@query("j13", ROUTED)
def j13(spark, d):
    files, mapping = _paths(spark, d)
    return candidates.source_class(files, "path", mapping).select("p_partkey", "value")


@query("f42", f"SELECT p_partkey, value AS route_class FROM ({ROUTED}) WHERE value IS NOT NULL")
def f42(spark, d):
    files, mapping = _paths(spark, d)
    return candidates.route_classes(files, "path", mapping).select("p_partkey", "route_class")


@query("j06", """
SELECT p_partkey AS image, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS display_name, CASE WHEN p_size % 2 = 0 THEN p_type WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS normalized_name,
  CASE WHEN p_size % 2 = 0 THEN p_partkey WHEN p_size % 3 = 0 THEN nullif(p_partkey % 4, 0) END AS ingredient_id FROM part""")
def j06(spark, d):
    part = _part(spark, d)
    name = F.when((F.col("p_size") % 2 == 0) | (F.col("p_size") % 3 == 0), s("p_partkey")).otherwise(F.col("p_brand"))
    classes = part.select(F.col("p_partkey").alias("image"), name.alias("class"), F.lit(1.0).alias("p"))
    labels = part.filter("p_size % 2 = 0").select(s("p_partkey").alias("key"), F.col("p_name").alias("display_name"), F.col("p_type").alias("normalized_name"), F.col("p_partkey").alias("ingredient_id"))
    reference = part.filter("p_size % 3 = 0").select(s("p_partkey").alias("key"), F.col("p_type").alias("display_name"), F.lit("").alias("normalized_name"), (F.col("p_partkey") % 4).alias("ingredient_id"))
    return candidates.named_classes(classes, labels, reference).select("image", "display_name", "normalized_name", "ingredient_id")


@query("j16", "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand WHEN p_size > 20 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_size > 40 THEN NULL WHEN p_size > 20 THEN NULL ELSE p_type END AS extra FROM part")
def j16(spark, d):
    part = _part(spark, d)
    layers = [part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("extra")), part.filter("p_size > 20").select("p_partkey", F.upper("p_name").alias("name")), part.filter("p_size > 40").select("p_partkey", F.col("p_brand").alias("name"))]
    return candidates.overlay(layers, "p_partkey")


@query("j17", """
WITH e AS (SELECT DISTINCT p_partkey AS class, unnest([p_name, p_brand, p_type]) AS name FROM part), o AS (SELECT name, min(class) AS owner FROM e GROUP BY name) SELECT name, class, class <> owner AS clash FROM e JOIN o USING (name)""")
def j17(spark, d):
    part = _part(spark, d).withColumns({"again": F.concat(F.lit(" "), "p_name"), "blank": F.lit(" ")})
    return candidates.claimed_names(part, "p_partkey", ["p_name", "p_brand", "p_type", "again", "blank"])


@query("f45", "SELECT p_partkey, p_size % 3 <> 0 AS found FROM part")
def f45(spark, d):
    return _part(spark, d).select("p_partkey", ocr.has_product_word(by(3, F.col("p_name"), F.concat(F.col("p_name"), F.lit("된장")), F.concat(F.lit("맛 두부"), s("p_size")))).alias("found"))


def _box():
    n = lambda x: F.expr(x).cast("double")
    four = F.array(F.array(n("p_size"), n("p_size * 2"), n("p_size * 4"), n("p_size * 5")))
    corner = lambda x, y: F.array(n(x), n(y))
    return by(3, four, F.array(corner("p_size", "p_size * 2"), corner("p_size * 4", "p_size * 2"), corner("p_size * 4", "p_size * 5"), corner("p_size", "p_size * 5")), F.lit(None).cast("array<array<double>>"))


@query("f47", """
SELECT p_partkey, CASE WHEN p_size % 3 <> 2 THEN CAST(p_size AS DOUBLE) END AS x1, CASE WHEN p_size % 3 <> 2 THEN CAST(p_size * 2 AS DOUBLE) END AS y1, CASE WHEN p_size % 3 <> 2 THEN CAST(p_size * 4 AS DOUBLE) END AS x2, CASE WHEN p_size % 3 <> 2 THEN CAST(p_size * 5 AS DOUBLE) END AS y2 FROM part""")
def f47(spark, d):
    return _part(spark, d).select("p_partkey", ocr.box_edges(_box()).alias("e")).select("p_partkey", "e.*")


@query("f48", """
SELECT p_partkey, CAST(round(CASE WHEN t = '' THEN 0.0 ELSE 0.5 + CASE WHEN p_size % 5 IN (1, 2) THEN 0.65 ELSE 0.0 END - CASE WHEN p_size % 5 = 3 THEN 0.75 ELSE 0.0 END + CASE WHEN length(t) BETWEEN 2 AND 12 THEN 0.15 ELSE 0.0 END
  - CASE WHEN length(t) > 18 THEN 0.30 ELSE 0.0 END - CASE WHEN 1.0 - length(regexp_replace(t, '[^\\p{L}]', '', 'g')) / CAST(length(t) AS DOUBLE) > 0.55 THEN 0.45 ELSE 0.0 END
  + CASE WHEN boxed AND area > 0.01 THEN 0.20 ELSE 0.0 END + CASE WHEN boxed AND area > 0.03 THEN 0.35 ELSE 0.0 END - CASE WHEN boxed AND middle > 0.72 THEN 0.20 ELSE 0.0 END - CASE WHEN t = '우유' THEN 0.10 ELSE 0.0 END END, 6) AS DOUBLE) AS score
FROM (SELECT p_partkey, p_size, p_size % 3 <> 2 AS boxed, (p_size * 3.0) * (p_size * 3.0) / (300 * 300) AS area, (p_size * 2.0 + p_size * 5.0) / 2.0 / 300 AS middle,
  CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '우유' WHEN 2 THEN '서울 두부 ' || repeat('맛', p_size % 20) WHEN 3 THEN '보관 ' || repeat('!', p_size % 9) ELSE '가나 ' || repeat('·', p_size % 7) END AS t FROM (SELECT * FROM part)) WHERE true""".replace("'서울 두부 ' || repeat('맛', p_size % 20)", "trim('서울 두부 ' || repeat('맛', p_size % 20))").replace("'보관 ' || repeat('!', p_size % 9)", "trim('보관 ' || repeat('!', p_size % 9))").replace("'가나 ' || repeat('·', p_size % 7)", "trim('가나 ' || repeat('·', p_size % 7))"))
def f48(spark, d):
    size = lambda n: (F.col("p_size") % n).cast("int")
    line = by(5, F.lit(" \n"), F.lit("우유"), F.concat(F.lit(" 서울  두부 "), F.repeat(F.lit("맛"), size(20))), F.concat(F.lit("보관 "), F.repeat(F.lit("!"), size(9))), F.concat(F.lit("가나\t"), F.repeat(F.lit("·"), size(7))))
    return _part(spark, d).select("p_partkey", F.round(ocr.title_score(line, F.lit(0.5), _box(), F.lit(300), F.lit(300)), 6).alias("score"))


@query("f50", """
SELECT p_partkey, CAST(0 AS BIGINT) AS line_no, p_name AS text, p_size / 50.0 AS confidence, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS x1 FROM part WHERE p_size % 4 < 3
UNION ALL SELECT p_partkey, 1, p_type, 0.0, NULL FROM part WHERE p_size % 4 < 2 UNION ALL SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN 2 ELSE 0 END, p_brand, 0.5, CASE WHEN p_size % 4 IN (0, 2) THEN 1.0 END FROM part WHERE p_size % 4 IN (0, 3)""")
def f50(spark, d):
    texts = F.array(F.concat(F.lit(" "), F.col("p_name")), F.lit(" "), F.concat(F.col("p_type"), F.lit("\n")))
    x = F.col("p_size").cast("double")
    boxes = F.when(F.col("p_size") % 2 == 0, F.array(F.array(x, x, x, x)))
    many = F.struct(texts.alias("rec_texts"), F.array((F.col("p_size") / 50.0).cast("string"), F.lit("0.1"), F.lit("bad")).alias("rec_scores"), boxes.alias("rec_boxes"))
    single = F.struct(F.col("p_brand").alias("rec_text"), F.lit(0.5).alias("rec_score"), F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(5.0)), F.array(F.lit(1.0), F.lit(5.0))).alias("rec_poly"))
    both = F.struct(*[many[c].alias(c) for c in ("rec_texts", "rec_scores", "rec_boxes")], single["rec_text"].alias("rec_text"), single["rec_score"].alias("rec_score"), single["rec_poly"].alias("rec_poly"))
    short = F.struct(F.slice(texts, 1, 2).alias("rec_texts"), F.array(F.col("p_size") / 50.0).alias("rec_scores"), boxes.alias("rec_boxes"))
    answer = by(4, F.to_json(F.struct(both.alias("res"))), F.to_json(many), F.to_json(F.struct(short.alias("res"))), F.to_json(F.struct(F.col("p_brand").alias("rec_text"), F.lit(0.5).alias("rec_score"))))
    lines = ocr.flattened(spread(_part(spark, d), "p_partkey").select("p_partkey", answer.alias("answer")), "p_partkey", "answer")
    return lines.select("p_partkey", F.col("line_no").cast("long").alias("line_no"), "text", "confidence", ocr.box_edges("box")["x1"].alias("x1"))


TITLED = """
SELECT p_partkey AS image_id, CAST(0 AS BIGINT) AS place, b || ' ' || a AS text, CAST(0.85 AS DOUBLE) AS confidence, 'merged_product_title_lines' AS reason FROM t
UNION ALL SELECT p_partkey, 1, a, 0.9, 'single_product_title_line' FROM t UNION ALL SELECT p_partkey, 2, b, 0.8, 'single_product_title_line' FROM t"""


def _titles(spark, d):
    """Two lines for each image, the lower one the likelier, one of them twice, with noise beside."""
    one = lambda n, t, p, top: F.struct(F.lit(n).alias("line_no"), t.alias("text"), F.lit(p).alias("confidence"), F.array(F.array(F.lit(1.0), F.lit(top), F.lit(9.0), F.lit(top + 5))).alias("box"))
    a, b = (F.concat(F.lit(x), s("p_size")) for x in ("매일우유 ", "서울두부 "))
    lines = F.array(one(0, a, 0.9, 50.0), one(1, F.concat(F.lit(" "), b), 0.8, 10.0), one(2, a, 0.95, 5.0), one(3, F.lit("원재료 표시"), 0.5, 1.0), one(4, F.lit(" "), 0.9, 1.0))
    images = ocr.dealt_images(_part(spark, d).select(F.col("p_partkey").alias("image_id"), "p_size"), F.size(lines))
    rows = images.select("image_id", F.explode(lines).alias("l")).select("image_id", "l.*", F.lit(300).alias("width"), F.lit(300).alias("height"))
    return ocr.rank_titles(rows, dealt=True).withColumn("place", F.col("place").cast("long"))


@query("c12_titles", f"WITH t AS (SELECT p_partkey, '매일우유 ' || p_size AS a, '서울두부 ' || p_size AS b FROM part) {TITLED}")
def c12_titles(spark, d):
    return _titles(spark, d).withColumn("confidence", F.round("confidence", 6))


@query("f49", f"WITH t AS (SELECT p_partkey, '매일우유 ' || p_size AS a, '서울두부 ' || p_size AS b FROM part) SELECT image_id, text, count(*) AS n FROM ({TITLED}) WHERE place > 0 GROUP BY image_id, text")
def f49(spark, d):
    return _titles(spark, d).filter("place > 0").groupBy("image_id", "text").agg(F.count(F.lit(1)).alias("n"))


@query("f51", f"WITH t AS (SELECT p_partkey, '매일우유 ' || p_size AS a, '서울두부 ' || p_size AS b FROM part) SELECT image_id, text AS merged FROM ({TITLED}) WHERE place = 0")
def f51(spark, d):
    return _titles(spark, d).filter("place = 0").select("image_id", F.col("text").alias("merged"))


@query("t06", "SELECT p_partkey AS image_id, '서울두부 ' || p_size AS uppermost FROM part")
def t06(spark, d):
    return _titles(spark, d).filter("place = 0").select("image_id", F.concat_ws(" ", *[F.split_part("text", F.lit(" "), F.lit(k)) for k in (1, 2)]).alias("uppermost"))


@query("a13", "SELECT p_partkey AS image_id, CAST(0.85 AS DOUBLE) AS mean FROM part")
def a13(spark, d):
    return _titles(spark, d).filter("place = 0").select("image_id", F.round("confidence", 6).alias("mean"))


@query("c13", """
WITH f AS (SELECT p_partkey || '/' || p_size || '.png' AS path, p_size, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 1) THEN 'N ' || p_name WHEN p_name NOT LIKE 'red%' THEN 'P ' || split_part(p_name, ' ', 1) END AS name FROM part),
c AS (SELECT path, p_size, CASE WHEN name IS NULL THEN 'unmapped' WHEN name = 'P small' THEN 'no_master' END AS reason, CASE WHEN name <> 'P small' THEN 'cls ' || name END AS class FROM f)
SELECT path, class, CASE WHEN reason IS NULL THEN class || '/src__' || p_size || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.jpg' END AS file, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY reason, class, p_size ORDER BY path) - 1 AS k FROM c)""")
def c13(spark, d):
    part = _part(spark, d)
    files = part.select(F.concat(s("p_partkey"), F.lit("/"), s("p_size"), F.lit(".png")).alias("path"), F.col("p_name").alias("folder"))
    exact = part.filter("p_size = 1").select(F.col("p_name").alias("name")).distinct().withColumn("value", F.concat(F.lit("N "), "name"))
    words = part.filter("p_name not like 'red%'").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).distinct().withColumn("value", F.concat(F.lit("P "), "name"))
    labels = exact.unionByName(words).filter("value <> 'P small'").select(F.col("value").alias("name"), F.concat(F.lit("cls "), "value").alias("class"))
    return jobs.assembly_manifest(files, labels, exact, words, "src")


TEMPLATE = """
SELECT 'ing_' || id AS label, id, name, name AS phrases, CASE WHEN id % 2 = 0 THEN name || '|raw ' || name ELSE '' END AS terms FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS name FROM part WHERE p_size > 20)"""


def _template(spark, d):
    part = _part(spark, d)
    labels = part.select(F.concat(F.lit("ing_"), s("p_partkey")).alias("label"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("name"))
    counts = part.select(F.concat(F.lit("ing_"), s("p_partkey")).alias("label"), F.when(F.col("p_size") > 20, 0).otherwise(F.col("p_size")).alias("n"))
    return jobs.alias_template(labels, counts, _seed(spark, d))


@query("c17", TEMPLATE)
def c17(spark, d):
    return _template(spark, d).withColumns({"phrases": F.array_join("phrases", "|"), "terms": F.array_join("terms", "|")})


@query("c18", f"""
SELECT label, least(30, 60 - p_size) AS need, CASE WHEN terms = '' THEN '' ELSE list_aggregate(list_sort([name, name || ' fresh', 'raw ' || name, 'raw ' || name || ' fresh']), 'string_agg', '|') END AS queries
FROM ({TEMPLATE}) JOIN part ON p_partkey = id WHERE p_size < 45 AND p_size <> 33""")
def c18(spark, d):
    part = _part(spark, d)
    label = F.concat(F.lit("ing_"), s("p_partkey")).alias("label")
    plan = jobs.collection_plan(_template(spark, d).select("label", "terms"), part.select(label, F.col("p_size").alias("n")), part.filter("p_size = 33").select(label), [" fresh"], target=30, cap=60, seed=3, enough=45)
    return plan.withColumn("queries", F.array_join(F.sort_array("queries"), "|"))


MERGED = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY CAST(doc_id AS VARCHAR) || '.jpg', doc_id) AS k FROM documents WHERE lang IN ('en', 'fr', 'de')),
h AS (SELECT source, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'fr') AS n_fr FROM e WHERE k <= 12 GROUP BY source),
u AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars % 3, CAST(doc_id AS VARCHAR)) AS k FROM documents WHERE lang NOT IN ('en', 'fr', 'de')),
t AS (SELECT u.*, CASE WHEN u.k <= greatest(0, 12 - coalesce(n_en, 0)) THEN 'en' WHEN u.k <= greatest(0, 12 - coalesce(n_en, 0)) + greatest(0, 12 - coalesce(n_fr, 0)) THEN 'fr' ELSE 'overflow' END AS target FROM u LEFT JOIN h USING (source))
"""


def _merge(spark, d):
    docs = table(spark, d, "documents").select(s("doc_id").alias("path"), F.col("source").alias("class"), F.col("lang").alias("split"), F.concat(s("doc_id"), F.lit(".jpg")).alias("name"), "n_chars")
    uploads = docs.filter("split not in ('en', 'fr', 'de')").select("path", "class", F.lit("en").alias("split"), F.concat((F.col("n_chars") % 3).cast("string"), F.lit(".jpg")).alias("name"))
    return datasets.cap_and_merge(docs.filter("split in ('en', 'fr', 'de')").drop("n_chars"), uploads, ["en", "fr"], cap=12)


@query("c19", f"""{MERGED}
SELECT CAST(doc_id AS VARCHAR) AS path, source AS class, target, CASE WHEN target <> 'overflow' THEN 'team__' || (n_chars % 3) || CASE WHEN n > 1 THEN '_' || (n - 1) ELSE '' END || '.jpg' END AS file
FROM (SELECT *, row_number() OVER (PARTITION BY source, target, n_chars % 3 ORDER BY CAST(doc_id AS VARCHAR)) AS n FROM t)""")
def c19(spark, d):
    return _merge(spark, d)["merged"]


@query("c19_victims", f"{MERGED} SELECT CAST(doc_id AS VARCHAR) AS path, k AS place FROM e WHERE k > 12")
def c19_victims(spark, d):
    return _merge(spark, d)["victims"].select("path", F.col("place").cast("long").alias("place"))


@query("c11_classified", """
WITH e AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: abs(CAST(x AS DOUBLE))) AS p, CASE WHEN vec_id % 3 > 0 THEN list_transform(embedding[7:12], lambda x: abs(CAST(x AS DOUBLE))) END AS q FROM embeddings),
m AS (SELECT vec_id, CASE WHEN q IS NULL THEN p ELSE list_transform(list_zip(p, q), lambda z: (z[1] + z[2]) * 0.5) END AS a FROM e),
c AS (SELECT vec_id, i - 1 AS class, a[i] AS p, row_number() OVER (PARTITION BY vec_id ORDER BY a[i] DESC, i) AS k, list_reverse_sort(a) AS s FROM m, unnest(range(1, 7)) AS t(i)),
n AS (SELECT * FROM (VALUES (0, 'D1', 1), (1, 'D1', 1), (2, 'D3', 3), (3, 'ing_4', NULL), (4, 'D5', 5), (5, 'leek', NULL)) AS t(class, display_name, ingredient_id))
SELECT vec_id AS image, CAST(k - 1 AS INTEGER) AS place, display_name, CAST(ingredient_id AS BIGINT) AS ingredient_id, round(p, 6) AS confidence, s[1] - s[2] < 0.12 OR s[1] < 0.40 AS needs_review
FROM c JOIN n USING (class) WHERE k <= 3""")
def c11_classified(spark, d):
    """From the class probabilities of two passes to the final candidates: means (A12), the likeliest classes (T04), names (F40), doubt (W06), and recognition."""
    part = lambda at: F.transform(F.slice("embedding", at, 6), lambda x: F.abs(x.cast("double")))
    images = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), part(1).alias("p"), F.when(F.col("vec_id") % 3 > 0, part(7)).otherwise(F.array().cast("array<double>")).alias("flipped"))
    classes = spark.createDataFrame([(k, f"ing_{k + 1}" if k < 5 else "leek") for k in range(6)], "class int, label string")
    labels = spark.createDataFrame([(f"ing_0000{k}", f"D{k}", f"n{k}", "VEG", k) for k in (1, 3, 5)], "key string, display_name string, normalized_name string, category string, ingredient_id long")
    remap, vocabulary = spark.createDataFrame([("ing_00002", "ing_00001")], "old string, new string"), spark.createDataFrame([("leek",)], "name string")
    raw = candidates.classified(images, classes, labels, remap, vocabulary)
    routes = images.select("image", F.lit('{"route":"raw_ingredient","confidence":0.9,"needs_user_confirmation":false}').alias("answer"))
    found = candidates.recognize(routes, raw.limit(0), raw, raw.limit(0))
    rows = found.select("image", "needs_review", F.posexplode("candidates").alias("place", "c"))
    return rows.select("image", "place", "c.display_name", "c.ingredient_id", F.round("c.confidence", 6).alias("confidence"), "needs_review")
