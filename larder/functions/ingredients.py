"""ingredient names in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import col, without_parentheses

# Spellings and the name that each group shares. Tuples: name, then its other spellings.
ALIASES = [
    ("후춧가루", "후추가루", "후추"),
    ("달걀", "계란"),
    ("고춧가루", "고추가루", "고운고춧가루", "굵은고춧가루", "청양고춧가루"),
    ("밀가루", "중력분", "박력분", "강력분"),
    ("소금", "꽃소금", "굵은소금", "천일염", "맛소금"),
    ("설탕", "흰설탕", "백설탕", "황설탕", "흑설탕", "갈색설탕", "자일로스설탕"),
    ("고추장", "태양초고추장", "찰고추장", "순창고추장"),
    ("된장", "재래식된장", "집된장"),
    ("간장", "진간장", "양조간장", "국간장", "조선간장", "맛간장"),
    ("굴소스", "프리미엄굴소스"),
    ("케첩", "케찹", "토마토케첩"),
    ("마요네즈", "마요네스"),
    ("식초", "양조식초", "현미식초", "사과식초"),
    ("맛술", "미림", "요리술"),
    ("액젓", "멸치액젓", "까나리액젓"),
    ("육수", "멸치육수", "멸치다시마육수", "다시마육수"),
    ("식용유", "카놀라유", "포도씨유", "해바라기씨유", "콩기름"),
    ("올리브유", "올리브오일"),
    ("참기름", "참기름약간"),
    ("들기름", "들기름약간"),
    ("참깨", "깨", "통깨", "볶은깨"),
    ("전분", "감자전분", "옥수수전분"),
    ("베이킹파우더", "베이킹파우다"),
    ("마늘", "다진마늘", "간마늘", "통마늘"),
    ("생강", "다진생강", "간생강"),
    ("양파", "양파채", "자색양파", "적양파"),
    ("대파", "파", "대파흰대", "대파흰부분", "대파녹색부분", "흰대파"),
    ("청양고추", "청양고추개"),
    ("홍고추", "붉은고추"),
    ("고추", "풋고추"),
    ("당근", "당근채"),
    ("감자", "감자개"),
    ("무", "무우"),
    ("배추", "알배추", "알배기배추"),
    ("양배추", "양배추잎"),
    ("깻잎", "깻잎장"),
    ("부추", "영양부추"),
    ("애호박", "호박"),
    ("오이", "백오이"),
    ("가지", "가지개"),
    ("표고버섯", "표고", "생표고버섯"),
    ("새송이버섯", "새송이"),
    ("느타리버섯", "느타리"),
    ("팽이버섯", "팽이"),
    ("양송이버섯", "양송이"),
    ("소고기", "쇠고기", "다진소고기", "다진쇠고기", "소고기다짐육", "쇠고기다짐육"),
    ("돼지고기", "돈육", "다진돼지고기", "돼지고기다짐육", "돼지다짐육"),
    ("닭고기", "닭", "닭정육"),
    ("오징어", "오징어몸통"),
    ("새우", "칵테일새우", "냉동새우"),
    ("멸치", "국물멸치", "다시멸치"),
    ("건새우", "마른새우"),
    ("두부", "부침두부", "찌개두부", "찌개용두부", "부침용두부"),
    ("모짜렐라치즈", "모차렐라치즈", "피자치즈"),
    ("우유", "흰우유"),
    ("버터", "무염버터", "가염버터"),
    ("밥", "흰밥", "공기밥"),
    ("떡", "떡볶이떡", "떡국떡"),
    ("라면", "라면사리"),
    ("빵가루", "생빵가루"),
    ("김", "구운김", "조미김"),
    ("김치", "배추김치", "익은김치", "신김치"),
]
# Phrases and modifiers that a name loses.
PHRASES = [r"편으로[\s　]*썬", r"데친[\s　]*것", r"다진[\s　]*것"]
MODIFIERS = ["고운", "가는", "갈은", "굵은", "노란", "빨간", "시원한", "작은것", "녹색부분", "삶은", "흰부분", "범일", "단단한", "채썬", "데쳐서", "물기짠", "작은거"]
TOO_WIDE = ["장", "가루"]
# How a name is reduced to what is seen; the first that fits counts.
EXACT = {"대파흰부분": "대파", "간 깨": "깨", "깨 간 것": "깨"}
REDUCTIONS = [
    r"^시원한\s+(.+)$", r"^집(.+)$", r"^(.+?)\s+데친\s+것$", r"^삶은\s+(.+)$", r"^다진\s*(.+)$", r"^(.+?)\s+다진\s+것$", r"^(.+?)\s+다진$",
    r"^채\s*썬\s+(.+)$", r"^채썬\s+(.+)$", r"^편으로\s*썬\s+(.+)$", r"^깐\s*(.+)$", r"^샤브용\s+(.+)$", r"^(.+?)\s+작은것$", r"^(.+?)\s+작은거$",
    r"^(.+?)\s+중간\s*사이즈$", r"^(.+?)\s+줄기$", r"^(.+?)\s+흰부분$", r"^(.+?)\s+녹색부분$", r"^(.+?)\s+가루$",
]
SEPARATORS = [" 또는 ", " + ", "/", ","]
PASSES = 12


def aliases(spark: SparkSession) -> DataFrame:
    """spelling and name, one row for each spelling that differs from its name."""
    return spark.createDataFrame([(other, name) for name, *others in ALIASES for other in others], "spelling string, name string")


def stripped(c: str | Column) -> Column:
    """F07 up to the alias: a name's first line without modifiers and spaces; null if nothing was there."""
    raw = F.trim(F.split_part(F.split_part(col(c), F.lit("\n"), F.lit(1)), F.lit("\r"), F.lit(1)))
    v = raw
    for phrase in [*PHRASES, "|".join(MODIFIERS), "^(깐)+"]:
        v = F.regexp_replace(v, phrase, "")
    v = F.when(v.startswith("꽃게"), v).otherwise(F.regexp_replace(v, "^(꽃)+", ""))
    v = F.regexp_replace(v, r"[\s　]+", "")
    plain = F.regexp_replace(raw, r"[\s　]+", "")
    return F.when(raw != "", F.when(v == "", plain).otherwise(v))


def normalized(df: DataFrame, column: str, into: str = "normalized_name") -> DataFrame:
    """the alias of the stripped name by a broadcast join of the fixed list; names that are too wide go back."""
    plain = F.regexp_replace(F.trim(F.split_part(F.split_part(F.col(column), F.lit("\n"), F.lit(1)), F.lit("\r"), F.lit(1))), r"[\s　]+", "")
    pairs = aliases(df.sparkSession).withColumnsRenamed({"spelling": "_spelling", "name": "_name"})
    joined = df.withColumn("_stripped", stripped(column)).join(F.broadcast(pairs), F.col("_stripped") == F.col("_spelling"), "left")
    name = F.coalesce("_name", "_stripped")
    return joined.withColumn(into, F.nullif(F.when(name.isin(TOO_WIDE), plain).otherwise(name), F.lit(""))).drop("_stripped", "_spelling", "_name")


#: All reductions as one pattern: alternatives are tried in order, and of their groups only the one that fits is filled. What follows the end is a last line end.
ANY_REDUCTION = "^(?:" + "|".join(r.removeprefix("^").removesuffix("$") for r in REDUCTIONS) + r")$[\s\S]*"
ANY_GROUP = "".join(f"${k}" for k in range(1, len(REDUCTIONS) + 1))


def _reduced_once(t: Column) -> Column:
    out = F.when(F.lit(False), t)
    for text, name in EXACT.items():
        out = out.when(t == text, F.lit(name))
    return out.otherwise(F.trim(F.regexp_replace(t, ANY_REDUCTION, ANY_GROUP)))


def visual_base(c: str | Column) -> Column:
    """reductions up to a fixed point, PASSES at most, as a fold so that the plan stays small; a name at its fixed point costs no more passes."""

    def step(state: Column, _: Column) -> Column:
        t = state["t"]
        each = F.transform(F.array(_reduced_once(t)), lambda new: F.struct(new.alias("t"), new.eqNullSafe(t).alias("done")))
        return F.when(state["done"], state).otherwise(each[0])

    start = F.struct(without_parentheses(c).alias("t"), F.lit(False).alias("done"))
    reduced = F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), start, step, lambda state: state["t"])
    return F.coalesce(F.nullif(F.trim(reduced), F.lit("")), F.trim(col(c)))


def phrases(c: str | Column) -> Column:
    """parts of a composite name at the first separator it has, each followed by its reduction where that differs."""


    def split(name: Column) -> Column:
        out = F.when(F.lit(False), F.array(name))
        for separator in SEPARATORS:
            parts = F.filter(F.transform(F.split(name, rf"\Q{separator}\E"), lambda x: F.trim(x)), lambda x: x != "")
            out = out.when(F.contains(name, F.lit(separator)) & (F.size(parts) > 0), parts)
        return out.otherwise(F.array(name))

    # Each name and each reduction is bound once: what a lambda's variable holds isn't worked out again where it is used.
    parts = F.flatten(F.transform(F.array(without_parentheses(c)), split))
    with_base = F.transform(parts, lambda p: F.struct(p.alias("p"), visual_base(p).alias("b")))
    return F.flatten(F.transform(with_base, lambda x: F.when(x["b"] != x["p"], F.array(x["p"], x["b"])).otherwise(F.array(x["p"]))))
