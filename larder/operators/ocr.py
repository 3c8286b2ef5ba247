"""Ranking of text lines on packages by how likely they are a product's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.keywords import contains_any
from larder.functions.text import col, collapsed, non_letter_ratio

# Patterns of lines that are no names, words of products, and words that are weak alone.
NOISE = [
    r"\d+\s*등급", r"\d+[A-Za-z]\s*등급", "세균수", "세군수", "체세포수", "냉장제품", "냉장", "냉동", "kcal", "칼로리", r"\d+\s*m[lL]", r"\d+\s*ml", r"\d+\s*g", r"\d+\s*kg", r"\d+\s*%",
    r"\d{1,2}\.\d{1,2}\.?", r"\d{2,4}[./-]\d{1,2}[./-]\d{1,2}", "까지", "제조", "유통", "소비기한", "보관", "주의", "원재료", "영양정보", "나트륨", "탄수화물", "단백질", "지방", "당류",
    "총내용량", "내용량", "원유", "살균", "멸균", r"R\d+", "[A-Za-z0-9]{6,}",
]
PRODUCTS = [
    "우유", "서울우유", "매일", "남양", "빙그레", "쿨피스", "두유", "요구르트", "요거트", "주스", "쥬스", "두부", "라면", "고추장", "된장", "쌈장", "소스", "간장", "식초", "치즈", "버터", "크림",
    "햄", "소시지", "참치", "김치", "만두", "어묵", "떡", "음료", "생수",
]
WEAK = ["우유", "두유", "주스", "쥬스", "요거트", "요구르트", "두부", "라면", "소스", "치즈", "버터", "크림"]
FAR = 999999.0
#: Lines of a task, on average.
TASK_LINES = 250_000


def is_noise(c: str | Column) -> Column:
    """any of the patterns, in any case."""
    return col(c).rlike("(?i)" + "|".join(NOISE))


LAYOUT = "struct<rec_texts:array<string>,rec_scores:array<string>,rec_boxes:array<string>,rec_polys:array<string>,rec_text:string,rec_score:string,rec_box:string,rec_poly:string>"


def flattened(results: DataFrame, image: str, answer: str) -> DataFrame:
    """image, line_no, text, confidence and box of each line of a JSON answer.

    The answer holds parallel lists of texts, scores and boxes, or a single text, either at the top or below "res". Empty texts go;
    a score that is absent or no number is 0; a box of four numbers is one array, a polygon an array of points.
    """
    top, below = F.from_json(answer, LAYOUT), F.from_json(answer, f"struct<res:{LAYOUT}>")["res"]
    rows = results.withColumn("_r", F.when(F.get_json_object(answer, "$.res").isNotNull(), below).otherwise(top))
    none = F.array().cast("array<string>")
    boxes = F.when(F.size("_r.rec_boxes") > 0, F.col("_r.rec_boxes")).when(F.size("_r.rec_polys") > 0, F.col("_r.rec_polys"))
    entry = lambda text, score, box: F.struct(collapsed(text).alias("text"), F.coalesce(score.try_cast("double"), F.lit(0.0)).alias("confidence"), box.alias("box"))
    many = F.transform(F.coalesce("_r.rec_texts", none), lambda t, i: entry(t, F.get("_r.rec_scores", i), F.get(F.col("_boxes"), i)))
    one = entry(F.col("_r.rec_text"), F.col("_r.rec_score"), F.coalesce("_r.rec_box", "_r.rec_poly"))
    rows = rows.withColumn("_boxes", F.coalesce(boxes, none)).withColumn("_lines", F.filter(F.concat(many, F.array(one)), lambda x: x["text"] != ""))
    # The outer form, since a filter on lists that aren't empty would parse each answer again.
    lines = rows.select(image, F.posexplode_outer("_lines").alias("line_no", "l")).filter("l is not null").select(image, "line_no", "l.text", "l.confidence", F.col("l.box").alias("_box"))
    flat = F.array(F.from_json("_box", "array<double>"))
    points = F.from_json("_box", "array<array<double>>")
    return lines.withColumn("box", F.when(F.col("_box").rlike(r"^\s*\[\s*\["), points).when(F.col("_box").isNotNull(), flat)).drop("_box")


def has_product_word(c: str | Column) -> Column:
    """F45."""
    return contains_any(col(c), PRODUCTS)


def box_edges(box: str | Column) -> Column:
    """x1, y1, x2, y2 of a box given as four numbers or as a polygon's points, here an array of arrays of numbers.

    Four numbers are one array of length 4; a polygon has four points or more. Others give null.
    """
    points = col(box)
    flat = F.get(points, F.lit(0))
    is_box = (F.size(points) == 1) & (F.size(flat) == 4)
    corners = F.filter(points, lambda p: F.size(p) >= 2)
    xs, ys = F.transform(corners, lambda p: F.get(p, F.lit(0))), F.transform(corners, lambda p: F.get(p, F.lit(1)))
    edge = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    polygon = edge(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when(is_box, edge(*[F.get(flat, F.lit(k)) for k in range(4)])).when(F.size(points) >= 4, polygon)


def title_score(text: str | Column, confidence: str | Column, box: str | Column, width: str | Column, height: str | Column) -> Column:
    """terms are added in fixed order; an empty text has 0."""
    edges, w, h = box_edges(box), col(width), col(height)
    known = edges.isNotNull() & (w > 0) & (h > 0)
    area = F.when(known, F.greatest(F.lit(0.0), edges["x2"] - edges["x1"]) * F.greatest(F.lit(0.0), edges["y2"] - edges["y1"]) / (w * h))
    middle = F.when(known, (edges["y1"] + edges["y2"]) / 2.0 / h)

    def scored(t: Column) -> Column:
        score = col(confidence).cast("double")
        for test, value in (
            (has_product_word(t), 0.65), (is_noise(t), -0.75), (F.length(t).between(2, 12), 0.15), (F.length(t) > 18, -0.30), (non_letter_ratio(t) > 0.55, -0.45),
            (area > 0.01, 0.20), (area > 0.03, 0.35), (middle > 0.72, -0.20), (t.isin(WEAK), -0.10),
        ):
            score = score + F.when(test, value).otherwise(0.0)
        return F.when(F.length(t) > 0, score).otherwise(0.0)

    # The text is bound once; each test would collapse it again.
    return F.transform(F.array(collapsed(text)), scored)[0]


def _merged(lines: Column, most: int) -> Column:
    """in order of score, lines that are no noise; of two where one holds the other, the longer stays; at most most."""
    empty = F.filter(lines, lambda x: F.lit(False))

    def take(kept: Column, line: Column) -> Column:
        text = line["text"]
        nested = F.exists(kept, lambda k: F.contains(k["text"], text) | F.contains(text, k["text"]))
        longer = F.transform(kept, lambda k: F.when(F.contains(text, k["text"]) & (F.length(text) > F.length(k["text"])), line).otherwise(k))
        skip = (text == "") | line["noise"] | (F.size(kept) >= most)
        return F.when(skip, kept).when(nested, longer).otherwise(F.concat(kept, F.array(line)))

    chosen = F.aggregate(lines, empty, take)
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.slice(lines, 1, 1))


def _in_tasks(df: DataFrame, lines: int) -> DataFrame:
    """df dealt out by image, in tasks of about so many lines as a task may have."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines // TASK_LINES)), "image_id")


def dealt_images(images: DataFrame, lines: Column) -> DataFrame:
    """Images dealt out before their lines are made, by the number of lines each will have: a task that reads a file needn't hold its lines for the shuffle,
    which Spark does in memory from some 200 partitions on."""
    return _in_tasks(images, images.agg(F.sum(lines)).first()[0] or 0)


def rank_titles(lines: DataFrame, *, k: int = 5, min_confidence: float = 0.30, max_merge: int = 3, dealt: bool = False) -> DataFrame:
    """Candidates for a product's name from rows (image_id, line_no, text, confidence, box, width, height).

    F49: of equal texts the first line counts. First the merged candidate, then single lines, at most k. dealt: the lines are made from dealt_images and move no more.
    """
    text, edges = collapsed("text"), box_edges("box")
    first = Window.partitionBy("image_id", "_raw").orderBy("line_no")
    # Whole images in tasks of bounded size, by one shuffle that the window and the groups share; what is sorted is narrow.
    rows = lines.select("image_id", "line_no", "text", "confidence", "box", "width", "height").filter(text != "")
    rows = (rows if dealt else _in_tasks(rows, lines.count())).select(
        "image_id", "line_no", F.col("text").alias("_raw"), text.alias("text"), "confidence", title_score("text", "confidence", "box", "width", "height").alias("score"),
        is_noise(text).alias("noise"), F.coalesce(edges["y1"], F.lit(FAR)).alias("top"), F.coalesce(edges["x1"], F.lit(FAR)).alias("left"),
    )
    rows = rows.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    line = F.struct((-F.col("score")).alias("order"), "line_no", "text", "confidence", "noise", "top", "left")
    images = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # one image's lines
    titles = F.filter("lines", lambda x: (x["confidence"] >= min_confidence) & (-x["order"] > 0.35))
    images = images.withColumn("titles", F.when(F.size(titles) > 0, titles).otherwise(F.slice("lines", 1, 1))).withColumn("merged", _merged(F.col("titles"), max_merge))
    read = F.array_sort(F.transform("merged", lambda x: F.struct(x["top"].alias("top"), x["left"].alias("left"), x["text"].alias("text"))))
    mean = F.aggregate("merged", F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size("merged")
    images = images.withColumn("whole", F.array_join(F.transform(read, lambda x: x["text"]), " ")).withColumn("mean", mean)
    one = lambda t, c, why: F.struct(t.alias("text"), c.cast("double").alias("confidence"), F.lit(why).alias("reason"))
    singles = F.transform(F.filter("titles", lambda x: x["text"] != F.col("whole")), lambda x: one(x["text"], x["confidence"], "single_product_title_line"))
    everything = F.slice(F.concat(F.array(one(F.col("whole"), F.col("mean"), "merged_product_title_lines")), singles), 1, k)
    # There is always the merged one; the outer form keeps a filter on the list, with all that leads to it, out of the plan.
    return images.select("image_id", F.posexplode_outer(everything).alias("place", "c")).select("image_id", "place", "c.text", "c.confidence", "c.reason")
