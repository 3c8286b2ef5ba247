"""Candidates of recognition models: contract, labels, stages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import class_key, col, label
from larder.operators.resolve import first_by

# Thresholds of the stages, and the categories of packaged goods.
RAW_OVERRIDE, OCR_BELOW, OCR_MARGIN, DIRECT_BELOW = 0.45, 0.93, 0.20, 0.97
PACKAGED_CATEGORIES = ["소스", "유제품"]
ITEM = "struct<displayName:string,display_name:string,name:string,rawName:string,raw_name:string,normalizedName:string,normalized_name:string,normalized:string,confidence:string,score:string,categorySuggestion:string,category_suggestion:string,category:string,ingredientMasterId:string,ingredient_master_id:string,ingredientId:string>"


def filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def contract(answer: str | Column, category: str | None = None) -> Column:
    """an array of candidates from a JSON text, object or list of either; other values give none. A bad number counts as 0."""
    text = F.trim(col(answer))
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), F.array(text)).when(text.startswith('"'), F.array(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]))

    def one(item: Column) -> Column:
        o = F.from_json(item, ITEM)
        is_object = F.trim(item).startswith("{")
        name = F.when(is_object, filled(*[o[n] for n in ("displayName", "display_name", "name", "rawName", "raw_name")])).otherwise(F.trim(item))
        normal = F.when(is_object, filled(*[o[n] for n in ("normalizedName", "normalized_name", "normalized")]))
        return F.struct(
            F.coalesce(name, F.lit("")).alias("display_name"), F.coalesce(normal, name, F.lit("")).alias("normalized_name"),
            F.coalesce(F.when(is_object, filled(o["categorySuggestion"], o["category_suggestion"], o["category"])), F.lit(category)).alias("category"),
            F.coalesce(F.when(is_object, F.coalesce(o["confidence"], o["score"]).try_cast("double")), F.lit(0.0)).alias("confidence"),
            F.when(is_object, F.coalesce(o["ingredientMasterId"], o["ingredient_master_id"], o["ingredientId"]).try_cast("bigint")).alias("ingredient_id"),
        )

    blank = lambda item: F.trim(F.coalesce(item, F.lit(""))) == ""
    return F.coalesce(F.transform(F.filter(listed, lambda x: ~blank(x)), one), F.transform(F.array().cast("array<string>"), one))


def route_fields(answer: str | Column) -> Column:
    """route, confidence, review, reason and probabilities from either layout of a JSON text."""
    nested = F.from_json(col(answer), "struct<route:struct<type:string,confidence:double,needsReview:boolean,reason:string,probabilities:map<string,double>>>")["route"]
    flat = F.from_json(col(answer), "struct<route:string,confidence:double,needs_user_confirmation:boolean,reason:string,probabilities:map<string,double>>")
    is_nested = F.coalesce(F.trim(flat["route"]).startswith("{"), F.lit(False))
    pick = lambda a, b, default: F.coalesce(F.when(is_nested, a).otherwise(b), default)
    return F.struct(
        pick(F.nullif(nested["type"], F.lit("")), F.nullif(flat["route"], F.lit("")), F.lit("unknown")).alias("route"), pick(nested["confidence"], flat["confidence"], F.lit(0.0)).alias("confidence"),
        pick(nested["needsReview"], flat["needs_user_confirmation"], F.lit(True)).alias("needs_review"), F.when(is_nested, nested["reason"]).otherwise(flat["reason"]).alias("reason"),
        pick(nested["probabilities"], flat["probabilities"], F.create_map().cast("map<string,double>")).alias("probabilities"),
    )


def stage(route: str | Column, ocr: str | Column, raw: str | Column, direct: str | Column) -> Column:
    """the stage, final route and candidates, from three arrays of candidates with a confidence."""
    ocr, raw, direct, route = col(ocr), col(raw), col(direct), col(route)
    top = lambda c, k=0: F.coalesce(F.get(c, F.lit(k))["confidence"], F.lit(0.0))
    some = lambda c: F.size(c) > 0
    out = lambda name, r, c: F.struct(F.lit(name).alias("stage"), r.alias("route"), c.alias("candidates"))
    packaged, ingredient = F.lit("packaged_food"), F.lit("raw_ingredient")
    from_packaged = F.when(~some(ocr) & some(raw) & (top(raw) >= RAW_OVERRIDE), out("raw_ingredient_classifier_override", ingredient, raw)).otherwise(out("packaged_food_ocr", packaged, ocr))
    weak = ~some(raw) | (top(raw) <= OCR_BELOW) | (top(raw) - top(raw, 1) <= OCR_MARGIN)
    from_raw = F.when(weak & some(ocr), out("packaged_food_ocr_fallback_from_raw", packaged, ocr)).otherwise(out("raw_ingredient_classifier", ingredient, raw))
    from_direct = F.when((top(direct) <= DIRECT_BELOW) & some(ocr), out("packaged_food_ocr_fallback_from_direct_master", packaged, ocr)).otherwise(out("yolo_master_topk", ingredient, direct))
    return F.when(route == "packaged_food", from_packaged).when(route == "raw_ingredient", from_raw).when(some(direct), from_direct).otherwise(out("unsupported_route", route, direct))


def overlay(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """Of entries with one key, that of the last layer stays as a whole."""
    rows = layers[0].withColumn("_layer", F.lit(0))
    for k, layer in enumerate(layers[1:], 1):
        rows = rows.unionByName(layer.withColumn("_layer", F.lit(k)), allowMissingColumns=True)
    return first_by(rows, [key], [F.desc("_layer")]).drop("_layer")


def resolved_labels(top: DataFrame, labels: DataFrame, remap: DataFrame, vocabulary: DataFrame, *, policy: str = "passthrough", enforce: bool = False) -> DataFrame:
    """names of the classes of top (image, place, label, p).

    labels (key, display_name, normalized_name, category, ingredient_id); remap (old, new); vocabulary (name). Looked up by normal label, by
    single underscores, by padded key; skipped ranks aren't refilled.
    """
    old = remap.groupBy("old").agg(F.max("new").alias("new"))
    rows = top.withColumn("_canon", class_key("label")).withColumn("_normal", label("label"))
    by = lambda name: old.select(F.col("old").alias(name), F.col("new").alias(f"_by{name}"))
    rows = rows.join(by("_canon"), "_canon", "left").join(by("_normal"), "_normal", "left").withColumn("resolved", F.coalesce("_by_canon", "_by_normal"))
    rows = rows.withColumn("_look", F.coalesce("resolved", "label"))
    keys = {"_a": label("_look"), "_b": label(F.replace(F.col("_look"), F.lit("__"), F.lit("_"))), "_c": class_key("_look")}
    rows = rows.withColumns(keys)
    meta = F.struct("display_name", "normalized_name", "category", "ingredient_id")
    for k in keys:
        rows = rows.join(labels.select(F.col("key").alias(k), meta.alias(f"_m{k}")), k, "left")
    rows = rows.withColumn("_meta", F.coalesce(*[f"_m{k}" for k in keys]))
    known = vocabulary.select("name").distinct()
    for k, c in (("_v1", "label"), ("_v2", "_normal")):
        rows = rows.join(known.select(F.col("name").alias(c), F.lit(True).alias(k)), c, "left")
    own = F.when(F.col("_v1"), F.col("label")).when(F.col("_v2"), F.col("_normal")).otherwise(F.col("label"))
    rows = rows.withColumns({n: F.when(F.col("_meta").isNotNull(), F.col(f"_meta.{n}")).otherwise(own) for n in ("display_name", "normalized_name")})
    rows = rows.withColumns({"category": F.nullif(F.col("_meta.category"), F.lit("")), "ingredient_id": F.col("_meta.ingredient_id")})
    rows = rows if policy == "passthrough" else rows.filter("_meta is not null")
    rows = rows.join(known.select(F.col("name").alias("normalized_name")), "normalized_name", "left_semi") if enforce else rows
    return rows.select("image", "place", "label", "p", "display_name", "normalized_name", "category", "ingredient_id", "resolved")


def named_classes(classes: DataFrame, labels: DataFrame, reference: DataFrame) -> DataFrame:
    """Names of classes (image, class, p) from the label map, else the reference table, else the class itself."""
    l = labels.select(F.col("key").alias("class"), F.col("display_name").alias("_d1"), F.col("normalized_name").alias("_n1"), F.col("ingredient_id").alias("_i1"), F.lit(True).alias("_l"))  # noqa: E741
    r = reference.select(F.col("key").alias("class"), F.col("display_name").alias("_d2"), F.col("normalized_name").alias("_n2"), F.col("ingredient_id").alias("_i2"))
    rows = classes.join(l, "class", "left").join(r, "class", "left")
    names = F.when(F.col("_l"), F.struct(filled(F.col("_d1"), F.col("class")).alias("d"), filled(F.col("_n1"), F.col("_d1"), F.col("class")).alias("n"), F.col("_i1").alias("i")))
    names = names.otherwise(F.struct(filled(F.col("_d2"), F.col("class")).alias("d"), filled(F.col("_n2"), F.col("_d2"), F.col("class")).alias("n"), F.nullif(F.col("_i2"), F.lit(0).cast("long")).alias("i")))
    return rows.select("image", "class", "p", names.alias("m")).select("image", "class", "p", F.col("m.d").alias("display_name"), F.col("m.n").alias("normalized_name"), F.col("m.i").alias("ingredient_id"))


def source_class(files: DataFrame, path: str, mapping: DataFrame) -> DataFrame:
    """The class of the deepest parent folder that mapping (folder, value) knows; null where none is."""
    parents = files.select(path, F.posexplode(F.slice(F.split(path, "/"), 1, F.greatest(F.lit(1), F.size(F.split(path, "/")) - 1))).alias("_at", "_part"))
    known = parents.withColumn("folder", label("_part")).join(mapping, "folder").groupBy(path).agg(F.max_by("value", "_at").alias("value"), F.max_by("folder", "_at").alias("folder"))
    return files.join(known, path, "left")


def claimed_names(classes: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Name, class and whether another class claimed the name before (in order of class, then field)."""
    entries = F.posexplode(F.array(*[F.trim(n) for n in names]))
    rows = classes.select(F.col(key).alias("class"), entries.alias("_at", "name")).filter("name is not null and name <> ''")
    owner = rows.groupBy("name").agg(F.min("class").alias("_owner"))
    return rows.join(owner, "name").select("name", "class", (F.col("class") != F.col("_owner")).alias("clash")).distinct()


def packaged_proposal(labels: DataFrame, extra: DataFrame, borderline: DataFrame) -> DataFrame:
    """proposed, borderline or null for each label (key, category); lists have a key."""
    rows = labels.join(extra.select("key", F.lit(True).alias("_e")).distinct(), "key", "left").join(borderline.select("key", F.lit(True).alias("_b")).distinct(), "key", "left")
    state = F.when(F.col("_b"), "borderline").when(F.col("category").isin(PACKAGED_CATEGORIES) | F.col("_e"), "proposed")
    return rows.withColumn("proposal", state).drop("_e", "_b")


def image_statistics(images: DataFrame) -> DataFrame:
    """Variance of the 4-neighbour Laplacian inside a border of one pixel, and mean luminance, of the images of Spark's image source.

    A file that can't be read (height -1) gives nulls; image_report puts a default row there.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if row.height <= 0:
                    out.append((row.origin, None, None))
                    continue
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels).astype(np.float64)
                blue, green, red = (pixels[:, :, min(k, row.nChannels - 1)] for k in range(3))
                gray = (0.299 * red + 0.587 * green + 0.114 * blue) / 255.0
                inner = gray[2:, 1:-1] + gray[:-2, 1:-1] + gray[1:-1, 2:] + gray[1:-1, :-2] - 4.0 * gray[1:-1, 1:-1]
                out.append((row.origin, float(inner.var()) if gray.size >= 9 and inner.size else 0.0, float(gray.mean())))
            yield pd.DataFrame(out, columns=["origin", "variance", "luminance"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(measure, "origin string, variance double, luminance double")


def image_report(images: DataFrame) -> DataFrame:
    """Scores and signals of each image; one that can't be read has fixed scores and a signal of its own."""
    from larder.operators.recognition import image_scores

    scored = image_statistics(images).withColumn("s", image_scores("variance", "luminance"))
    unread = F.col("variance").isNull()
    value = lambda name, default: F.when(unread, F.lit(default)).otherwise(F.col(f"s.{name}")).alias(name)
    signals = F.when(unread, F.array(F.lit("IMAGE_DECODE_FAILED"))).otherwise(F.col("s.signals"))
    return scored.select("origin", value("blur", 0.0), value("exposure", 0.5), value("combined", 0.25), signals.alias("signals"))


def class_reference(rows: DataFrame) -> DataFrame:
    """A reference table with damaged header names: names and values trimmed, keys in normal form, of equal keys the last row (line_no)."""
    names = {c: c.replace("﻿", "").strip() for c in rows.columns}
    clean = rows.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(n) if n != "line_no" else F.col(f"`{c}`").alias(n) for c, n in names.items()])
    keyed = clean.withColumn("key", class_key("class_folder"))
    return first_by(keyed, ["key"], [F.desc("line_no")])


def verified_folders(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (normalized_name, source_dir) with their class; blank rows are skipped, an unknown name fails the job."""
    rows = manifest.filter((F.trim("normalized_name") != "") & (F.trim("source_dir") != ""))
    joined = rows.join(labels.select("normalized_name", F.col("key").alias("_class")), "normalized_name", "left")
    fail = F.raise_error(F.concat(F.lit("unknown name "), F.col("normalized_name")))
    return joined.withColumn("class", F.coalesce("_class", fail)).drop("_class")


def route_classes(files: DataFrame, path: str, mapping: DataFrame) -> DataFrame:
    """the route class of each file by its deepest known folder; mapping (folder, value) holds folders and route classes."""
    return source_class(files, path, mapping.withColumn("folder", label("folder"))).withColumnRenamed("value", "route_class").filter("route_class is not null")


def classified(images: DataFrame, classes: DataFrame, labels: DataFrame, remap: DataFrame, vocabulary: DataFrame, *, k: int = 3, policy: str = "passthrough", similarity: DataFrame | None = None) -> DataFrame:
    """C11 up to the candidates: image and candidates from class probabilities of two passes.

    images: image, p, flipped (arrays; an empty second pass leaves the first); classes: class (its place in the arrays) and label. The passes are averaged (A12),
    the k likeliest classes (T04) get names (F40), all are uncertain if the prediction is (W06). similarity (image, similarity: map by display name)
    reorders the candidates (F39).
    """
    from larder.operators.recognition import averaged, margin, reranked, top_classes

    rows = images.select("image", averaged("p", "flipped").alias("_p"))
    rows = rows.select("image", margin("_p")["uncertain"].alias("uncertain"), F.posexplode(top_classes("_p", k)).alias("place", "_c"))
    top = rows.select("image", "place", F.col("_c.class").alias("class"), F.col("_c.probability").alias("p")).join(classes, "class").select("image", "place", "label", "p")
    named = resolved_labels(top, labels, remap, vocabulary, policy=policy).join(rows.select("image", "uncertain").distinct(), "image")
    one = F.struct("place", F.col("display_name").alias("name"), "display_name", "normalized_name", "category", F.col("p").alias("confidence"), "ingredient_id", "uncertain")
    found = named.groupBy("image").agg(F.array_sort(F.collect_list(one)).alias("candidates"))  # k of each image
    if similarity is not None:
        found = found.join(similarity, "image", "left").withColumn("candidates", reranked("candidates", F.coalesce("similarity", F.create_map().cast("map<string,double>"))))
    kept = ("display_name", "normalized_name", "category", "confidence", "ingredient_id", "uncertain")
    return found.select("image", F.transform("candidates", lambda c: F.struct(*[c[n].alias(n) for n in kept])).alias("candidates"))


def recognize(routes: DataFrame, direct: DataFrame, raw: DataFrame, ocr: DataFrame, *, k: int = 3) -> DataFrame:
    """C11: one row for each image with its stage, final route, candidates by confidence, review flag and anomaly.

    routes: image, answer (JSON in either layout). direct, raw, ocr: image, candidates (arrays of display_name, normalized_name, category,
    confidence, ingredient_id, uncertain). k from 1 to 10 may be asked for; at most 3 candidates are given.
    """
    from larder.operators.recognition import anomaly, by_confidence

    if not 1 <= k <= 10:
        raise ValueError("k must be from 1 to 10")
    rows = routes.select("image", route_fields("answer").alias("r"))
    kind = next(f.dataType for f in raw.schema.fields if f.name == "candidates")
    for name, df in (("direct", direct), ("raw", raw), ("ocr", ocr)):
        rows = rows.join(df.select("image", F.col("candidates").alias(name)), "image", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    rows = rows.withColumn("s", stage(F.col("r.route"), "ocr", "raw", "direct")).withColumn("candidates", F.slice(by_confidence(F.col("s.candidates")), 1, min(k, 3)))
    first = F.get("candidates", F.lit(0))
    review = F.col("r.needs_review") | (F.size("candidates") == 0) | F.coalesce(first["uncertain"], F.lit(False))
    rows = rows.withColumn("needs_review", review)
    judged = anomaly(F.col("r.confidence"), F.col("r.needs_review"), first["confidence"], F.size("candidates"), F.col("s.stage"), F.col("needs_review"))
    return rows.select("image", "s.stage", "s.route", "candidates", "needs_review", judged.alias("anomaly"))
