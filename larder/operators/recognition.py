"""Decisions after image models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import col, label

# Routes and thresholds of the stages.
ROUTES = ["raw_ingredient", "packaged_food", "direct_master"]
ROUTE_SURE, UNSURE_MARGIN, UNSURE_TOP = 0.60, 0.12, 0.40


def averaged(a: str | Column, b: str | Column) -> Column:
    """The mean of two probability vectors of one length, else the first."""
    return F.when(F.size(col(a)) == F.size(col(b)), F.zip_with(a, b, lambda x, y: (x + y) * 0.5)).otherwise(col(a))


def margin(p: str | Column) -> Column:
    """top1, margin to the second (1 where there is one class) and whether the prediction is uncertain."""
    s = F.sort_array(col(p), asc=False)
    top = F.coalesce(F.get(s, F.lit(0)), F.lit(0.0)).cast("double")
    gap = F.when(F.size(s) > 1, F.get(s, F.lit(0)).cast("double") - F.get(s, F.lit(1)).cast("double")).otherwise(1.0)
    return F.struct(top.alias("top1"), gap.alias("margin"), ((gap < UNSURE_MARGIN) | (top < UNSURE_TOP)).alias("uncertain"))


def top_classes(p: str | Column, k: int) -> Column:
    """The k largest entries as (class, probability), ties to the smaller class."""
    marked = F.transform(col(p), lambda x, i: F.struct((-x.cast("double")).alias("order"), i.alias("class")))
    return F.transform(F.slice(F.array_sort(marked), 1, k), lambda x: F.struct(x["class"].alias("class"), (-x["order"]).alias("probability")))


def merged_labels(rows: DataFrame, key: str, probabilities: str, mapping: DataFrame) -> DataFrame:
    """Probabilities of labels summed by the canonical label of mapping (label, canonical), itself where unmapped."""
    each = rows.select(key, F.explode(probabilities).alias("label", "p")).join(mapping, "label", "left")
    return each.groupBy(key, F.coalesce("canonical", "label").alias("canonical")).agg(F.sum("p").alias("p"))


def route(probabilities: str | Column) -> Column:
    """F32: the likeliest label in normal form, its probability and whether a person must look."""
    entries = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("name"))))
    best = F.get(entries, F.lit(0))
    name, p = label(best["name"]), -best["order"]
    known = name.isin(ROUTES)
    return F.struct(F.when(known, name).otherwise("unknown").alias("route"), F.coalesce(p, F.lit(0.0)).alias("confidence"), F.coalesce(~known | (p < ROUTE_SURE), F.lit(True)).alias("needs_review"))


def reranked(candidates: str | Column, similarity: str | Column) -> Column:
    """candidates (name, confidence) by 0.8 similarity + 0.2 confidence; similarity is a map by name, -1 where missing."""
    scored = F.transform(
        col(candidates),
        lambda c, i: F.struct((-(0.8 * F.coalesce(F.try_element_at(col(similarity), c["name"]), F.lit(-1.0)) + 0.2 * F.coalesce(c["confidence"], F.lit(0.0)))).alias("order"), i.alias("at"), c.alias("c")),
    )
    return F.transform(F.array_sort(scored), lambda x: x["c"])


def by_confidence(candidates: str | Column) -> Column:
    """Most confident first, equal ones in their order."""
    marked = F.transform(col(candidates), lambda c, i: F.struct((-F.coalesce(c["confidence"], F.lit(0.0))).alias("order"), i.alias("at"), c.alias("c")))
    return F.transform(F.array_sort(marked), lambda x: x["c"])


def anomaly(route_confidence: str | Column, route_review: str | Column, top: str | Column, n: str | Column, stage: str | Column, review: str | Column, image_score: Column | None = None, image_signals: Column | None = None) -> Column:
    """status, score and signals of a recognition; top is the first candidate's confidence, n the number of candidates."""
    rc, t, some = F.coalesce(col(route_confidence), F.lit(0.0)), F.coalesce(col(top), F.lit(0.0)), col(n) > 0
    signals = F.array_compact(F.array(
        F.when(some & (t < 0.35), "LOW_TOP1_CONFIDENCE"), F.when(col(route_review), "ROUTE_NEEDS_REVIEW"), F.when(rc < 0.5, "LOW_ROUTE_CONFIDENCE"),
        F.when(~some, "NO_CANDIDATES"), F.when(col(stage).isin("unsupported_route", "route_review_required"), "PIPELINE_UNCERTAIN"),
    ))
    within = lambda x, low: F.greatest(F.lit(low), F.least(F.lit(1.0), x))
    score = F.round(within(F.when(col(review), 0.55).otherwise(1.0) * F.when(some, within(t, 0.15)).otherwise(0.25) * within(rc, 0.25), 0.0), 4)
    if image_score is not None:
        score = F.round(within(0.5 * score + 0.5 * image_score, 0.0), 4)
        signals = F.array_distinct(F.concat(signals, F.coalesce(image_signals, F.array().cast("array<string>"))))
    status = F.when((score >= 0.55) & (F.size(signals) == 0), "OK").when((score >= 0.3) | (~col(review) & some), "SUSPICIOUS").otherwise("NEEDS_REVIEW")
    return F.struct(status.alias("status"), score.alias("score"), signals.alias("signals"))


def image_scores(variance: str | Column, luminance: str | Column, blur_below: float = 30.0) -> Column:
    """scores of sharpness and exposure, their blend and flags from an image's Laplacian variance and mean luminance."""
    var, lum = col(variance), col(luminance)
    blur = F.greatest(F.lit(0.0), F.least(F.lit(1.0), var / 0.02))
    exposure = 1.0 - F.least(F.abs(lum - 0.5) * 2.0, F.lit(1.0))
    flags = F.array_compact(F.array(F.when(var < blur_below, "BLUR_SUSPECT"), F.when(lum < 0.08, "UNDEREXPOSED"), F.when(lum > 0.92, "OVEREXPOSED")))
    return F.struct(F.round(blur, 4).alias("blur"), F.round(exposure, 4).alias("exposure"), F.round(0.55 * blur + 0.45 * exposure, 4).alias("combined"), flags.alias("signals"))
