"""Jobs over ingredient tables and image classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import ingredients, text
from larder.operators import datasets, nutrition, resolve
from larder.operators.snapshots import snapshot, spread


def apply_approved_pairs(pairs: DataFrame, master: DataFrame, children: dict[str, tuple[DataFrame, str]], edges: DataFrame, *, context: str | None = None) -> dict[str, DataFrame]:
    """Names of approved pairs (left_id, right_id, suggested_name, approved; all text) become one; then ids merge by name.

    master: ingredient_id, normalized_name. An id with two approved names fails the job. Children are rewritten without deduplication
    and edges may become loops, unlike in C02.
    """
    rows = pairs.filter(text.approved("approved", "suggested_name")).select(text.digits_id("left_id").alias("l"), text.digits_id("right_id").alias("r"), F.trim("suggested_name").alias("name"))
    names = rows.selectExpr("stack(2, l, name, r, name) AS (ingredient_id, name)").filter("ingredient_id is not null").distinct()
    renamed = resolve.patch(master, "ingredient_id", "normalized_name", resolve.checked_names(names, "ingredient_id", "name"), "name")
    mapping = resolve.merge_map(renamed, "ingredient_id", "normalized_name")
    out = {"merge_map": mapping, "master": resolve.without_merged(renamed, "ingredient_id", mapping)}
    out |= {name: resolve.rewrite(df, column, mapping) for name, (df, column) in children.items()}
    rewritten = resolve.rewrite_edges(edges, "base_ingredient_id", "sub_ingredient_id", mapping)
    return out | {"edges": resolve.dedup_edges(rewritten, "base_ingredient_id", "sub_ingredient_id", context)}


def normalize_ingredients(master: DataFrame, children: dict[str, tuple[DataFrame, str, str]], plain: dict[str, tuple[DataFrame, str]], edges: DataFrame, *, key: str, canonical: str, name: str, base: str, sub: str, context: str | None) -> dict[str, DataFrame]:
    """Names are normalised (F07), written where they changed (P03, J03), and ingredients of one name merged in all tables."""
    fresh = ingredients.normalized(master.select(key, canonical, name), canonical, "_new")
    renamed = resolve.patch(master, key, name, fresh.filter(~F.col(name).eqNullSafe(F.col("_new"))), "_new")
    return resolve.normalize_and_merge(renamed, children, plain, edges, key=key, name=name, base=base, sub=sub, context=context)


def recommend_meals(history: DataFrame, recipes: DataFrame, targets: DataFrame, *, user: str, date: str, values: Sequence[str], recipe_id: str, as_of: str, k: int = 3) -> DataFrame:
    """Each user's means of 30 and 7 days with the k nearest recipes of each meal; targets (meal and nutrients) hold for all users."""
    means = nutrition.window_means(history, user, date, values, as_of)
    best = nutrition.nearest(recipes, targets, recipe_id, k)
    chosen = best.groupBy("meal").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", recipe_id))), lambda x: x[recipe_id]).alias("recipes"))
    # One row of a few meals.
    return means.withColumn("meals", chosen.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("meal", "recipes"))))).scalar())


def assembly_manifest(files: DataFrame, labels: DataFrame, names: DataFrame, prefixes: DataFrame, source: str) -> DataFrame:
    """Files (path, folder) to class and target name; labels (name, class), names (folder: name, value) and prefixes lead from
    folders to names. Files without a class are kept with their reason."""
    found = datasets.longest_prefix(files, "path", "folder", names, prefixes).withColumnRenamed("value", "_name")
    joined = found.join(labels.select(F.col("name").alias("_name"), "class"), "_name", "left")
    reason = F.when(F.col("_name").isNull(), "unmapped").when(F.col("class").isNull(), "no_master")
    stem = F.concat(F.lit(f"{source}__"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    ready = joined.withColumn("reason", reason).withColumn("_stem", F.concat_ws("/", "class", stem))
    named = datasets.collision_safe(ready.filter("reason is null"), "_stem", ".jpg", ["path"])
    return named.select("path", "class", "file", "reason").unionByName(ready.filter("reason is not null").select("path", "class", F.lit(None).cast("string").alias("file"), "reason"))


def migrate_classes(before: DataFrame, after: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Before and after (id, name); files (path, class_id). Files of ids that are gone are orphans."""
    mapping = resolve.old_to_new(before, after, "id", "name")
    moved = files.join(mapping.withColumnRenamed("old_id", "class_id"), "class_id", "left")
    state = F.when(F.col("new_id").isNull(), "orphan").when(F.col("new_id") == F.col("class_id"), "same").otherwise("moved")
    moved = moved.withColumn("state", state)
    count = lambda s: F.count(F.when(F.col("state") == s, F.lit(1))).alias(s)
    statistics = moved.agg(count("moved"), count("same"), count("orphan"), F.countDistinct(F.when(F.col("state") == "moved", F.col("new_id"))).alias("merged_folders"))
    return {"remap": mapping, "files": moved, "statistics": statistics}


def audit_assets(master: DataFrame, labels: DataFrame, aliases: DataFrame, folders: DataFrame) -> DataFrame:
    """Id and issue, from master (id, name), labels (id, name), aliases (id) and folders (id)."""
    both = master.select("id", F.col("name").alias("m"), F.lit(1).alias("in_m")).join(labels.select("id", F.col("name").alias("l"), F.lit(1).alias("in_l")), "id", "full_outer")
    both = both.join(aliases.select("id", F.lit(1).alias("in_a")).distinct(), "id", "full_outer").join(folders.select("id", F.lit(1).alias("in_f")).distinct(), "id", "full_outer")
    issue = F.array_compact(F.array(
        F.when(F.col("in_l").isNotNull() & F.col("in_m").isNull(), "extra_label"), F.when(F.col("in_m").isNotNull() & F.col("in_l").isNull(), "missing_label"),
        F.when(F.col("in_m").isNotNull() & F.col("in_l").isNotNull() & ~F.col("m").eqNullSafe(F.col("l")), "name_mismatch"),
        F.when(F.col("in_a").isNotNull() & F.col("in_m").isNull(), "dead_alias"), F.when(F.col("in_f").isNotNull() & F.col("in_m").isNull(), "orphan_folder"),
    ))
    return both.select("id", F.explode(issue).alias("issue"))


def search_terms(terms: DataFrame, key: str, names: str, seed: DataFrame) -> DataFrame:
    """distinct English terms (in any case) of each row's names, in order; seed has name and an array of terms."""
    each = terms.select(key, F.posexplode_outer(names).alias("i", "name")).join(seed.select("name", F.posexplode_outer("terms").alias("j", "term")), "name")
    first = resolve.first_by(each.withColumn("_low", F.lower(F.trim("term"))).filter("_low <> ''"), [key, "_low"], [F.asc("i"), F.asc("j")])
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", F.trim("term").alias("term")))), lambda x: x["term"]).alias("terms"))


def alias_template(labels: DataFrame, counts: DataFrame, seed: DataFrame, *, include_covered: bool = False) -> DataFrame:
    """C17: label, Korean phrases and English terms of classes without images (or all), from labels (label, id, name) and counts (label, n)."""
    rows = labels.join(counts, "label", "left").filter(F.lit(include_covered) | (F.coalesce("n", F.lit(0)) == 0))
    # Phrases are much work for each name and are read several times, so they are made once, in many tasks.
    rows = snapshot(spread(rows, "label").withColumn("phrases", F.array_distinct(F.concat(ingredients.phrases("name"), F.array(ingredients.visual_base("name"))))), "alias-phrases")
    return rows.join(search_terms(rows, "label", "phrases", seed), "label", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).orderBy("id").select("label", "id", "name", "phrases", "terms")


def collection_plan(aliases: DataFrame, counts: DataFrame, packaged: DataFrame, suffixes: Sequence[str], *, target: int, cap: int, seed: int, requested: DataFrame | None = None, enough: int | None = None) -> DataFrame:
    """How many images each class (label, terms) still needs, and its queries in a seeded order.

    Packaged classes are left out, but for those that are requested (label); with requests, only these classes count. Classes with enough
    images (the cap, if not told) need none.
    """
    wanted = aliases.join(packaged.select("label"), "label", "left_anti") if requested is None else aliases.join(requested.select("label"), "label", "left_semi")
    rows = wanted.join(counts, "label", "left").withColumn("have", F.coalesce("n", F.lit(0))).filter(F.col("have") < min(cap, enough or cap))
    rows = rows.withColumn("need", F.least(F.lit(target), F.lit(cap) - F.col("have"))).filter("need > 0")
    wide = F.array_distinct(F.flatten(F.transform(text.short_first("terms"), lambda t: text.queries_for(t, suffixes))))
    shuffled = F.transform(F.array_sort(F.transform(wide, lambda q: F.struct(F.xxhash64(F.lit(seed), F.col("label"), q).alias("h"), q.alias("q")))), lambda x: x["q"])
    return rows.select("label", "need", shuffled.alias("queries"))


def report_context(recipes: DataFrame, fridge: DataFrame, meals: DataFrame, *, n: int = 50) -> DataFrame:
    """C20: each user's ingredients and recent meals with the first n titles; recipes (id, title), fridge (user_id, name), meals (user_id, at, title)."""
    titles = recipes.orderBy("id").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "title"))), lambda x: x["title"])).scalar()
    mine = fridge.groupBy("user_id").agg(F.sort_array(F.collect_set("name")).alias("ingredients"))
    recent = meals.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "title")), asc=False), lambda x: x["title"]).alias("meals"))
    none = F.array().cast("array<string>")
    rows = mine.join(recent, "user_id", "full_outer").withColumns({"ingredients": F.coalesce("ingredients", none), "meals": F.coalesce("meals", none)})
    return rows.withColumn("titles", titles)
