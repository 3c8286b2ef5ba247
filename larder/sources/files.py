"""Scans of recipe CSV, dumps, INSERT scripts and label maps (S01, S03, S05, S06, S07), and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources import splits

# Extensions of images of training sets, of uploads that are merged into them, and columns of a review file.
IMAGES = ["jpg", "jpeg", "png", "webp", "bmp"]
UPLOADS = [*IMAGES, "gif"]
REVIEW = ["left_id", "left_canonical_name", "left_normalized_name", "right_id", "right_canonical_name", "right_normalized_name", "similarity", "suggested_name", "approved", "memo"]


def recipe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Path, line_no from 0, and the fields of each row as a map. Quoted line ends are safe and the order within a file is exact; files are
    read in splits, so one of any size is read in parallel."""
    return splits.csv_rows(spark, path)


def dump_rows(spark: SparkSession, path: str, table: str, n_fields: int = 12) -> DataFrame:
    """Fields of the rows between a table's COPY header and its end mark, read in splits; rows with another number of fields are flagged."""
    return splits.dump_rows(spark, path, table, n_fields)


def insert_ids(lines: DataFrame, line: str, table: str) -> DataFrame:
    """Ordinal, the first number of an INSERT line of the table; null for other lines, which pass."""
    ours = F.contains(F.lower(line), F.lit(table)) & F.contains(F.lower(line), F.lit("values"))
    number = F.nullif(F.regexp_extract(line, r"(?i)VALUES\s*\(\s*(\d+)", 1), F.lit("")).cast("long")
    return lines.withColumn("ordinal", F.when(ours, number))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an object of objects below "labels", in the file's order (place); ids that are no numbers become null."""
    return label_entries(spark.read.text(path, wholetext=True), "value")


def label_entries(texts: DataFrame, column: str) -> DataFrame:
    """S03 of JSON texts. Fields have two spellings, of which the first counts; a name that is absent is the label itself."""
    fields = ["displayName", "display_name", "normalizedName", "normalized_name", "categorySuggestion", "category_suggestion", "ingredientId", "ingredient_id"]
    kind = f"struct<labels:map<string,struct<{','.join(f'{f}:string' for f in fields)}>>>"
    parsed = texts.select(F.posexplode(F.map_entries(F.from_json(column, kind)["labels"])).alias("place", "e")).select("place", F.col("e.key").alias("label"), F.col("e.value").alias("m"))
    either = lambda a, b: F.coalesce(F.col(f"m.{a}"), F.col(f"m.{b}"))
    return parsed.filter("m is not null").select(
        "place", "label", F.coalesce(either("displayName", "display_name"), "label").alias("display_name"), F.coalesce(either("normalizedName", "normalized_name"), "label").alias("normalized_name"),
        either("categorySuggestion", "category_suggestion").alias("category"), either("ingredientId", "ingredient_id").try_cast("bigint").alias("ingredient_id"),
    )


def label_of_names(labels: DataFrame) -> DataFrame:
    """S03, inverse view: normalized_name and its label; of labels with one name the last in the file's order."""
    return labels.filter("normalized_name <> ''").groupBy("normalized_name").agg(F.max_by("label", "place").alias("label"))


def review_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs for review from CSV with a header, all columns as text."""
    kind = ", ".join(f"{c} string" for c in REVIEW)
    rows = spark.read.csv(path, schema=kind, header=True, enforceSchema=True, escape='"', multiLine=True)
    return rows.select(*REVIEW)


def image_files(spark: SparkSession, path: str, extensions: list[str] = IMAGES) -> DataFrame:
    """Path, split and class (the two folders above) of image files; contents aren't read."""
    return inventory(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length"), "path", extensions)


def inventory(files: DataFrame, path: str, extensions: list[str] = IMAGES) -> DataFrame:
    """S07 of a table of paths: those of images, in any case of the extension, with split and class."""
    parts = F.split(path, "/")
    return files.filter(F.lower(path).rlike(rf"\.({'|'.join(extensions)})$")).withColumns({"split": F.try_element_at(parts, F.lit(-3)), "class": F.try_element_at(parts, F.lit(-2))})


def write_csv(df: DataFrame, path: str, *, mark: bool = False) -> None:
    """With a header; each file can begin with a byte order mark, for spreadsheets."""
    first = df.columns[0]
    (df.withColumnRenamed(first, "\ufeff" + first) if mark else df).write.csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def vocabulary_json(df: DataFrame, name: str) -> DataFrame:
    """One row, the JSON of a vocabulary of bounded size: its names in order, how many there are, and rows."""
    whole = df.agg(F.count(F.lit(1)).alias("rowCount"), F.countDistinct(name).alias("distinctNormalizedNames"), F.sort_array(F.collect_set(name)).alias("names"))
    return whole.select(F.to_json(F.struct("rowCount", "distinctNormalizedNames", "names")).alias("value"))


def label_json(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row, the JSON object of a label table of bounded size (one entry for each class), keys in order."""
    entry = F.struct(F.col(key).alias("key"), F.struct(*fields).alias("value"))
    return df.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def reference_names(spark: SparkSession, path: str, field: str = "names") -> DataFrame:
    """The array of names of a JSON file as rows, in order."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<{field}:array<string>>")[field].alias("names"))
    return parsed.select(F.posexplode("names").alias("place", "name")).filter("name is not null")


def remap_entries(spark: SparkSession, path: str, field: str = "remap") -> DataFrame:
    """Old and new class key of each entry of a JSON map whose target is a class key; both spellings of old keys stand for themselves."""
    from larder.functions.text import class_key, label

    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<{field}:map<string,string>>")[field]).alias("old", "new"))
    rows = parsed.withColumn("new", class_key(F.trim("new"))).filter(F.col("new").rlike(r"^ing_\d{5,}$"))
    return rows.select(F.explode(F.array_distinct(F.array(label("old"), class_key("old")))).alias("old"), "new")


def grouped_maps(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """Group, folder and name of the maps of a JSON object of maps (also exact and prefix maps)."""
    kind = "struct<" + ",".join(f"{g}:map<string,string>" for g in groups) + ">"
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("v"))
    rows = [parsed.select(F.lit(g).alias("group"), F.explode(F.col("v")[g]).alias("folder", "name")) for g in groups]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.filter(F.trim("name") != "")
