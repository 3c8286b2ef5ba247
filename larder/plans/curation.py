"""Queries of training-set curation; a document's source stands for its class and its language for its split."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import datasets
from larder.plans.base import query, table

SPLITS = ["en", "fr", "de"]
COVERAGE = "SELECT source, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'fr') AS n_fr, count(*) FILTER (WHERE lang = 'de') AS n_de, count(*) AS total FROM documents GROUP BY source"


@query("a08", COVERAGE)
def a08(spark, d):
    return datasets.coverage(table(spark, d, "documents"), "source", "lang", SPLITS)


@query("w04", "SELECT doc_id, source, lang, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) WHERE k > 10")
def w04(spark, d):
    return datasets.over_cap(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], 10)


@query("w09", f"""
WITH e AS ({COVERAGE}), n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE lang = 'es')
SELECT n.doc_id, n.source, CASE WHEN k <= greatest(0, 30 - n_en) THEN 'en' WHEN k <= greatest(0, 30 - n_en) + greatest(0, 30 - n_fr) THEN 'fr'
  WHEN k <= greatest(0, 30 - n_en) + greatest(0, 30 - n_fr) + greatest(0, 30 - n_de) THEN 'de' ELSE 'overflow' END AS target FROM n LEFT JOIN e USING (source)""")
def w09(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    have = datasets.coverage(docs, "source", "lang", SPLITS).drop("total")
    return datasets.fill_capacity(docs.filter("lang = 'es'").drop("lang"), have, "source", ["doc_id"], SPLITS, 30)


@query("w10", """
WITH g AS (SELECT DISTINCT p_name FROM part), n AS (SELECT count(*) AS n FROM g),
k AS (SELECT p_name, row_number() OVER (ORDER BY CAST(('0x' || substr(md5('7|' || p_name), 1, 15)) AS BIGINT), p_name) AS k FROM g)
SELECT p_partkey, p_name, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM part JOIN k USING (p_name), n""")
def w10(spark, d):
    return datasets.group_split(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", {"train": 0.8, "val": 0.1}, "test", 7)


@query("c16", f"SELECT source, n_en, n_fr, n_de, total, n_en < 25 AS needs FROM ({COVERAGE})")
def c16(spark, d):
    docs = table(spark, d, "documents")
    return datasets.gaps(docs.select("source").distinct(), docs, "source", "lang", SPLITS, least=25, all_rows=True)


@query("j12", """
SELECT p_partkey, p_name, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 1) THEN 'exact ' || p_name ELSE 'prefix ' || split_part(p_name, ' ', 1) END AS value FROM part""")
def j12(spark, d):
    part = table(spark, d, "part")
    exact = part.filter("p_size = 1").select(F.col("p_name").alias("name")).distinct().withColumn("value", F.concat(F.lit("exact "), F.col("name")))
    prefixes = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).distinct().withColumn("value", F.concat(F.lit("prefix "), F.col("name")))
    return datasets.longest_prefix(part.select("p_partkey", "p_name"), "p_partkey", "p_name", exact, prefixes)


@query("s10", """
SELECT page_id, CAST(i AS INTEGER) AS place, links[i] AS url FROM (
  SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS links, unnest(range(1, len(regexp_extract_all(html, 'href="([^"]+)"', 1)) + 1)) AS i FROM pages)""")
def s10(spark, d):
    from larder.sources.pages import page_links

    return page_links(table(spark, d, "pages"), "page_id", "html")
