"""Queries of joins, aggregates, windows, sorts and set operations over the star schema.

part stands for the ingredient master, lineitem for recipe lines and substitution edges, orders and documents for recipes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import paging, recipes, resolve, tables
from larder.plans.base import query, table

MERGE = "SELECT p_partkey AS old_id, min(p_partkey) OVER (PARTITION BY p_name) AS keep_id, p_name FROM part WHERE p_name IS NOT NULL AND p_name <> ''"
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _map(spark, d) -> DataFrame:
    return resolve.merge_map(table(spark, d, "part"), "p_partkey", "p_name")


@query("w01", MERGE)
def w01(spark, d):
    return _map(spark, d)


DEDUP = f"""
SELECT l_orderkey, keep_id AS l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM (
  SELECT l.*, m.keep_id, row_number() OVER (PARTITION BY l_orderkey, keep_id ORDER BY CASE WHEN l_partkey = keep_id THEN 0 ELSE 1 END,
         {", ".join(LINE)}) AS k
  FROM lineitem l JOIN ({MERGE}) m ON l.l_partkey = m.old_id) WHERE k = 1"""


@query("w02", DEDUP)
def w02(spark, d):
    rows = resolve.dedup_children(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", _map(spark, d))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")


EDGES = f"""
SELECT DISTINCT a.keep_id AS base, coalesce(b.keep_id, l.l_suppkey) AS sub, l.l_returnflag AS context
FROM lineitem l JOIN ({MERGE}) a ON l.l_partkey = a.old_id LEFT JOIN ({MERGE}) b ON l.l_suppkey = b.old_id"""


def _edges(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_partkey").alias("base"), F.col("l_suppkey").alias("sub"), F.col("l_returnflag").alias("context"))


@query("w03", EDGES)
def w03(spark, d):
    return resolve.dedup_edges(resolve.rewrite_edges(_edges(spark, d), "base", "sub", _map(spark, d)), "base", "sub", "context")


@query("w08", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def w08(spark, d):
    last = resolve.first_by(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return last.select("o_custkey", "o_orderkey", "o_totalprice")


@query("w07", "SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def w07(spark, d):
    return resolve.first_occurrence(table(spark, d, "documents").select("doc_id", "text"), F.lower(F.trim("text")), "doc_id")


@query("p02", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type ELSE coalesce(nullif(p_name, ''), p_type) END AS name FROM part")
def p02(spark, d):
    name = F.when(F.col("p_size") > 25, F.lit("")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", tables.or_else(name, "p_type").alias("name"))


@query("p03", "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS new_name FROM part WHERE p_size > 25 AND p_name IS DISTINCT FROM upper(p_name)")
def p03(spark, d):
    new = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name"))
    return tables.changed(table(spark, d, "part").select("p_partkey", "p_name", new.alias("new_name")), "p_name", "new_name")


@query("p09", """
WITH wanted AS (SELECT s_suppkey * 7 % 1000 AS id, s_suppkey AS pos FROM supplier), first AS (SELECT id, min(pos) AS pos FROM wanted GROUP BY id)
SELECT p_partkey, p_name, pos FROM part JOIN first ON p_partkey = id""")
def p09(spark, d):
    wanted = table(spark, d, "supplier").select((F.col("s_suppkey") * 7 % 1000).alias("p_partkey"), F.col("s_suppkey").alias("pos"))
    return tables.in_listed_order(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", wanted, "pos")


@query("p10", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def p10(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return tables.members(orders, "o_orderkey", table(spark, d, "lineitem").filter("l_quantity >= 45"), "l_orderkey")


@query("p11", "SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL AND p_name <> ''")
def p11(spark, d):
    return resolve.named(table(spark, d, "part"), "p_name").select("p_partkey", "p_name")


@query("j01", "SELECT l_orderkey, o_orderpriority, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j01(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return tables.enriched(lines, "l_orderkey", table(spark, d, "orders"), "o_orderkey", ["o_orderpriority"])


@query("j02", "SELECT c_custkey, coalesce(n_name, '') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def j02(spark, d):
    nation = table(spark, d, "nation").filter("n_regionkey <> 2")
    return tables.with_default(table(spark, d, "customer"), "c_nationkey", nation, "n_nationkey", {"n_name": ""}).select("c_custkey", "n_name")


@query("j03", "SELECT p_partkey, CASE WHEN p_size > 25 AND p_name IS DISTINCT FROM lower(p_type) THEN lower(p_type) ELSE p_name END AS p_name FROM part")
def j03(spark, d):
    part = table(spark, d, "part")
    patches = part.select("p_partkey", F.when(F.col("p_size") > 25, F.lower("p_type")).alias("new_name"))
    return resolve.patch(part, "p_partkey", "p_name", patches, "new_name").select("p_partkey", "p_name")


@query("j04", f"SELECT l_orderkey, l_linenumber, l_quantity, coalesce(keep_id, l_partkey) AS l_partkey FROM lineitem LEFT JOIN ({MERGE}) ON l_partkey = old_id")
def j04(spark, d):
    return resolve.rewrite(table(spark, d, "lineitem"), "l_partkey", _map(spark, d)).select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")


@query("j05", f"""
SELECT coalesce(a.keep_id, l_partkey) AS base, coalesce(b.keep_id, l_suppkey) AS sub, l_returnflag AS context
FROM lineitem LEFT JOIN ({MERGE}) a ON l_partkey = a.old_id LEFT JOIN ({MERGE}) b ON l_suppkey = b.old_id""")
def j05(spark, d):
    return resolve.rewrite_edges(_edges(spark, d), "base", "sub", _map(spark, d))


@query("j08", f"SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT old_id FROM ({MERGE}) WHERE old_id <> keep_id)")
def j08(spark, d):
    return resolve.without_merged(table(spark, d, "part"), "p_partkey", _map(spark, d)).select("p_partkey", "p_name")


@query("j09", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j09(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return tables.without_children_of(lines, "l_orderkey", table(spark, d, "orders").filter("o_orderstatus = 'F'"), "o_orderkey")


@query("j10", "SELECT id AS o_orderkey FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 1000 FROM orders) + 1)) AS id) WHERE id NOT IN (SELECT o_orderkey FROM orders)")
def j10(spark, d):
    orders = table(spark, d, "orders")
    return recipes.missing_ids(spark, orders, "o_orderkey", 0, orders.agg(F.max("o_orderkey")).scalar() + 1000)


@query("j11", """
WITH l AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size <> 3),
r AS (SELECT p_partkey AS id, CASE WHEN p_size = 7 THEN p_type ELSE p_name END AS name FROM part WHERE p_size <> 4)
SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'missing' WHEN l.id IS NULL THEN 'extra' ELSE 'name' END AS issue
FROM l FULL JOIN r ON l.id = r.id WHERE l.id IS NULL OR r.id IS NULL OR l.name IS DISTINCT FROM r.name""")
def j11(spark, d):
    part = table(spark, d, "part")
    left = part.filter("p_size <> 3").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    right = part.filter("p_size <> 4").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") == 7, F.col("p_type")).otherwise(F.col("p_name")).alias("name"))
    return tables.audited(left, right, "id", "name")


@query("j18", "SELECT p_partkey, p_name FROM part WHERE p_name NOT IN (SELECT DISTINCT p_name FROM part WHERE p_size = 1)")
def j18(spark, d):
    part = table(spark, d, "part")
    return tables.outside_vocabulary(part.select("p_partkey", "p_name"), "p_name", part.filter("p_size = 1"), "p_name")


@query("j19", "SELECT p_partkey AS old_id, new_id FROM part LEFT JOIN (SELECT p_name, min(p_partkey) AS new_id FROM part WHERE p_size > 45 GROUP BY p_name) USING (p_name)")
def j19(spark, d):
    part = table(spark, d, "part")
    return resolve.old_to_new(part, part.filter("p_size > 45"), "p_partkey", "p_name")


@query("a01", "SELECT count(*) AS n_rows, count(DISTINCT CASE WHEN p_name <> '' THEN p_name END) AS n_names FROM part")
def a01(spark, d):
    return tables.row_counts(table(spark, d, "part"), "p_name")


GROUPS = "SELECT p_name, count(*) AS row_count, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part WHERE p_name <> '' GROUP BY p_name HAVING count(*) > 1"


@query("a02", GROUPS)
def a02(spark, d):
    return resolve.duplicate_groups(table(spark, d, "part"), "p_partkey", "p_name")


@query("t01", f"{GROUPS} ORDER BY row_count DESC, p_name LIMIT 50")
def t01(spark, d):
    return resolve.duplicate_groups(table(spark, d, "part"), "p_partkey", "p_name", 50)


PAGES = """
SELECT p_name, row_count, CAST((k - 1) // 4 AS INTEGER) AS page, string_agg(p_partkey, ',' ORDER BY p_partkey) AS ids FROM (
  SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS row_count, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_name <> '') WHERE row_count > 1"""


@query("a02_pages", f"{PAGES} GROUP BY ALL")
def a02_pages(spark, d):
    return paging.duplicate_pages(table(spark, d, "part"), "p_partkey", "p_name", size=4).withColumn("ids", F.array_join("ids", ","))


@query("t01_pages", f"{PAGES} AND p_name IN (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 50) GROUP BY ALL")
def t01_pages(spark, d):
    return paging.duplicate_pages(table(spark, d, "part"), "p_partkey", "p_name", limit=50, size=4).withColumn("ids", F.array_join("ids", ","))


@query("a03", """
SELECT l_orderkey, count(DISTINCT l_returnflag) AS names, string_agg(DISTINCT l_returnflag, ' | ' ORDER BY l_returnflag) AS listed
FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1""")
def a03(spark, d):
    return resolve.conflicts(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("a04", "SELECT p_partkey, min(p_name) AS p_name FROM part GROUP BY p_partkey")
def a04(spark, d):
    return resolve.checked_names(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")


@query("a05", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name")
def a05(spark, d):
    return tables.vocabulary_counts(table(spark, d, "part"), "p_name")


@query("a10", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def a10(spark, d):
    return recipes.ranked_duplicates(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id")


@query("a11", "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS members, CAST(sum(n - 1) AS BIGINT) AS deletions FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def a11(spark, d):
    return recipes.duplicate_summary(table(spark, d, "documents"), ["text"])


@query("c05", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def c05(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return recipes.dedup_recipes(docs, {}, keys=["text"], recipe_id="doc_id")["deleted"]


@query("t02", "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS new_p_name FROM part WHERE p_size > 25 AND p_name IS DISTINCT FROM upper(p_name) ORDER BY p_partkey LIMIT 50")
def t02(spark, d):
    return tables.preview(table(spark, d, "part"), "p_partkey", "p_name", F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")))


@query("t03", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 50")
def t03(spark, d):
    return tables.sample(table(spark, d, "orders"), "o_orderkey", ["o_orderpriority"])


@query("t07", "SELECT p_partkey, p_name, CASE WHEN p_size < 5 THEN 0 ELSE 1 END AS need FROM part ORDER BY need, p_partkey LIMIT 500")
def t07(spark, d):
    return tables.needy_first(table(spark, d, "part"), "p_partkey", F.col("p_size") < 5).select("p_partkey", "p_name", "need").limit(500)


@query("u02", f"""
SELECT 'rows' AS metric, count(*) AS n FROM part UNION ALL SELECT 'names', count(DISTINCT p_name) FROM part
UNION ALL SELECT 'merged', count(*) FROM ({MERGE}) WHERE old_id <> keep_id UNION ALL SELECT 'lines', count(*) FROM lineitem""")
def u02(spark, d):
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    return tables.report({"rows": part, "names": (part, "p_name"), "merged": _map(spark, d).filter("old_id <> keep_id"), "lines": lines})


@query("u01", "SELECT DISTINCT l_partkey AS id, l_returnflag AS name FROM lineitem UNION SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def u01(spark, d):
    return tables.unpivoted(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("u03", """
SELECT p_partkey AS id, 'left' AS side FROM part WHERE p_size <= 30 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 20)
UNION ALL SELECT p_partkey, 'right' FROM part WHERE p_size >= 20 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 30)""")
def u03(spark, d):
    part = table(spark, d, "part")
    left, right = (part.filter(x).select(F.col("p_partkey").alias("id")) for x in ("p_size <= 30", "p_size >= 20"))
    return tables.id_difference(left, right, "id")


@query("u04", "SELECT DISTINCT p_name FROM part WHERE p_name <> ''")
def u04(spark, d):
    return tables.distinct_names(table(spark, d, "part"), "p_name")


@query("u05", """
SELECT p_partkey, p_name FROM part WHERE p_size > 20
UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_size <= 22 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 20)""")
def u05(spark, d):
    part = table(spark, d, "part")
    return resolve.insert_absent(part.filter("p_size > 20").select("p_partkey", "p_name"), part.filter("p_size <= 22").select("p_partkey", F.upper("p_name").alias("p_name")), "p_partkey")


@query("s16", "SELECT p_name AS value FROM part WHERE p_name IS NOT NULL AND p_name <> ''")
def s16(spark, d):
    return tables.name_lines(table(spark, d, "part"), "p_name")


@query("c02", f"""
SELECT 'lines' AS part, l_orderkey AS a, l_partkey AS b, CAST(l_quantity AS VARCHAR) AS value FROM ({DEDUP})
UNION ALL SELECT 'edges', base, sub, context FROM ({EDGES}) WHERE base <> sub
UNION ALL SELECT DISTINCT 'master', keep_id, NULL, p_name FROM ({MERGE})""")
def c02(spark, d):
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    out = resolve.normalize_and_merge(part, {"lines": (lines, "l_orderkey", "l_partkey")}, {}, _edges(spark, d), key="p_partkey", name="p_name", base="base", sub="sub", context="context")
    rows = lambda name, a, b, value: out[name].select(F.lit(name).alias("part"), F.col(a).alias("a"), b.cast("long").alias("b"), F.col(value).cast("string").alias("value"))
    lines_out, edges_out = rows("lines", "l_orderkey", F.col("l_partkey"), "l_quantity"), rows("edges", "base", F.col("sub"), "context")
    return lines_out.unionByName(edges_out).unionByName(rows("master", "p_partkey", F.lit(None), "p_name"))


@query("c02_raw", """
WITH m AS (SELECT p_partkey, replace(p_name, ' ', '') AS name, min(p_partkey) OVER (PARTITION BY replace(p_name, ' ', '')) AS keep_id FROM part)
SELECT 'lines' AS part, l_orderkey AS a, keep_id AS b FROM (SELECT DISTINCT l_orderkey, keep_id FROM lineitem JOIN m ON l_partkey = p_partkey)
UNION ALL SELECT DISTINCT 'master', keep_id, NULL FROM m""")
def c02_raw(spark, d):
    from larder.operators.jobs import normalize_ingredients

    raw = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("다진 것 ")).otherwise(F.lit(" 굵은")), F.col("p_name"), F.lit("\n"), F.col("p_type"))
    master = table(spark, d, "part").select("p_partkey", raw.alias("canonical_name"), F.lit(None).cast("string").alias("normalized_name"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    edges = lines.select(F.col("l_partkey").alias("base"), F.col("l_orderkey").alias("sub")).limit(0)
    out = normalize_ingredients(master, {"lines": (lines, "l_orderkey", "l_partkey")}, {}, edges, key="p_partkey", canonical="canonical_name", name="normalized_name", base="base", sub="sub", context=None)
    rows = out["lines"].select(F.lit("lines").alias("part"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return rows.unionByName(out["master"].select(F.lit("master").alias("part"), F.col("p_partkey").alias("a"), F.lit(None).cast("long").alias("b")))


@query("flagship", f"SELECT keep_id, p_name, count(DISTINCT l_orderkey) AS n_recipes FROM lineitem JOIN ({MERGE}) ON l_partkey = old_id GROUP BY keep_id, p_name")
def recipes_per_ingredient(spark, d):
    """Merge ingredients by name, rewrite and deduplicate recipe lines, count recipes."""
    mapping = _map(spark, d)
    lines = table(spark, d, "lineitem")
    rows = lines.join(mapping, lines.l_partkey == mapping.old_id).select("l_orderkey", "keep_id", "p_name").distinct()
    return rows.groupBy("keep_id", "p_name").agg(F.count(F.lit(1)).alias("n_recipes"))


@query("j15", """
WITH old AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), byk AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS k FROM old GROUP BY ALL),
byt AS (SELECT o_orderpriority, min(o_orderkey) AS t FROM old WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_orderkey, coalesce(k, t) AS matched_id FROM orders LEFT JOIN byk USING (o_custkey, o_orderdate) LEFT JOIN byt USING (o_orderpriority)""")
def j15(spark, d):
    orders = table(spark, d, "orders")
    old = orders.filter("o_orderkey % 3 <> 0")
    # Titles count only for recipes of status F here, so both sides of the fallback occur.
    known = old.withColumn("title", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    rows = orders.withColumn("title", F.col("o_orderpriority"))
    return recipes.match_existing(rows, known, "o_custkey", "o_orderdate", "title", "o_orderkey").select("o_orderkey", "matched_id")


@query("w05", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders WHERE o_orderstatus <> 'P'""")
def w05(spark, d):
    from larder.operators.ordinals import ordinals

    return ordinals(table(spark, d, "orders").filter("o_orderstatus <> 'P'"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "ordinal")

