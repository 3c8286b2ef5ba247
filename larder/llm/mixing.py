"""Operator 3: mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target number of words. A document is taken ``floor(rate)`` times for certain, with
``rate = target / source size``; the rest of the target is filled by a Pareto sample: documents are ranked
by their random odds ``u / (1 - u)`` divided by their inclusion odds, and the smallest ranks are taken until the words that are left are
filled, to the nearest document. The inclusion odds are those of the fractional part ``p`` of their source's rate, ``p / (1 - p)``, times the
root of the document's size by its source's mean size: between equal chances and chances by size, so that longer documents are likelier.
Random numbers are MD5 values of seed, id and text, so reruns agree.

No source is ever sorted as a whole: ranks fall into fixed bins, word sums by (source, bin) find the one
bin in which a source's sample ends, and only the rows of that bin are ordered.

Defined cases: null or empty texts have size 0; documents of size 0 cost nothing and are taken when their
rank falls below the end of the sample; a null source is a source of its own, ordered last; a source without
words has target 0; ties in rank go to the smaller id, then the smaller text hash; repeated rows are sampled
independently of their number but share their random number, so they are taken together unless the sample
ends between them; an empty table gives an empty result. Input columns named like outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import WORD, documents, written

BINS = 4096
#: Largest number of sources whose plan is broadcast (a row of it has about 100 bytes).
BROADCAST_SOURCES = 20_000
WEIGHTS = (3, 1, 2)
OWN = ("_key", "_u", "_tie")


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, *, seed: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Adds size (words), a source key and a random number in (0, 1) to each document."""
    text_hash = F.md5(F.coalesce(F.col(text), F.lit("")))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text_hash)), 1, 12)
    return docs.withColumns({
        "size": word_count(text),
        "_key": F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source))),
        "_u": (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48),
        "_tie": text_hash,
    })


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each source: size, target, certain copies, words left for the sample.

    The targets share ``total`` times all words by weight; none is above ``cap`` times its source's size. With the
    sources in order of cap / weight, the first k are at their caps, for the smallest k whose common level fits.
    """
    by_source = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    in_order = Window.orderBy(F.col("_key") == "0", "_key")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ratio = Window.orderBy("_ratio", "_key")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        by_source.withColumn("_w", cycle)
        .withColumn("_cap", F.col("source_size") * F.lit(cap))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(total))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_free", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
        .withColumn("_common", F.first("_free", ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_common") * F.col("_w"), F.col("_cap")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        level.withColumn("target", target)
        .withColumn("_whole", F.floor(rate))
        .withColumn("_p", rate - F.col("_whole"))
        .withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_mean", F.col("source_size") / F.col("_n"))
        .select("_key", "source_size", "target", "_whole", "_p", "_left", "_mean")
    )


def _with_plan(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    return rows.join(F.broadcast(plan) if n <= BROADCAST_SOURCES else plan, "_key")


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds the Pareto rank q as q / (1 + q), and its bin; sources without a sample get the last place."""
    odds = F.col("_u") / (1 - F.col("_u"))
    favour = F.sqrt(F.greatest(F.col("size"), F.lit(1)) / F.col("_mean"))
    q = F.when((F.col("_p") > 0) & (F.col("_mean") > 0), odds * (1 - F.col("_p")) / F.col("_p") / favour)
    place = F.coalesce(q / (1 + q), F.lit(1.0))
    return rows.withColumn("_place", place).withColumn("_bin", F.least(F.floor(F.col("_place") * BINS), F.lit(BINS - 1)))


def mix(docs: DataFrame, *, sizes: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, cap: float = 2.0, doc_id: str = "doc_id") -> DataFrame:
    """docs (from ``sized``) with source_size, target and copies, the number of times that the mix holds the row.

    sizes: the columns _key, _u, _tie and size of docs if they are at hand as a written table, else they are computed.
    """
    sizes = docs.select("size", *OWN) if sizes is None else sizes
    plan = written(targets(sizes, weights=weights, total=total, cap=cap), "mix-targets")
    n = plan.count()
    bins = _ranked(_with_plan(sizes, plan, n)).groupBy("_key", "_bin").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("_key").orderBy("_bin")
    ends = (
        _with_plan(bins, plan.select("_key", "_p", "_left"), n)
        .withColumn("_after", F.sum("_words").over(upto))
        .filter((F.col("_p") > 0) & (F.col("_after") > F.col("_left")))
        .groupBy("_key")
        .agg(F.min_by(F.struct("_bin", (F.col("_after") - F.col("_words")).alias("_before")), "_bin").alias("_end"))
    )
    plan = written(plan.join(ends, "_key", "left"), "mix-plan")
    rows = _ranked(_with_plan(docs.drop("source_size", "target", "copies"), plan, n))
    end = F.coalesce(F.col("_end._bin"), F.lit(BINS))
    inside = rows.filter(F.col("_bin") != end).withColumn("_taken", (F.col("_bin") < end) & (F.col("_p") > 0))
    order = Window.partitionBy("_key").orderBy("_place", doc_id, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        rows.filter(F.col("_bin") == end)
        .withColumn("_prior", F.col("_end._before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
        .withColumn("_taken", (F.col("_prior") + F.col("size") / 2 <= F.col("_left")) & (F.col("_p") > 0))
        .drop("_prior")
    )
    return (
        inside.unionByName(edge)
        .withColumn("copies", F.col("_whole") + F.col("_taken").cast("long"))
        .drop("_whole", "_p", "_left", "_mean", "_end", "_place", "_bin", "_taken", *OWN)
    )


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text")
    rows = written(docs, "mix-sizes")
    return mix(rows, sizes=rows).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         md5(coalesce(text, '')) AS tie,
         (CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 12)) AS BIGINT) + 0.5)
           / 281474976710656.0 AS u
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
         (CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS everything, source_size * 2.0::DOUBLE AS cap,
         (coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source IS NULL DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS capped,
         sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source IS NULL DESC, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM by_source),
common AS (SELECT min_by((everything - capped) / weight_left, cap / w) AS level FROM levels WHERE (everything - capped) / weight_left <= cap / w),
targets AS (SELECT l.source, l.source_size, l.source_size / l.n AS mean, l.w, least(l.cap, coalesce(c.level * l.w, l.cap)) AS target FROM levels l, common c),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
ranked AS (
  SELECT d.*, r.source_size, r.target, r.mean, floor(r.rate) AS whole, r.rate - floor(r.rate) AS p, r.target - floor(r.rate) * r.source_size AS rest
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 AND mean > 0 THEN u / (1 - u) * (1 - p) / p / sqrt(greatest(size, 1) / mean) END, doc_id, tie
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM ranked)
SELECT doc_id, source, size, source_size, target,
       CAST(whole + CASE WHEN p > 0 AND prior + size / 2.0 <= rest THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM placed
"""
