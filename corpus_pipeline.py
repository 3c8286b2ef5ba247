"""A training corpus from raw documents: five operators of larder.llm, one after another.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the docs of the next.
All but the last give the columns of documents; the last gives the token ids of each document of the mix and the text they decode to.

Defined cases, for all stages: null texts count as empty ones but stay null where a stage keeps them; rows with null ids take part; an empty table gives an
empty one with the same columns; texts of any length are read whole; repeated rows are rows of their own unless a stage says otherwise; extra columns pass, also
under names that operators give to theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import mixing, ngram_join, repeats, sentence_pieces, toxicity
from larder.llm.common import documents, removed, written

#: Near copies: five-word shingles, Jaccard similarity of 4/5 or more.
SHINGLE, SIMILAR = 5, (4, 5)
#: Bytes of a passage that goes when it repeats: in `check_s`, 98.8 of 100 runs of 51 words have so many.
PASSAGE = 250


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the used ones under names that no operator gives, and the columns that give docs back."""
    names = {c: c if c in used else f"_column_{k}" for k, c in enumerate(docs.columns)}
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    return docs.select([quoted(c).alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar of operator 1 predicts to be toxic go; null and empty texts stay, since nothing is matched in them. A score of exactly one half is toxic. Repeated rows
    share their fate. Without labels of both kinds the seed words and prior weights decide."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, own = apart(docs, "doc_id", "text")
    return toxicity.score(rows, lexicon).filter("predicted = 0").select(own)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, of several rows with that id and text one by a
    hash of all columns, maps as their sorted entries; rows that are alike in all of them are one row. Texts without words, null ones too, all stay; null ids come last."""
    found = ngram_join.jaccard_components(docs, k=SHINGLE, num=SIMILAR[0], den=SIMILAR[1])
    stay = found.filter("representative").select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"), "n_shingles").distinct()
    rows, own = apart(docs, "doc_id", "text")
    rows = rows.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(stay, (F.col("_hash") == F.col("stay_hash")) & F.col("doc_id").eqNullSafe(F.col("stay_id")))
    # Hashes can't read maps.
    columns = [F.to_json(F.array_sort(F.map_entries(c))) if kind.startswith("map") else F.col(c) for c, kind in rows.dtypes]
    one = F.min_by(F.struct(*rows.columns), F.xxhash64(*columns)).alias("one")
    repeated = kept.filter("n_shingles > 0").groupBy("stay_id", "stay_hash").agg(one).select("one.*")
    return repeated.unionByName(kept.filter("n_shingles = 0").select(repeated.columns)).select(own)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages of PASSAGE bytes or more that operator 5 finds to repeat; n_chars follows. All documents stay."""
    found = repeats.repeated_strings(docs.select("text"), length=PASSAGE).select("h1", "h2", "kept")
    rows, own = apart(docs, "doc_id", "text", "n_chars")
    rows = repeats.keyed(rows).join(found, ["h1", "h2"], "left").withColumn("text", F.coalesce("kept", "text"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often in the result as the mix of operator 3 takes it: not at all, once or twice. Documents without words (null texts) cost nothing
    and stay if their rank falls below the end of the sample; a null source is a source. Ties in rank go to the smaller id, then the smaller text hash, and reruns agree."""
    rows, own = apart(docs, "doc_id", "text", "source")
    rows = mixing.sized(rows)
    sizes = written(rows.select("size", *mixing.OWN), "mix-sizes")
    mixed = mixing.mix(rows, sizes=sizes)
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(own)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded and restored of each document of the mix, by operator 6: a row for each row, null texts as empty ones; extra columns are left behind."""
    import public_tokenizers

    return sentence_pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs="ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_array_dedup", remove_repeated_passages),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: Suffix order, grammars and token ids have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written; a stage's table goes once the next one has been written from it. The last one's table stays, since the result reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "written_to"):
            removed(before)
    return docs
