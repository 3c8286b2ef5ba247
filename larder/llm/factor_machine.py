"""Operator 12: quality classifier by a factorisation machine.

A document is a sparse vector of three fields, each of length 1: its distinct words, hashed to BUCKETS places; binned statistics of its structure;
binned or hashed metadata columns, where the caller names any. The score is w0 + sum of w_i x_i + the pairwise interactions <v_i, v_j> x_i x_j of all places,
which for each factor are (sum of v_i x_i)^2 - sum of (v_i x_i)^2, halved: linear in the places of a document. A logistic curve makes it a probability.

The machine is fitted by AdaGrad on the driver over a bounded sample of labelled rows (LOW_ROWS of quality 0, HIGH_ROWS of quality 1, by hashes; rows weigh so
that classes keep their shares among all labels); Spark finds the sample and its features. Held-out rows are never learned from. The fitted
machine, (BUCKETS + PLACES) x (FACTORS + 1) floats whatever the corpus, is broadcast, and documents are scored in Arrow batches.

Defined cases: null and empty texts have no words and get the score of their structure and metadata; null metadata are a value of their own; rows with null label or
id aren't learned from, and a null id is held in; contradicting labels both count; without labels of both kinds
every score is the share of label 1 (a half without labels); repeated rows get equal scores; an empty table gives an empty result;
columns named score or predicted are replaced, others are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import documents, or_empty, small_batches
from larder.llm.toxicity import held_out

#: Bounds of the labelled sample.
LOW_ROWS, HIGH_ROWS = 3_000, 5_000
BUCKETS, FACTORS = 1 << 16, 8
#: Places after the buckets: bins of statistics, then of metadata.
STATISTICS = ("words", "word_length", "line_length", "dup_lines", "repeated_words", "same_as_last", "open_ends", "upper", "digits", "symbols", "exclaims", "pipes", "other_bytes")
BINS, METADATA_BINS = 16, 1 << 10
SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9])
PLACES = len(STATISTICS) * BINS + METADATA_BINS
#: Words that a worker remembers the places of.
MEMORY = 500_000
SYMBOLS = b"#*$%&|<>"


class Features:
    """Places and values of documents; keeps the places of words it has met."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def word(self, word: str) -> int:
        if (at := self.known.get(word)) is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            at = self.known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        return at

    def statistics(self, text: str, words: list[str], distinct: int) -> list[int]:
        """A bin for each of STATISTICS."""
        data = text.encode("utf-8", "surrogatepass")
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        n, size, lines = max(1, len(words)), max(1, len(data)), [x for x in text.split("\n") if x]
        shares = [
            1 - len(set(lines)) / max(1, len(lines)), 1 - distinct / n, sum(map(eq, words, words[1:])) / n, sum(not w[-1].isalnum() for w in words) / n,
            counts[65:91].sum() / size, counts[48:58].sum() / size, counts[list(SYMBOLS)].sum() / n, counts[33] / n, counts[124] / n, counts[128:].sum() / size,
        ]
        sizes = [np.log2(len(words) + 1), 2 * np.log2(size / n), np.log2(size / max(1, len(lines)))]
        return [min(BINS - 1, int(x)) for x in sizes] + np.searchsorted(SHARES, shares, "left").tolist()

    def of(self, text: str, metadata: list) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        distinct = set(words)
        hashed = sorted({self.word(w) for w in distinct})
        bins = [self.buckets + k * BINS + b for k, b in enumerate(self.statistics(text, words, len(distinct)))]
        base = self.buckets + len(STATISTICS) * BINS
        given = sorted({base + zlib.crc32(f"{k}={self.value(v)}".encode("utf-8", "surrogatepass")) % METADATA_BINS for k, v in enumerate(metadata)})
        values = [np.full(len(part), 1 / np.sqrt(len(part))) for part in (hashed, bins, given) if part]
        return np.array([*hashed, *bins, *given], np.int64), np.concatenate(values)

    @staticmethod
    def value(v) -> str:
        """Numbers by the half powers of two."""
        if isinstance(v, (int, float)) and not isinstance(v, bool) and np.isfinite(v):
            return f"{np.sign(v):.0f}:{int(2 * np.log2(abs(v) + 1))}"
        return str(v)


@dataclass
class Machine:
    offset: float
    linear: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + PLACES, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + PLACES, FACTORS), np.float32))

    def margins(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the curve of documents whose places begin at starts; no document is without places."""
        terms = self.factors[places] * values[:, None]
        sums, squares = np.add.reduceat(terms, starts, axis=0), np.add.reduceat(terms * terms, starts, axis=0)
        return self.offset + np.add.reduceat(self.linear[places] * values, starts) + 0.5 * (sums * sums - squares).sum(1)

    def probabilities(self, documents_: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not documents_:
            return np.zeros(0)
        sizes = [len(p) for p, _ in documents_]
        m = self.margins(*(np.concatenate(x) for x in zip(*documents_, strict=True)), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, *, epochs: int = 12, steps: int = 2_000, batch: int = 64, rate: float = 0.1, ridge: float = 1e-4, seed: int = 7) -> Machine:
    """AdaGrad over batches of documents, epochs times and for so many steps at least; reruns give the same machine."""
    rng, share = np.random.default_rng(seed), float((weights * labels).sum() / weights.sum())
    out = Machine(float(np.log(share / (1 - share))))
    n = len(out.linear)
    out.linear = np.zeros(n)
    out.factors = rng.normal(0, 0.05, (n, FACTORS))
    seen_linear, seen_factors, seen_offset = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    dealt = rng.permutation(len(rows))
    parts = []
    for at in range(0, len(rows), batch):
        mine = dealt[at : at + batch]
        places, values = (np.concatenate([rows[i][k] for i in mine]) for k in (0, 1))
        sizes = np.array([len(rows[i][0]) for i in mine])
        order = np.argsort(places, kind="stable")
        known, first = np.unique(places[order], return_index=True)
        parts.append((places, values, np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(mine)), sizes), order, known, first, labels[mine], weights[mine]))
    for _ in range(max(epochs, -(-steps // len(parts)))):
        for k in rng.permutation(len(parts)):
            places, values, starts, of, order, known, first, y, weight = parts[k]
            terms = out.factors[places] * values[:, None]
            sums = np.add.reduceat(terms, starts, axis=0)
            margin = out.offset + np.add.reduceat(out.linear[places] * values, starts) + 0.5 * (sums * sums - np.add.reduceat(terms * terms, starts, axis=0)).sum(1)
            wrong = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
            pull = (wrong[of] * values)[order]
            linear = np.add.reduceat(pull, first) + ridge * out.linear[known]
            factors = np.add.reduceat(pull[:, None] * (sums[of] - terms)[order], first, axis=0) + ridge * out.factors[known]
            seen_linear[known] += linear**2
            seen_factors[known] += factors**2
            seen_offset += wrong.sum() ** 2
            out.linear[known] -= rate * linear / np.sqrt(seen_linear[known])
            out.factors[known] -= rate * factors / np.sqrt(seen_factors[known])
            out.offset -= rate * wrong.sum() / np.sqrt(seen_offset)
    out.linear, out.factors = out.linear.astype(np.float32), out.factors.astype(np.float32)
    return out


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", metadata: tuple[str, ...] = (), low_rows: int = LOW_ROWS, high_rows: int = HIGH_ROWS) -> Machine:
    """A machine from docs (doc_id, text, metadata) and labels (doc_id, quality), held-out rows left aside."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().filter(~held_out()).filter("quality in (0, 1)")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        return Machine(float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)))
    order = [F.xxhash64(F.lit("quality"), "doc_id"), F.col("doc_id")]
    chosen = known.filter("quality = 0").orderBy(*order).limit(low_rows).unionByName(known.filter("quality = 1").orderBy(*order).limit(high_rows))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Features()
        for batch in batches:
            given = [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
            found = [tool.of(t, [c[i] for c in given])[0].astype(np.int32).tobytes() for i, t in enumerate(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(found, pa.binary())], ["quality", "tie", "places"])

    # At most low_rows + high_rows ids are broadcast; their texts are dealt out anew, as they can stand in few files.
    rows = docs.select("doc_id", or_empty(text).alias("text"), *metadata).join(F.broadcast(chosen), "doc_id").select("quality", "text", *metadata).repartition(12)
    # Ids can stand in many rows, so the bound is set once more.
    held = rows.mapInArrow(sample, "quality int, tie long, places binary").orderBy("tie", "quality").limit(low_rows + high_rows).collect()
    y = np.array([r["quality"] for r in held], np.float64)
    if len(set(y.tolist())) < 2:
        return Machine(float(np.log(counts[1] / counts[0])))
    places = [np.frombuffer(r["places"], np.int32).astype(np.int64) for r in held]
    total = sum(counts.values())
    weights = np.where(y == 1, counts[1] / total / y.mean(), counts[0] / total / (1 - y.mean()))
    return fit([(p, _values(p)) for p in places], y, weights)


def _values(places: np.ndarray) -> np.ndarray:
    """Values as Features.of() gives them: each field has length 1."""
    part = np.searchsorted([BUCKETS, BUCKETS + len(STATISTICS) * BINS], places, "right")
    return 1 / np.sqrt(np.bincount(part, minlength=3)[part])


def score(docs: DataFrame, machine: Machine, *, text: str = "text", metadata: tuple[str, ...] = (), least: float = 0.3) -> DataFrame:
    """All columns of docs, with score and predicted (1 if the score is least or more); columns of these names are replaced."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)

    tool = Features()

    @F.pandas_udf("double")
    def probability(rows):
        import pandas as pd

        given = rows.iloc[:, 1:].astype(object).where(rows.iloc[:, 1:].notna(), None).values.tolist()
        return pd.Series(held.value.probabilities([tool.of(t, m) for t, m in zip(rows.iloc[:, 0].tolist(), given, strict=True)]))

    found = probability(F.struct(or_empty(text).alias("_text"), *[F.col(c).alias(f"_given_{k}") for k, c in enumerate(metadata)]))
    return docs.withColumn("score", found).withColumn("predicted", (F.col("score") >= least).cast("int"))


def op12_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=("n_chars",))
    return score(docs, machine, metadata=("n_chars",)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
