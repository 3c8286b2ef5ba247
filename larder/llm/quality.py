"""Operator 10: quality rules as a learned decision list, in DataFrame functions only.

Base statistics come from the whole text. A decision list is then learned by sequential covering: rules for
low quality are grown on two thirds of the labelled rows, one threshold condition at a time by information
gain, pruned on the other third, kept while they are precise there, and the rows they cover are removed.
The list becomes one ordered conditional expression of Spark.

The labelled rows are a bounded sample (``sample`` rows, chosen by a hash of the id). Spark reduces them to
counts for each combination of feature bins; only those counts, at most ``sample`` rows, reach the driver.

Defined cases: null and empty texts have no words, so they fail the base rules; rows with a null label or id
are not learned from; without labels of both kinds the list is empty and the base rules decide; labels that
contradict each other both count; repeated rows get equal results; input columns named like outputs are
replaced, others are kept by ``rated``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import WORD, documents, or_empty

SAMPLE = 12_000
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ("f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_exclaims")


def with_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios in FEATURES."""
    df = docs.withColumn("_text", or_empty(text)).withColumn("_words", F.regexp_extract_all("_text", F.lit(f"({WORD})"), 0))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))).withColumn("n_words", F.size("_words").cast("long"))
    # Hashes of all windows; those that occur twice are found by sorting, in texts that have any.
    hashes = F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    df = df.withColumn("_hashes", F.when(F.col("n_words") > WINDOW, hashes))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    sorted_ = F.array_sort(F.transform("_hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(repeats, sorted_))
    twice = lambda k: F.coalesce(F.get("_sorted", k)["h"] == F.get("_sorted", k - 1)["h"], F.lit(False)) | F.coalesce(F.get("_sorted", k)["h"] == F.get("_sorted", k + 1)["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), twice), lambda k: F.get("_sorted", k)["i"]))
    df = df.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), starts))
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("_starts") - 1), F.lit(WINDOW), lambda all_, k: all_ + F.least(F.lit(WINDOW), F.get("_starts", k) - F.get("_starts", k - 1))
    )
    df = df.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size("_starts") > 1, covered).otherwise(0).cast("long"),
        "_n_lines": F.size("_lines"),
        "_upper": F.regexp_count("_text", F.lit(r"\p{Lu}")),
        "_exclaims": F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit(""))),
    })
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns({
        "f_words": F.col("n_words").cast("double"),
        "f_word_length": per("word_chars", "n_words"),
        "f_symbols": per("n_symbols", "n_words"),
        "f_dup_lines": per("n_dup_lines", "_n_lines"),
        "f_repeats": per("n_repeat_words", "n_words"),
        "f_upper": per("_upper", "word_chars"),
        "f_exclaims": per("_exclaims", "n_words"),
    }).drop("_text", "_words", "_lines", "_hashes", "_sorted", "_starts", "_n_lines", "_upper", "_exclaims")


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float
    bin: int

    def holds(self, bins: tuple[int, ...]) -> bool:
        return (bins[self.feature] > self.bin) == self.above

    def column(self) -> Column:
        value = F.col(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold


Cell = tuple[tuple[int, ...], int, int]  # bins, rows of low quality, other rows


def _best_condition(cells: list[Cell], thresholds: list[list[float]]) -> tuple[float, Condition | None]:
    bad, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
    base, best, found = math.log2(bad / (bad + good)), 0.0, None
    for f, cuts in enumerate(thresholds):
        counts = [[0, 0] for _ in range(len(cuts) + 1)]
        for bins, b, g in cells:
            counts[bins[f]][0] += b
            counts[bins[f]][1] += g
        below_bad = below_good = 0
        for k, cut in enumerate(cuts):
            below_bad, below_good = below_bad + counts[k][0], below_good + counts[k][1]
            for above, b, g in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                if b and (gain := b * (math.log2(b / (b + g)) - base)) > best + 1e-9:
                    best, found = gain, Condition(f, above, cut, k)
    return best, found


def _covered(rule: list[Condition], cells: list[Cell]) -> tuple[int, int]:
    inside = [c for c in cells if all(x.holds(c[0]) for x in rule)]
    return sum(c[1] for c in inside), sum(c[2] for c in inside)


def _worth(bad: int, good: int) -> float:
    return (bad - good) / (bad + good) if bad + good else -1.0


def sequential_covering(grow: list[Cell], prune: list[Cell], thresholds: list[list[float]], *, precision: float = 0.95, least: int = 5, most_rules: int = 16, most_conditions: int = 4) -> list[list[Condition]]:
    """Ordered rules for low quality."""
    rules: list[list[Condition]] = []
    while len(rules) < most_rules and sum(c[1] for c in grow) >= least:
        rule, cells = [], grow
        while len(rule) < most_conditions and any(c[2] for c in cells):
            _, condition = _best_condition(cells, thresholds)
            if condition is None:
                break
            rule.append(condition)
            cells = [c for c in cells if condition.holds(c[0])]
        worth = lambda r: _worth(*_covered(r, prune))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        bad, good = (a + b for a, b in zip(_covered(rule, prune), _covered(rule, grow), strict=True)) if rule else (0, 0)
        if bad < least or bad < precision * (bad + good):
            break
        rules.append(rule)
        grow, prune = ([c for c in cells if not all(x.holds(c[0]) for x in rule)] for cells in (grow, prune))
    return rules


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", sample: int = SAMPLE, cuts: int = 24) -> list[list[Condition]]:
    """A decision list from docs (doc_id, text) and labels (doc_id, quality)."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna()
    chosen = known.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "quality").limit(sample)
    rows = with_statistics(docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id"), text=text).select("doc_id", "quality", *FEATURES)
    steps = [k / cuts for k in range(1, cuts)]
    # Percentiles of rare features are mostly equal, so those among the rows that are not 0 count too.
    found = rows.agg(*[F.percentile_approx(f, steps, 1000).alias(f) for f in FEATURES], *[F.percentile_approx(F.when(F.col(f) > 0, F.col(f)), steps, 1000).alias(f"{f}_some") for f in FEATURES]).first()
    thresholds = [sorted({0.0, *(found[f] or []), *(found[f"{f}_some"] or [])}) for f in FEATURES]
    place = [reduce(lambda a, b: a + b, [(F.col(f) > t).cast("int") for t in cut], F.lit(0)) for f, cut in zip(FEATURES, thresholds, strict=True)]
    part = (F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0).alias("prune")
    table = rows.select(F.array(*place).alias("bins"), (F.col("quality") == 0).cast("int").alias("bad"), part).groupBy("bins", "prune").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    cells = {want: [(tuple(r.bins), r.bad, r.n - r.bad) for r in sorted(table) if r.prune == want] for want in (False, True)}
    return sequential_covering(cells[False], cells[True], thresholds)


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one ordered conditional: false for the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, [c.column() for c in rule])
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def rated(docs: DataFrame, rules: list[list[Condition]], *, text: str = "text") -> DataFrame:
    """docs with statistics, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return with_statistics(docs, text=text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(*FEATURES)


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
