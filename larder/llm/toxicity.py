"""Operator 1: toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, emphasis, quotation mark, other). Transducers read the symbols of a
clause and are composed: target, negation, reported speech, emphasis and series mark the insults and threats in their reach, target and
series from both sides, so there is a chain that runs forward and one that runs backward over what the first wrote. The insult
transducer then matches insults that are aimed at somebody, emphatic ("such a ...") or heaped, the threat transducer threats that are aimed;
the last one names the pattern: what was matched, how, and how sure the word is, or denied, or told. A clause counts once for each pattern it matches,
and for isolated words only where it matches none; denied and told clauses count for nothing. A document's score is a logistic curve of its counts.

Weights belong to patterns, none below 0, and are learned from labels; a pattern that labels say little of keeps the odds of its prior. Which words are insults, and how sure they are, is learned
too: log odds of a word, or of a stem of a word, between toxic and clean documents. Both use one bounded
sample of labelled rows whose crc32(doc_id) mod 5 is not 0. Near copies count once for the words (by their smallest shingle hash),
so that the words of one copied text don't become insults. Seed words keep a prior weight until rows speak against it.

Defined cases: null and empty texts match nothing and get the score of that; rows with null label or id are not learned
from, and a null id is held in; without labels of both kinds the seed words and the prior weights are used; repeated
rows get equal scores; an empty table gives an empty result; columns other than id and text are never inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import documents, or_empty, small_batches

#: Bounds of the labelled sample, and of the words and stems that one round may compare.
TOXIC_ROWS, CLEAN_ROWS, CANDIDATES = 2_000, 6_000, 20_000
STEMS = range(4, 8)

# Seed words of each symbol.
INSULTS = [
    "idiot", "moron", "imbecile", "cretin", "fool", "dimwit", "halfwit", "dunce", "dolt", "stupid", "dumb", "brainless", "pathetic", "worthless", "useless", "disgusting", "revolting", "filthy", "scum", "vermin", "parasite",
    "trash", "garbage", "filth", "loser", "failure", "clown", "jerk", "coward", "liar", "crook", "swine", "bastard", "dummkopf", "trottel", "abschaum", "imbécile", "crétin", "ordure", "imbécil", "basura", "escoria",
]
THREATS = ["kill", "murder", "destroy", "strangle", "stab", "shoot", "töten", "umbringen", "tuer", "matar"]
EMPHASES = ["such", "what", "how", "so", "utter", "total", "complete", "fucking", "bloody", "welch", "solch", "quel", "quelle", "qué", "tan", "total", "totaler", "absolu"]
TARGETS = ["you", "your", "yours", "he", "she", "him", "her", "they", "them", "their", "tu", "vous", "du", "ihr", "usted", "ellos"]
NEGATIONS = ["not", "no", "never", "neither", "nor", "without", "isn", "aren", "wasn", "don", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás", "sin"]
REPORTS = ["said", "says", "wrote", "writes", "quoted", "claimed", "alleged", "according", "reported", "called", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]
PRIOR_WEIGHT, LEAST_WEIGHT = 3.0, 4.0
#: Least weights of a word of each tier: seeds that labels say little of, words that labels tell, and those they are sure of.
TIERS = (0.0, LEAST_WEIGHT, 6.5)
#: Patterns: what was matched, how, and the tier of the word. By their prior, one clause alone gives a text these odds (as logarithms), more or less STEP by tier.
WAYS = {"aimed": 2.0, "heaped": 1.5, "emphatic": 1.0, "isolated": -1.0}
STEP = 0.5
PATTERNS = [(kind, way, tier) for kind in ("insult", "threat") for way in WAYS for tier in range(len(TIERS))]
OFFSET = -3.0


def prior(offset: float) -> np.ndarray:
    """Prior weights of PATTERNS for a curve that begins at offset."""
    return np.array([max(0.0, (WAYS[way] + STEP * (tier - 1) - offset) / math.log(2)) for _, way, tier in PATTERNS])


TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")
CLAUSE = re.compile(r"[.!?;\n]+")


class Machine:
    """A transducer over symbols, given by its start state and its step: (state, symbol) to (state, symbol)."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step
        self.seen: dict = {}

    def __call__(self, state, symbol):
        if (found := self.seen.get((state, symbol))) is None:
            found = self.seen[state, symbol] = self.step(state, symbol)
        return found

    def then(self, other: Machine) -> Machine:
        """Composition: what this machine writes, the other reads. States are built as they are met."""

        def step(state, symbol):
            a, middle = self(state[0], symbol)
            b, out = other(state[1], middle)
            return (a, b), out

        return Machine((self.start, other.start), step)


def reach(trigger: str, mark: str, length: int) -> Machine:
    """Marks insults and threats up to length symbols after the trigger."""

    def step(left: int, symbol: frozenset):
        if trigger in symbol:
            return length, symbol
        return max(0, left - 1), symbol | {mark} if left and symbol & {"insult", "threat"} else symbol

    return Machine(0, step)


def series(length: int) -> Machine:
    """Marks insults up to length symbols after another insult."""

    def step(left: int, symbol: frozenset):
        if "insult" in symbol:
            return length, symbol | {"heaped"} if left else symbol
        return max(0, left - 1), symbol

    return Machine(0, step)


def matched(kind: str, *ways: str) -> Machine:
    """Marks words of a kind that stand in one of the ways; others of the kind are isolated words."""

    def step(state, symbol: frozenset):
        return state, symbol | {"matched"} if kind in symbol and symbol & set(ways) else symbol

    return Machine(None, step)


def reported(length: int) -> Machine:
    """Marks what stands in quotation marks, or up to length symbols after a verb of report."""

    def step(state: tuple[bool, int], symbol: frozenset):
        quoted, left = state
        if "quote" in symbol:
            return (not quoted, left), symbol
        if "report" in symbol:
            return (quoted, length), symbol
        return (quoted, max(0, left - 1)), symbol | {"reported"} if (quoted or left) and symbol & {"insult", "threat"} else symbol

    return Machine((False, 0), step)


def pattern() -> Machine:
    """Writes what a marked insult or threat is: (kind, way), "denied" or "told"; None for all else."""

    def step(state, symbol: frozenset):
        kind = next((k for k in ("insult", "threat") if k in symbol), None)
        if kind is None:
            return state, None
        if "negated" in symbol:
            return state, "denied"
        if "reported" in symbol:
            return state, "told"
        way = next((w for mark, w in (("targeted", "aimed"), ("heaped", "heaped"), ("named", "emphatic")) if mark in symbol), None)
        return state, (kind, way if "matched" in symbol else "isolated")

    return Machine(None, step)


def grammar() -> tuple[Machine, Machine]:
    """The chain that runs forward over a clause's symbols, and the one that runs backward over what it wrote and names patterns."""
    forward = reach("target", "targeted", 4).then(reach("negation", "negated", 3)).then(reported(8)).then(reach("emphasis", "named", 2)).then(series(3))
    insults, threats = matched("insult", "targeted", "named", "heaped"), matched("threat", "targeted")
    return forward, reach("target", "targeted", 4).then(series(3)).then(insults).then(threats).then(pattern())


def patterns(machines: tuple[Machine, Machine], symbols: list[frozenset]) -> list:
    """The pattern of each symbol of a clause."""
    for machine in machines:
        state, out = machine.start, []
        for symbol in symbols:
            state, written = machine(state, symbol)
            out.append(written)
        symbols = out[::-1]
    return symbols


@dataclass
class Lexicon:
    """Words and stems with how sure they are; weights of patterns and the offset of the curve."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: prior(OFFSET))
    offset: float = OFFSET

    def probability(self, counts: Iterable[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.log1p(np.asarray(counts, float)) @ self.weights + self.offset, -50.0, 50.0))))


class Scorer:
    """Finds matches by an automaton over the whole text, then runs the grammar over the clauses that hold one."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.machines = lexicon, grammar()
        self.automaton = ahocorasick.Automaton()
        for w in {*lexicon.words, *lexicon.stems}:
            self.automaton.add_word(w, len(w))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.symbols = {w: frozenset({kind}) for kind, words in (("emphasis", EMPHASES), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
        self.symbols |= dict.fromkeys('"“”«»„', frozenset({"quote"}))
        self.threat, self.insult, self.other = frozenset({"threat"}), frozenset({"insult"}), frozenset()

    def weight(self, word: str) -> float:
        if (w := self.lexicon.words.get(word)) is not None:
            return w
        return max((self.lexicon.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k), default=0.0)

    def clause(self, clause: str) -> set[tuple[str, str, int]]:
        """The patterns that a clause matches; isolated words only if there are no others."""
        words = TOKEN.findall(clause)
        weights = [self.weight(word) for word in words]
        kinds = [(self.threat if word in THREATS else self.insult) if weight > 0 else self.symbols.get(word, self.other) for word, weight in zip(words, weights, strict=True)]
        found = {(*p, sum(w >= least for least in TIERS) - 1) for w, p in zip(weights, patterns(self.machines, kinds), strict=True) if isinstance(p, tuple)}
        return {p for p in found if p[1] != "isolated"} or found

    def counts(self, text: str) -> list[int]:
        """How many clauses match each of PATTERNS."""
        total = [0] * len(PATTERNS)
        if not len(self.automaton) or not text:
            return total
        low = text.lower()
        at = [end + 1 - n for end, n in self.automaton.iter(low) if end + 1 == n or not low[end - n].isalpha()]
        if not at:
            return total
        begin, k = 0, 0
        at.sort()
        for end in [*(m.start() for m in CLAUSE.finditer(low)), len(low)]:
            if k < len(at) and at[k] < end:
                for p in self.clause(low[begin:end]):
                    total[PLACES[p]] += 1
                while k < len(at) and at[k] < end:
                    k += 1
                if k == len(at):
                    break
            begin = end
        return total

    def score(self, text: str) -> float:
        return self.lexicon.probability(self.counts(text))


PLACES = {p: k for k, p in enumerate(PATTERNS)}


def _grams(text: str) -> set[str]:
    words = {w for w in TOKEN.findall(text.lower()) if w[0].isalpha()}
    return {f"={w}" for w in words if len(w) < 24} | {w[:k] for w in words for k in STEMS if len(w) >= k}


def _emit(known: frozenset[str] | None) -> Callable:
    """One row for each row of the sample: toxic, the key of near copies, the words (marked =) and stems among known."""
    import xxhash

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grams = [], []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                found = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2))]
                keys.append(min(found))
                g = _grams(text)
                grams.append(sorted(g if known is None else g & known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(grams, pa.list_(pa.string()))], ["toxic", "key", "grams"])

    return rows


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 0 by 5; these rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text") -> Lexicon:
    """A lexicon from docs (doc_id, text) and labels (doc_id, toxic), held-out rows left aside."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out())
    order = [F.xxhash64(F.lit("toxic"), "doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.filter("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    # At most TOXIC_ROWS + CLEAN_ROWS ids are broadcast; their texts are dealt out anew, as they can stand in few files.
    rows = docs.select("doc_id", or_empty(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text").repartition(12)
    one_each = lambda df: df.dropDuplicates(["key"])
    schema = "toxic int, key long, grams array<string>"
    toxic, clean = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    counted = one_each(toxic.mapInArrow(_emit(None), schema))
    n_toxic = counted.count()
    lexicon = Lexicon(dict.fromkeys([*INSULTS, *THREATS], PRIOR_WEIGHT))
    if not n_toxic or clean.isEmpty():
        return lexicon
    least = max(3, n_toxic // 200)
    common = counted.select(F.explode("grams").alias("gram")).groupBy("gram").count().filter(F.col("count") >= least)
    pos = {r["gram"]: r["count"] for r in common.orderBy(F.desc("count"), "gram").limit(CANDIDATES).collect()}
    asked = frozenset([*pos, *(f"={w}" for w in lexicon.words)])
    clean_rows = one_each(clean.mapInArrow(_emit(asked), schema))
    neg = Counter({r["gram"]: r["count"] for r in clean_rows.select(F.explode("grams").alias("gram")).groupBy("gram").count().collect()})
    n_clean = clean_rows.count()
    odds = lambda g, p: math.log((p + 0.5) / (n_toxic + 1)) - math.log((neg[g] + 0.5) / (n_clean + 1))
    for w in list(lexicon.words):
        g = f"={w}"
        if pos.get(g, 0) + neg[g]:
            lexicon.words[w] = max(0.0, odds(g, pos.get(g, 0)))
    share, sure = n_toxic / (n_toxic + n_clean), math.log(20 * CANDIDATES)
    for g, p in pos.items():
        # The chance that one of all candidates is this one-sided must be below 1 in 20.
        if (weight := odds(g, p)) >= LEAST_WEIGHT and _surprise(p, neg[g], share) >= sure:
            (lexicon.words if g[0] == "=" else lexicon.stems)[g.removeprefix("=")] = weight
    # For each label how many rows of the sample match so many clauses of each pattern; most match none.
    told = rows.mapInArrow(_counts(lexicon), "toxic int, counts array<int>").groupBy("toxic", "counts").count().collect()
    _fit(lexicon, np.array([r["toxic"] for r in told]), np.log1p(np.array([r["counts"] for r in told], float)), np.array([r["count"] for r in told], float))
    return lexicon


def _surprise(p: int, n: int, share: float) -> float:
    """Log likelihood ratio of p toxic and n clean rows against their share in the sample."""
    part = lambda k, expected: k * math.log(k / (p + n) / expected) if k else 0.0
    return part(p, share) + part(n, 1 - share)


def _fit(lexicon: Lexicon, y: np.ndarray, x: np.ndarray, n: np.ndarray, ridge: float = 0.5, steps: int = 3000) -> None:
    """Logistic regression of weights that aren't negative, held to their prior by a ridge; by projected steps with momentum."""
    none = x.sum(1) == 0
    # Odds of texts that match nothing; prior weights stand on them.
    offset = math.log((n[none] @ y[none] + 0.5) / (n[none] @ (1 - y[none]) + 0.5)) if none.any() else OFFSET
    design, first = np.concatenate([x, np.ones((len(x), 1))], 1), np.append(prior(offset), offset)
    held = np.full(len(first), ridge)
    # Words that labels don't confirm, by themselves, gain no weight from others.
    most = np.array([first[k] if p[1] == "isolated" and p[2] == 0 else np.inf for k, p in enumerate(PATTERNS)])
    rate = 1 / (0.25 * np.linalg.eigvalsh((design * n[:, None]).T @ design)[-1] + ridge)
    now, ahead, pace = first.copy(), first.copy(), 1.0
    for _ in range(steps):
        wrong = n * (1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30))) - y)
        new = ahead - rate * (design.T @ wrong + held * (ahead - first))
        new = np.append(np.clip(new[:-1], 0.0, most), offset)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, now, pace = new + (pace - 1) / faster * (new - now), new, faster
    if np.isfinite(now).all():
        lexicon.weights, lexicon.offset = now[:-1], float(now[-1])


def _counts(lexicon: Lexicon) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Scorer(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.counts(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["toxic", "counts"])

    return rows


def score(docs: DataFrame, lexicon: Lexicon, *, text: str = "text") -> DataFrame:
    """All columns of docs, with score and predicted; columns of these names are replaced."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def probability(texts):
        tool = Scorer(lexicon)
        return texts.map(tool.score)

    return docs.withColumn("score", probability(or_empty(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")
