"""The ten queries and the pipeline's stages on small tables, against brute force, libraries and SQL."""

import hashlib
import os
import random
import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from test_edges import WORD, brute_components, brute_cost, brute_repeats, brute_toxicity  # noqa: E402

import corpus_pipeline  # noqa: E402
from larder.llm import quality, toxicity  # noqa: E402
from larder.llm.registry import QUERIES, SQL  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANDOM = random.Random(5)
WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "ck ld mp nd rt st sh".split()]
#: Names that operators and stages give to columns of their own.
CLASHES = ["n_shingles", "stay_id", "stay_hash", "kept", "size", "score", "predicted", "copies", "target", "source_size", "h1", "h2", "text_hash", "representative", "_key", "_u", "_tie", "_hash", "_copy", "a.b"]
SCHEMA = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in CLASHES)])
TABLES = {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}


def prose(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


def made():
    passage, near = prose(110), prose(80)
    texts = [(k, prose(40) + (f" zorkel {prose(8)} zorkel" if k % 3 == 0 else "")) for k in range(60)]
    texts += [(100, f"{prose(30)} {passage} {prose(20)}"), (101, f"{passage} {prose(50)}"), (102, f"{prose(9)}\n{passage}")]
    texts += [(110, near), (111, near), (111, near), (112, near + " end"), (None, near), (120, None), (121, ""), (122, " \n\t"), (122, " \n\t"), (None, None), (None, prose(30)), (130, "one"), (131, "a ▁ 日本 😀")]
    docs = [(i, t, "en", ["b", None, "a", ""][k % 4], None if t is None else len(t), *(f"{c}-{k}" for c in CLASHES)) for k, (i, t) in enumerate(texts)]
    rng = np.random.default_rng(3)
    return {
        "documents": docs,
        "labels": [(i, int("zorkel" not in t), int("zorkel" in t)) for i, t in texts[:60]] + [(None, 1, 0), (3, None, None)],
        "embeddings": [(k, [float(x) for x in rng.normal(size=6)], 0) for k in range(120)] + [(20, [0.5] * 6, 0), (40, [0.25] * 6, 1), (40, [0.25] * 6, 1), (200, None, 0), (201, [1.0, None], 0), (202, [float("nan")] * 6, 0), (None, [1.0] * 6, 0)],
        "conversations": [(c, t, RANDOM.choice(["user", "assistant", "system", " User ", "bot", None]), RANDOM.choice(["hi", "", None])) for c in [*range(6), None] for t in [*range(RANDOM.randint(1, 6)), None]],
    }


def write(spark, folder, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def small(spark, rows, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("small"), rows)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), dict.fromkeys(TABLES, []))


@pytest.fixture(scope="module")
def stages(spark, small):
    """What goes into and comes out of each stage."""
    docs, found = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, small), "test-stage")
        found[name] = (docs.collect(), out.collect())
        docs = out
    return found


def bag(rows):
    return sorted(rows, key=str)


def texts_of(rows):
    return [(r[0], r[1]) for r in rows]


def by_sql(folder, name, columns, **tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tables.get(table, f'{folder}/{table}.parquet')}/*.parquet')")
    return bag(con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())


@lru_cache
def sentencepiece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def encoded(texts):
    """What the last stage has to give, by the library."""
    library = sentencepiece_model()
    ids = [(i, t or "", library.encode(t or "")) for i, t in texts]
    return bag((i, len(x), x, library.decode(x), library.decode(x) == t) for i, t, x in ids)


def test_last_stage_decodes(spark):
    texts = [(1, "The river  walked."), (2, "a ▁ b"), (3, "▁"), (4, None), (5, ""), (6, " x \n"), (7, "日本 😀 \x00"), (7, "日本 😀 \x00"), (None, "über")]
    rows = corpus_pipeline.encode(spark, spark.createDataFrame(texts, "doc_id long, text string"), "").collect()
    assert bag((r.doc_id, r.n_tokens, r.ids, r.decoded, r.restored) for r in rows) == encoded(texts)
    assert {r.doc_id for r in rows if not r.restored} == {2, 3}


def predictions(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return [brute_toxicity(lexicon, t) for _, t in texts]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_op1(spark, folder, rows):
    texts = texts_of(rows["documents"])
    return [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, pytest.approx(p), int(p >= 0.5)) for (i, _), p in zip(texts, predictions(spark, folder, texts), strict=True)]


def brute_op2(spark, folder, rows):
    return [(i, len((t or "").encode()), n := encoded([(i, t)])[0][1], n > 4096) for i, t in texts_of(rows["documents"])]


def brute_op4(spark, folder, rows):
    return brute_components(texts_of(rows["documents"]), 4, 85, 100)


def brute_op5(spark, folder, rows):
    return brute_repeats(texts_of(rows["documents"]), 400)


def brute_op6(spark, folder, rows):
    return [(i, n, sha(",".join(map(str, x))), sha(back)) for i, n, x, back, _ in encoded(texts_of(rows["documents"]))]


def brute_op7(spark, folder, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts_of(rows["documents"])]
    return [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids]


def brute_op10(spark, folder, rows):
    """With kept: the learned conditions, read as thresholds of features that are computed here."""
    rules = quality.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    out = []
    for i, t in texts_of(rows["documents"]):
        t = t or ""
        words = WORD.findall(t)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        counts, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if counts[g] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n, chars, symbols, doubled = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
        per = lambda a, b: a / b if b else 0.0
        features = {
            "f_words": float(n), "f_word_length": per(chars, n), "f_symbols": per(symbols, n), "f_dup_lines": per(doubled, len(lines)), "f_repeats": per(len(covered), n),
            "f_upper": per(sum(unicodedata.category(c) == "Lu" for c in t), chars), "f_exclaims": per(t.count("!"), n),
        }
        caught = any(all((features[quality.FEATURES[c.feature]] > c.threshold) == c.above for c in rule) for rule in rules)
        failed = n < 10 or 100 * len(covered) > 20 * n
        out.append((i, n, chars, symbols, doubled, len(covered), failed, not failed and not caught))
    return out


#: Query, the columns that are compared, and what they have to be.
BRUTE = [
    ("op1_toxicity_grammar", ["doc_id", "held_out", "score", "predicted"], brute_op1),
    ("op2_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"], brute_op2),
    ("op4_signature_tree", ["doc_id", "n_shingles", "component_id"], brute_op4),
    ("op5_column_suffix_order", ["doc_id", "n_removed", "n_spans", "kept_sha256"], brute_op5),
    ("op6_prefix_table", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], brute_op6),
    ("op7_token_files", ["doc_id", "n_tokens", "ids_crc32"], brute_op7),
    ("op10_decision_list", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], brute_op10),
]


@pytest.mark.parametrize("name,columns,brute", BRUTE, ids=[b[0] for b in BRUTE])
def test_query_equals_brute_force(spark, rows, small, name, columns, brute):
    found, wanted = [tuple(r) for r in QUERIES[name](spark, small).select(columns).collect()], list(brute(spark, small, rows))
    key = lambda r: str(tuple(x for x in r if isinstance(x, (int, str, bool, type(None)))))
    assert sorted(found, key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("name", ["op3_pareto_mix", "op8_branch_and_bound", "op13_packed_tree_negatives"])
def test_query_equals_sql(spark, small, name):
    found = QUERIES[name](spark, small)
    columns = sorted(found.columns)
    wanted = by_sql(small, name, columns)
    found = bag(tuple(r) for r in found.select(columns).collect())
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert a == tuple(pytest.approx(x) if isinstance(x, float) else x for x in b)


@pytest.mark.parametrize("name", ["op4_signature_tree", "op5_column_suffix_order"])
def test_query_equals_sql_on_given_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = QUERIES[name](spark, folder)
    assert bag(map(tuple, found.collect())) == bag(con.sql(f"SELECT {', '.join(found.columns)} FROM ({SQL[name]})").fetchall())


def test_kept_of_given_tables_equals_brute_force(spark):
    """Here the list has rules, and they turn documents away."""
    folder = "/root/testdata/sf0.01"
    rows = {"documents": [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]}
    want = {r[0]: r[1:] for r in brute_op10(spark, folder, rows)}
    found = {r.doc_id: r for r in QUERIES["op10_decision_list"](spark, folder).collect()}
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for i, r in found.items()} == want
    assert sum(not r.kept and not r.base_failed for r in found.values()) > 50


def test_roles_equal_brute_force(spark, rows, small):
    found = QUERIES["op9_role_repair"](spark, small).collect()
    assert bag((r.conv_id, r.turn, r.role) for r in found) == bag(r[:3] for r in rows["conversations"])
    for conversation in {r[0] for r in rows["conversations"]}:
        mine = sorted((r for r in found if r.conv_id == conversation), key=lambda r: r.position)
        assert sum(r.cost for r in mine) == brute_cost([(r.role or "").strip().lower() for r in mine])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_rejected_are_those_predicted(spark, small, stages):
    before, after = stages["toxicity"]
    wanted = [r for r, p in zip(before, predictions(spark, small, texts_of(before)), strict=True) if p < 0.5]
    assert bag(after) == bag(wanted) and 0 < len(after) < len(before)


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_jaccard_join"]
    assert all(r in before for r in after)
    least = brute_components(texts_of(before), 5, 4, 5)
    # Of a group the row with the smallest id stays, once; rows without words all do.
    assert bag(r.doc_id for r in after if WORD.search(r.text or "")) == bag({i for _, n, i in least if n and i is not None} | {None})
    assert bag(tuple(r) for r in after if not WORD.search(r.text or "")) == bag(tuple(r) for r in before if not WORD.search(r.text or ""))


def test_passages_go(stages):
    before, after = stages["suffix_array_dedup"]
    assert bag((r.doc_id, sha(r.text or "")) for r in after) == bag((i, digest) for i, _, _, digest in brute_repeats(texts_of(before), corpus_pipeline.PASSAGE))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    rest = lambda rows: bag((r.doc_id, *r[5:]) for r in rows)
    assert rest(after) == rest(before) and any(a.text != b.text for a, b in zip(bag(after), bag(before), strict=True))


@pytest.mark.parametrize("size", [249, 250, 330, 450])
def test_planted_passages(spark, small, size):
    """A passage of so many bytes in three documents, at their beginning, middle and end, goes from PASSAGE bytes on; what stands around it and clean documents stay."""
    passage = prose(size).encode()[:size].decode(errors="ignore")
    passage += "x" * (size - len(passage.encode()))
    around = [(prose(40) + " [", "] " + prose(60)), ("", "} " + prose(50)), (prose(30) + " (", "")]
    texts = [f"{a}{passage}{b}" for a, b in around] + [prose(200), None]
    docs = spark.createDataFrame([(k, t, "en", "web", None if t is None else len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    after = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_passages(spark, docs, small).collect()}
    assert [after[k] for k in range(3)] == ([a + b for a, b in around] if size >= corpus_pipeline.PASSAGE else texts[:3])
    assert after[3] == texts[3] and after[4] is None


def test_copies_equal_sql(spark, small, stages, tmp_path):
    before, after = stages["mix_sources"]
    spark.createDataFrame(before, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    taken = {(i, source): (t, size) for i, source, t, size in by_sql(small, "op3_pareto_mix", ["doc_id", "source", "taken", "size"], documents=f"{tmp_path}/documents.parquet")}
    copies = Counter(after)
    assert set(after) <= set(before)
    for r in before:
        words = len(WORD.findall(r.text or ""))
        if words and r.doc_id is not None:
            assert taken[r.doc_id, r.source] == (copies[r] * words, words)


def test_ids_of_the_mix(stages):
    before, after = stages["sentencepiece"]
    assert bag(tuple(r) for r in after) == encoded(texts_of(before))


def test_run_chains_the_stages(spark, small, stages):
    assert bag(corpus_pipeline.run(spark, small).collect()) == bag(stages["sentencepiece"][1])


def test_run_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_stages_on_long_texts_ties_and_maps(spark, small):
    """Each stage alone: a text of a million characters, null and repeated rows, equal ids, rows that differ in a map alone."""
    long, near = " ".join(f"{RANDOM.choice(WORDS)}{k}" for k in range(150_000)), prose(60)
    texts = [(1, long), (2, long), (3, None), (3, None), (4, near), (4, near), (5, ""), (None, near), (6, prose(30))]
    rows = [(i, t, "en", None if k % 2 else "a", None if t is None else len(t), {"k": k}) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>").repartition(3)
    assert len(long) > 1_000_000
    by_name = dict(corpus_pipeline.STAGES)
    clean = by_name["toxicity"](spark, docs, small)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    one_each = [r.asDict() for r in by_name["ngram_jaccard_join"](spark, docs, small).collect()]
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in one_each) == sorted((i, len(t or "")) for i, t in ((1, long), (3, None), (3, None), (4, near), (5, ""), (6, texts[8][1])))
    again = [r.asDict() for r in by_name["ngram_jaccard_join"](spark, docs.repartition(5), small).collect()]
    assert sorted(map(str, one_each)) == sorted(map(str, again))
    cut = {(r.doc_id, r.extra["k"]): r for r in by_name["suffix_array_dedup"](spark, docs, small).collect()}
    assert len(cut) == len(rows) and cut[1, 0].text == cut[2, 1].text == "" and cut[1, 0].n_chars == 0 and cut[6, 8].text == texts[8][1] and cut[3, 2].text is None
    mixed = by_name["mix_sources"](spark, docs, small).collect()
    assert all(mixed.count(r) <= 2 for r in mixed) and {r.doc_id for r in mixed} <= {i for i, _ in texts}
    ids = by_name["sentencepiece"](spark, docs.filter("doc_id <> 2 or doc_id is null"), small).collect()
    assert bag((r.doc_id, r.n_tokens, r.ids, r.decoded, r.restored) for r in ids) == encoded([x for x in texts if x[0] != 2])
