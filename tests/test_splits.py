"""Text files in splits: CSV rows and dumps against readers of whole files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from larder.sources import files, splits

RANDOM = random.Random(12)


@pytest.fixture
def cut(spark):
    """Cuts files into splits of a few bytes."""
    key, least = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (key, least)}

    def to(n):
        spark.conf.set(key, str(n))
        spark.conf.set(least, "0")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def field():
    kind = RANDOM.randrange(9)
    word = "".join(RANDOM.choice("abc ,é日") for _ in range(RANDOM.randrange(6))).replace(",", "")
    if kind < 3:
        return word
    if kind == 3:
        return f'{word}x 5" wide'
    if kind == 4:
        return '""'
    inner = "".join(RANDOM.choice(["a", "b", " ", ",", "\n", "\r\n", '""', "\n\n", ' ","']) for _ in range(RANDOM.randrange(14)))
    inner = inner.replace(' ","', ' "",""')
    return f'"{inner}"' + (RANDOM.choice(["", "tail", " x"]) if kind == 8 else "")


def made(rows, end, mark, last):
    lines = ["img,title,quantity"]
    for _ in range(rows):
        lines.append("" if RANDOM.random() < 0.1 else ",".join(field() for _ in range(RANDOM.choice([1, 2, 3, 3, 3, 3, 4]))))
    return (mark + end.join(lines) + (end if last else "")).encode()


def by_reader(content):
    rows = csv.DictReader(io.StringIO(content.decode("utf-8-sig")))
    return [{k: v for k, v in r.items() if k is not None} for r in rows]


@pytest.mark.parametrize("size", [7, 24, 100, 1_000_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_equals_reader_of_whole_files(spark, tmp_path, cut, size, end):
    want = {}
    for k in range(6):
        content = made(RANDOM.randrange(60), end, "﻿" if k % 2 else "", k % 3 != 0)
        (tmp_path / f"{k}.csv").write_bytes(content)
        want[f"{k}.csv"] = by_reader(content)
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(b"img,title")
    (tmp_path / "other.txt").write_bytes(b"no,csv\n1,2\n")
    # The header has to end in the first split.
    cut(max(size, 24))
    if size == 7:
        cut(24)
    found = files.recipe_csv(spark, str(tmp_path))
    rows = {}
    for r in found.collect():
        rows.setdefault(r.path.rsplit("/")[-1], []).append((r.line_no, r.fields))
    assert {k: [f for _, f in sorted(v)] for k, v in rows.items()} == {k: v for k, v in want.items() if v}
    assert all(sorted(n for n, _ in v) == list(range(len(v))) for v in rows.values())
    if size <= 100:
        assert splits.split_lines(spark, str(tmp_path), "*.csv").select("path", "split").distinct().count() > 20
        assert splits.split_lines(spark, str(tmp_path), "*.csv").rdd.getNumPartitions() > 4


def test_row_over_many_splits(spark, tmp_path, cut):
    body = "".join(f'{k},"line {k}\nsays ""{"long " * k}""\n\nend",x\n' for k in range(40))
    (tmp_path / "a.csv").write_text(f'id,"te""xt",c\n{body}')
    cut(50)
    found = sorted(files.recipe_csv(spark, str(tmp_path)).collect(), key=lambda r: r.line_no)
    assert [r.fields for r in found] == by_reader((tmp_path / "a.csv").read_bytes())


def test_surplus_absent_and_equal_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,a\n1,2,3,4\n5\n\n")
    (tmp_path / "blank.csv").write_text("\n1,2\n3,4\n")
    found = {(r.path.rsplit("/")[-1], r.line_no): r.fields for r in files.recipe_csv(spark, str(tmp_path)).collect()}
    assert found == {("a.csv", 0): {"a": "3", "b": "2"}, ("a.csv", 1): {"a": None, "b": None}, ("blank.csv", 0): {}, ("blank.csv", 1): {}}


def test_long_header_is_an_error(spark, tmp_path, cut):
    (tmp_path / "a.csv").write_text('"one\n' + "x\n" * 50 + '",b\n1,2\n')
    cut(40)
    with pytest.raises(Exception, match="first split"):
        files.recipe_csv(spark, str(tmp_path)).collect()


def test_state_of_a_line():
    for text in ['a,"b', 'a,"b""c', '"a"b"c,"d', 'a"b,"c"', '"",""', '"""', '"x"",y', 'x" ,"', '","', '"a",', '"a" ,"b']:
        for inside in (False, True):
            content = ('"' if inside else "") + text + "\nq"
            # A reader that is inside takes the next line into the row.
            rows = list(csv.reader(io.StringIO(content)))
            assert splits.inside_after(text, inside) == (len(rows) == 1), (text, inside)


def test_lines_have_numbers(spark, tmp_path, cut):
    text = "".join(f"{k}\n" * (k % 3 + 1) for k in range(300))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    cut(100)
    found = sorted((r.path[-5:], r.line_no, r.line) for r in splits.numbered_lines(spark, str(tmp_path)).collect())
    assert found == [("a.txt", k, x) for k, x in enumerate(text.split("\n")[:-1])] + [("b.txt", 0, "one"), ("b.txt", 1, ""), ("b.txt", 2, "two")]


def test_files_cut_otherwise_are_an_error(spark, tmp_path, cut, monkeypatch):
    (tmp_path / "a.txt").write_text("x\n" * 900)
    cut(1_000_000)
    whole, asked = splits.split_lines(spark, str(tmp_path)), []
    half = whole.withColumn("split", F.when(F.col("at") % 2 == 0, 0).otherwise(7).cast("long"))
    join = type(whole).join
    monkeypatch.setattr(splits, "split_lines", lambda *a: whole)
    # The second scan meets a split that the first didn't.
    monkeypatch.setattr(type(whole), "join", lambda self, *a, **b: join(half if not asked and not asked.append(1) else self, *a, **b))
    found = splits.numbered_lines(spark, str(tmp_path))
    monkeypatch.undo()
    with pytest.raises(Exception, match="cut otherwise"):
        found.collect()


def by_lines(content, table, n):
    lines = content.split("\n")
    at = next((k for k, x in enumerate(lines) if x.startswith("COPY ") and "FROM stdin" in x and table in x), None)
    out = []
    for k, line in enumerate(lines[at + 1 :] if at is not None else [], (at or 0) + 1):
        line = line.removesuffix("\r")
        if line.strip(" ") == "\\.":
            break
        if line.strip(" ") and not line.strip(" ").startswith("--"):
            out.append((k, line.split("\t"), len(line.split("\t")) == n))
    return out


@pytest.mark.parametrize("size", [16, 90, 1_000_000])
def test_dump_equals_reader_of_whole_files(spark, tmp_path, cut, size):
    want = {}
    for k in range(5):
        lines = ["SET x;", "\\.", "COPY s.other (a) FROM stdin;", *(f"o{i}\tx" for i in range(RANDOM.randrange(9))), "\\."]
        if k != 3:
            lines += ["COPY s.ingredient (a, b) FROM stdin;", *(RANDOM.choice([f"{i}\tname {i}", f"{i}", "-- c", "", f"{i}\té\t日", "COPY s.ingredient FROM stdin"]) for i in range(50))]
        if k != 2:
            lines += ["\\.", "COPY s.ingredient (a, b) FROM stdin;", "late\trow", "\\."]
        content = ("\r\n" if k % 2 else "\n").join(lines) + ("\n" if k % 2 else "")
        (tmp_path / f"{k}.sql").write_text(content, newline="")
        want[f"{k}.sql"] = by_lines(content, "s.ingredient", 2)
    cut(size)
    found = {}
    for r in files.dump_rows(spark, str(tmp_path), "s.ingredient", 2).collect():
        found.setdefault(r.path.rsplit("/")[-1], []).append((r.line_no, r.fields, r.valid))
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v}
