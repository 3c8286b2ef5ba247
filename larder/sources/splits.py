"""Text files of any size read in splits, with exact line and row numbers.

A scan of text gives each line with the file and the split that it begins in. What a split means for those after it is one row: how many lines
it has (numbered_lines), or what it does to the state of a CSV reader (csv_rows). These rows are combined by windows over the splits of a file, and
the scan then runs again with each split's own beginning. Nothing but a row for each split leaves the tasks, whatever the size of a file.

Both scans must be cut alike. Spark cuts by the size of the input, spark.sql.files.maxPartitionBytes and the number of cores, which can change while executors
come and go; so spark.sql.files.minPartitionNum is set where it isn't, and a split that the first scan didn't meet is an error, never other rows.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines that are parsed at once.
LINES = 4096


def split_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, split (the byte that it begins at), at (grows with the lines of a split) and line, without its \\n."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    reader = spark.read.option("lineSep", "\n")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _met(found: str, value: Column) -> Column:
    text = F.concat(F.lit("files were cut otherwise than before: "), F.col("path"), F.lit(" at "), F.col("split").cast("string"))
    return F.when(F.col(found).isNotNull(), value).otherwise(F.raise_error(text).cast("long"))


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, line_no (from 0 in each file) and line."""
    lines = split_lines(spark, path, glob)
    sizes = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each split.
    known = sizes.select(F.col("path").alias("_path"), F.col("split").alias("_split"), "_first", before.alias("_before"))
    rows = lines.join(F.broadcast(known), (F.col("path") == F.col("_path")) & (F.col("split") == F.col("_split")), "left")
    return rows.select("path", _met("_first", F.col("_before") + F.col("at") - F.col("_first")).alias("line_no"), "line")


def dump_rows(spark: SparkSession, path: str, table: str, n_fields: int = 12) -> DataFrame:
    """Fields of the rows between a table's COPY header and its end mark; rows with another number of fields are flagged.

    The header and the marks are few rows of line numbers; from them comes one interval for each file, and lines are kept by it.
    """
    lines = numbered_lines(spark, path).withColumn("line", F.regexp_replace("line", "\r$", ""))
    heads = F.col("line").startswith("COPY ") & F.contains("line", F.lit("FROM stdin")) & F.contains("line", F.lit(table))
    marks = lines.filter(heads | (F.trim("line") == "\\.")).select("path", "line_no", heads.alias("is_head"))
    head = marks.filter("is_head").groupBy("path").agg(F.min("line_no").alias("_head"))
    # An end mark for each table of the dump.
    end = marks.filter("not is_head").join(head, "path").filter(F.col("line_no") > F.col("_head")).groupBy("path").agg(F.min("line_no").alias("_end"))
    interval = head.join(end, "path", "left").select(F.col("path").alias("_path"), "_head", F.coalesce("_end", F.lit(sys.maxsize)).alias("_end"))
    inside = lines.join(F.broadcast(interval), (F.col("path") == F.col("_path")) & (F.col("line_no") > F.col("_head")) & (F.col("line_no") < F.col("_end")))
    fields = F.split("line", "\t")
    return inside.filter((F.trim("line") != "") & ~F.trim("line").startswith("--")).select("path", "line_no", fields.alias("fields"), (F.size(fields) == n_fields).alias("valid"))


def inside_after(line: str, inside: bool) -> bool:
    """Whether a CSV reader is inside quotation marks at the end of a line. Marks count where a field begins with one; others are text."""
    at = 0
    while True:
        if inside:
            mark = line.find('"', at)
            if mark < 0:
                return True
            at = mark + 1
            if line.startswith('"', at):
                at += 1
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], list]]:
    """Lines of each split as they come, piece by piece: path, split, lines and what else stands in the first row."""
    for batch in batches:
        paths, splits, lines = (batch.column(k).to_pylist() for k in range(3))
        begin = 0
        for k in range(1, len(paths) + 1):
            if k == len(paths) or paths[k] != paths[begin] or splits[k] != splits[begin]:
                yield paths[begin], splits[begin], lines[begin:k], [batch.column(c)[begin].as_py() for c in range(3, batch.num_columns)]
                begin = k


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: its effect on the reader, the rows that begin in it in either case, and the header if the file begins with it."""
    held: dict[tuple[str, int], list] = {}
    for path, split, lines, _ in _by_split(batches):
        state = held.setdefault((path, split), [False, True, 0, 0, None, split == 0])
        outside, inside, from_outside, from_inside, header, in_header = state
        for line in lines:
            if split == 0 and header is None:
                line = line.removeprefix("\ufeff")
            blank = line in ("", "\r")
            from_outside += not outside and not blank
            from_inside += not inside and not blank
            if in_header:
                header = line if header is None else header + "\n" + line
            if '"' in line:
                outside, inside = inside_after(line, outside), inside_after(line, inside)
            in_header = in_header and outside
        held[path, split] = [outside, inside, from_outside, from_inside, header, in_header]
    if any(s[5] for s in held.values()):
        raise ValueError("the header of a file doesn't end in its first split")
    rows = [(p, s, *held[p, s][:5]) for p, s in held]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "split", "outside", "inside", "from_outside", "from_inside", "header"])


def _states(told: DataFrame) -> DataFrame:
    """told with is_inside (the state that a split begins in), first (the number of its first row) and owner (the split where the row that comes in open began).

    The effects are four functions of two states. After a split that leaves or enters whatever came, the state is known, and the splits that swap after it turn it.
    """
    order = Window.partitionBy("path").orderBy("split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed, swaps = F.col("outside") == F.col("inside"), F.col("outside") & ~F.col("inside")
    rows = told.withColumn("_swaps", F.sum(swaps.cast("long")).over(order))
    last = F.last(F.when(fixed, F.struct(F.col("outside").cast("long").alias("state"), "_swaps")), ignorenulls=True).over(earlier)
    rows = rows.withColumns({"_last": last, "_turned": F.coalesce(F.lag("_swaps").over(order), F.lit(0))})
    state = F.coalesce(F.col("_last.state"), F.lit(0)) + F.col("_turned") - F.coalesce(F.col("_last._swaps"), F.lit(0))
    rows = rows.withColumn("is_inside", state % 2 == 1).withColumn("_rows", F.when(F.col("is_inside"), F.col("from_inside")).otherwise(F.col("from_outside")))
    # A header that isn't blank counts as a row.
    rows = rows.withColumn("file_header", F.coalesce(F.first("header", ignorenulls=True).over(Window.partitionBy("path")), F.lit("")))
    first = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.when((F.col("split") == 0) | F.col("file_header").isin("", "\r"), 0).otherwise(1)
    owner = F.last(F.when(F.col("_rows") > 0, F.col("split")), ignorenulls=True).over(earlier)
    return rows.withColumns({"first": first, "owner": owner})


def _parse(texts: list[str], header: list[str]) -> list[list[tuple[str, str | None]]]:
    """Fields of whole rows; blank lines are none, surplus fields go, absent ones are null, of equal names the last counts."""
    csv.field_size_limit(sys.maxsize)
    rows = [row for row in csv.reader(texts) if row]
    return [list({k: row[i] if i < len(row) else None for i, k in enumerate(header)}.items()) for row in rows]


FIELDS = pa.map_(pa.string(), pa.string())
PARTS = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("fields", FIELDS), ("owner", pa.int64()), ("split", pa.int64()), ("text", pa.string()), ("header", pa.string())])


def _names(header: str) -> list[str]:
    return (list(csv.reader(line + "\n" for line in header.split("\n"))) or [[]])[0]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that begin and end in a split; also, as text, the row that stays open at its end and the end of one that came in open."""
    # For each split: is it inside, the next row's number, lines of the open row, is that one from before, has the header passed, owner, header
    seen: dict[tuple[str, int], list] = {}

    def parsed(path: str, first: int, lines: list[str], names: list[str]) -> pa.RecordBatch:
        rows = _parse(lines, names)
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(rows, FIELDS), *(pa.nulls(n, t) for t in PARTS.types[3:])], schema=PARTS)

    def loose(*row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, PARTS.types, strict=True)], schema=PARTS)

    names: dict[str, list[str]] = {}
    for path, split, lines, (is_inside, first, owner, header) in _by_split(batches):
        if path not in names:
            names[path] = _names(header)
        inside, number, open_, before, begun, *_ = seen.setdefault((path, split), [bool(is_inside), first, [], bool(is_inside), split != 0])
        ready: list[str] = []
        for line in lines:
            if not begun and not open_:
                line = line.removeprefix("\ufeff")
            if '"' in line:
                inside = inside_after(line, inside)
            open_.append(line + "\n")
            if inside:
                continue
            if before:
                yield loose(path, None, None, owner, split, "".join(open_), None)
                before = False
            elif not begun:
                begun = True
            else:
                ready += open_
            open_ = []
            if len(ready) >= LINES:
                yield (batch := parsed(path, number, ready, names[path]))
                number, ready = number + batch.num_rows, []
        if ready:
            yield (batch := parsed(path, number, ready, names[path]))
            number += batch.num_rows
        seen[path, split] = [inside, number, open_, before, begun, owner, header]
    for (path, split), (_, number, open_, before, begun, owner, header) in seen.items():
        if open_ and begun:
            yield loose(path, None if before else number, None, owner if before else split, split, "".join(open_), header)


def csv_rows(spark: SparkSession, path: str, glob: str | None = "*.csv") -> DataFrame:
    """Path, line_no (rows from 0 in each file) and the fields of each row as a map, as csv.DictReader gives them.

    Quotation marks may hold line ends, also across splits: a split's own rows are parsed in its task; the texts of the few rows that cross into other splits, at most one
    for each split, are put together by the split where they begin. A file's header must end in its first split.
    """
    lines = split_lines(spark, path, glob)
    told = lines.select("path", "split", "line").mapInArrow(_told, "path string, split long, outside boolean, inside boolean, from_outside long, from_inside long, header string")
    # A row for each split.
    known = _states(told).select(F.col("path").alias("_path"), F.col("split").alias("_split"), "is_inside", "first", "owner", "file_header")
    rows = lines.join(F.broadcast(known), (F.col("path") == F.col("_path")) & (F.col("split") == F.col("_split")), "left")
    rows = rows.select("path", "split", "line", "is_inside", _met("first", F.col("first")).alias("first"), F.coalesce("owner", "split").alias("owner"), "file_header")
    parts = rows.mapInArrow(_whole, "path string, line_no long, fields map<string,string>, owner long, split long, text string, header string")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "")
    pieces = parts.filter("text is not null").groupBy("path", "owner").agg(F.max("line_no").alias("line_no"), text.alias("text"), F.max("header").alias("header"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, line_no, text, header in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = _parse([x + "\n" for x in text.removesuffix("\n").split("\n")], _names(header))
                yield pa.RecordBatch.from_arrays([pa.array([path_] * len(found), pa.string()), pa.array(range(line_no, line_no + len(found)), pa.int64()), pa.array(found, FIELDS)], ["path", "line_no", "fields"])

    # What an open row needs stands in the parts of the splits after it.
    joined = pieces.filter("line_no is not null").select("path", "line_no", "text", "header").mapInArrow(put_together, "path string, line_no long, fields map<string,string>")
    return parts.filter("text is null").select("path", "line_no", "fields").unionByName(joined)
