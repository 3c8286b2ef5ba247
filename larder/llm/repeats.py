"""Operator 5: removal of repeated byte strings, by column-wise construction of suffix order for many documents.

A byte goes if it is covered by a string of ``length`` bytes that starts elsewhere too. Strings are dealt out so that equal
ones meet: each belongs to the bucket of the smallest hash among its ``gram``-byte parts, its anchor, and the strings of a text
that follow one another in a bucket form one segment of bounded size. Buckets that get one segment hold nothing repeated, so
only segments of the others move; equal texts count once and are known to repeat.

In a bucket, equal strings have their anchor at one place, so segments are laid out in columns around it. From the last column to
the first, each round puts one more symbol before the suffix of every segment: the symbols in suffix order are that column of the
collection's Burrows-Wheeler transform, a stable sort by them gives the next order, and the common prefix of new
neighbours is one more than the least between their old places. As suffixes of different columns can't be equal, the
transform needs one column at a time, so a round costs a step for each segment and not one for each symbol so far. A string repeats if the suffix
that starts with it shares ``length`` symbols with a neighbour. Segments that are equal as wholes are one row of the columns.
Blocks of whole buckets stand in a task's memory; the files between the steps are Parquet tables and shuffles.

A bucket above ``largest`` segments isn't gathered: its blocks exchange distinct 128-bit fingerprints of their strings by ranges, as
rows that hold many, so that no task sees the whole bucket. Fingerprints only propose: in a block each string is compared, byte by byte, with
the first of its fingerprint, and that one with the first of the block before that has it, which travels as bytes. Where bytes differ, the step runs
again with other hashes, so buckets of every size are decided by bytes. Texts that are equal as wholes meet by 128-bit keys.

Shorter passages can be asked for beside: with ``passage``, runs of strings of that many bytes come first, and strings of
``length`` bytes are sought inside those runs only, where alone they can be.

Defined cases: null texts are empty texts and lose nothing, nor do texts shorter than ``length``; equal texts of that length or
more lose everything; repeated rows are equal texts; an empty table gives an empty result; matches never cross documents.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import bucketed, documents, or_empty, removed, small_batches, written

LENGTH, GRAM = 400, 32
#: About 50 words: of the runs of 51 words in `check_s`, 98.8 of 100 have at least so many bytes; the middle one has 316.
PASSAGE = 250
LARGEST_BUCKET = 2_000
BLOCK_BYTES, CHUNK_BYTES, ROWS = 2_000_000, 1_000_000, 4_000
#: No byte of UTF-8; stands outside of segments and equals nothing.
OUTSIDE = 255
#: Pairs of hash families, each an odd factor and the seed of a table of bytes; a pair makes a fingerprint, later ones stand by.
FAMILIES = (((0x9E3779B97F4A7C15, 5), (0xC2B2AE3D27D4EB4F, 6)), ((0xD6E8FEB86659FD93, 7), (0xA0761D6478BD642F, 8)), ((0xE7037ED1A0B428DB, 9), (0x8EBC6AF09C88C6E3, 10)))


class _Powers:
    """Powers of an odd number and of its inverse, for hashes of all substrings by differences of sums."""

    def __init__(self, factor: int):
        self.factor = factor
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 65_536)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, self.factor, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, pow(self.factor, -1, 2**64), np.uint64))])
        return self.up[:n], self.down[:n]


_powers = functools.cache(_Powers)


@functools.cache
def _symbols(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def rolling(data: np.ndarray, width: int, family: tuple[int, int] = FAMILIES[0][0]) -> np.ndarray:
    """64-bit hashes of all substrings of this width, of one family."""
    n = len(data)
    up, down = _powers(family[0]).upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    terms = _symbols(family[1])[data]
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    out = sums[width:] - sums[:-width]
    out *= down[: n - width + 1]
    return _mix(out)


def _sliding(x: np.ndarray, width: int, best: np.ufunc, filler: int) -> np.ndarray:
    """The least (or greatest) of each run of width values."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, filler, np.uint64)]).reshape(-1, width)
    left = best.accumulate(padded, 1).ravel()
    right = best.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return best(right[:n], left[width - 1 : width - 1 + n])


def segments(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, bucket, first start, number of starts and anchor of each segment of texts that stand one after another.

    The anchor is the place of the bucket's hash in the segment, or -1 if it stands there more than once.
    """
    ends = np.cumsum(sizes)
    if not (sizes >= length).any():
        return tuple([np.empty(0, np.int64)] * 5)
    width = length - gram + 1
    hashes = rolling(data, gram)
    least = _sliding(hashes, width, np.minimum, 2**64 - 1)
    # Starts whose string stays inside its text; runs of one bucket break where that ends and where the bucket changes.
    inside = np.zeros(len(least) + 1, np.int32)
    long = sizes >= length
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, np.minimum((ends - length + 1)[long], len(least)), -1)
    inside = np.cumsum(inside)[:-1] > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    new[np.minimum((ends - sizes)[long], len(least) - 1)] = True
    begin = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.concatenate([new | ~inside, [True]]))
    count = stop[np.searchsorted(stop, begin, "right")] - begin
    parts = -(-count // width)  # several where one bucket goes on, as in periodic texts
    if len(parts) != parts.sum():
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, count = np.repeat(begin, parts) + within * width, np.minimum(np.repeat(count, parts) - within * width, width)
    bucket = least[begin]
    # A hash is the least of some run if the greatest of the least values of the runs that hold it is the hash itself.
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(_sliding(around, width, np.maximum, 0) == hashes)
    low, high = np.searchsorted(places, begin), np.searchsorted(places, begin + count + width - 1)
    held = high - low
    first = np.cumsum(held) - held
    at = places[np.repeat(low - first, held) + np.arange(held.sum())]
    same = hashes[at] == np.repeat(bucket, held)
    times = np.add.reduceat(same.astype(np.int64), first)
    where = np.add.reduceat(np.where(same, at, 0), first)
    text = np.searchsorted(ends, begin, "right")
    return text, bucket.view(np.int64), begin - (ends - sizes)[text], count, np.where(times == 1, where - begin, -1)


def repeated_starts(columns: np.ndarray, group: np.ndarray, length: int, starts: int) -> np.ndarray:
    """Whether the string of this length at each of the first columns (rows of the result) repeats in its group.

    columns: the symbols of all segments (one each) column after column; group: of each segment, in ascending order. Each round
    inserts one symbol of each segment. ``order`` is the suffix order in each group, ``common`` the common prefix with the suffix before.
    """
    m = columns.shape[1]
    group = group.astype(np.uint16) if group[-1] < 2**16 else group
    near = group[1:] == group[:-1]
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    flags = np.zeros((starts, m), bool)
    for c in range(columns.shape[0] - 1, -1, -1):
        symbol = columns[c][order]  # this column of the transform
        place = np.argsort(symbol, kind="stable")
        place = place[np.argsort(group[place], kind="stable")]
        symbol = symbol[place]
        k = np.flatnonzero((symbol[1:] == symbol[:-1]) & near & (symbol[1:] != OUTSIDE))
        ends = np.empty(2 * len(k), np.int64)
        ends[::2], ends[1::2] = place[k], place[k + 1]
        ends += 1
        longer = np.zeros(m + 1, np.int32)
        if len(k):
            longer[k + 1] = np.minimum(np.minimum.reduceat(common, ends)[::2] + 1, length)
        order, common = order[place], longer
        if c < starts:
            full = common >= length
            flags[c, order] = full[:-1] | full[1:]
    return flags


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after another, and where each value begins and the last ends."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)), ends - ends[0]


def repeated_runs(bucket: np.ndarray, anchor: np.ndarray, column: pa.Array, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of runs of repeated starts in segments, which are sorted by bucket."""
    code = np.asarray(column.dictionary_encode().indices)
    n = len(code)
    times = np.bincount(code)
    one = np.full(len(times), n)
    np.minimum.at(one, code, np.arange(n))
    data, ends = bytes_of(column)
    count = np.diff(ends) - length + 1
    whole = np.flatnonzero(times[code] > 1)
    found = [(whole, np.zeros(len(whole), np.int64), count[whole])]
    # A row of the columns for each anchor of each distinct segment: the strings whose first anchor it is.
    plain = one[anchor[one] >= 0]
    rows, place, begin, end = plain, anchor[plain], np.zeros(len(plain), np.int64), count[plain]
    times_of = times[code[plain]]
    several = _by_anchor([(i, np.flatnonzero(rolling(data[ends[i] : ends[i + 1]], gram).view(np.int64) == bucket[i])) for i in one[anchor[one] < 0].tolist()], data, ends, count, times[code], length)
    if several:
        settled = [(i, a, b) for n, uses in several if n > 1 for i, _, a, b in uses]
        if settled:
            found.append(tuple(np.array(x, np.int64) for x in zip(*settled, strict=True)))
        more = np.array([uses[0] for _, uses in several], np.int64)
        rows, place, begin, end = (np.concatenate([x, y]) for x, y in zip((rows, place, begin, end), more.T, strict=True))
        times_of = np.concatenate([times_of, [n for n, _ in several]])
    by_bucket = np.argsort(rows, kind="stable")
    rows, place, begin, end, times_of = (x[by_bucket] for x in (rows, place, begin, end, times_of))
    # Buckets with several such rows, one of which is open.
    group = np.unique(np.cumsum(np.concatenate([[0], np.diff(bucket) != 0]))[rows], return_inverse=True)[1]
    asked = np.bincount(group, times_of == 1) > 0
    keep = (asked & (np.bincount(group) > 1))[group]
    rows, place, begin, end, times_of, group = (x[keep] for x in (rows, place, begin, end, times_of, group))
    starts = length - gram + 1
    # Whole buckets, ROWS rows at a time.
    cuts = np.unique(np.concatenate([[0], np.searchsorted(group, group[ROWS::ROWS]), [len(rows)]])) if len(rows) else [0]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = slice(low, high)
        first = starts - 1 - place[part]  # the column of a segment's first byte
        table = np.full((high - low, starts - 1 + length), OUTSIDE, np.uint8)
        for k, (i, c, a, b) in enumerate(zip(rows[part].tolist(), first.tolist(), begin[part].tolist(), end[part].tolist(), strict=True)):
            table[k, c + a : c + b + length - 1] = data[ends[i] + a : ends[i] + b + length - 1]
        flags = repeated_starts(np.ascontiguousarray(table.T), np.unique(group[part], return_inverse=True)[1], length, starts).T
        open_ = times_of[part] == 1
        edge = np.diff(flags[open_].view(np.int8), axis=1, prepend=np.int8(0), append=np.int8(0))
        k, c = np.nonzero(edge)
        k, c = k[::2], c.reshape(-1, 2)
        found.append((rows[part][open_][k], c[:, 0] - first[open_][k], c[:, 1] - first[open_][k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _by_anchor(segments: list[tuple[int, np.ndarray]], data: np.ndarray, ends: np.ndarray, count: np.ndarray, times: np.ndarray, length: int) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """How often each distinct part occurs, and its uses (segment, anchor, first start, end), of segments with several anchors.

    A part holds the strings whose first anchor is one; periodic texts give equal parts.
    """
    parts: dict[tuple[int, bytes], list] = {}
    for i, places in segments:
        begin = 0
        for place in places.tolist():
            end = min(place + 1, int(count[i]))
            if begin < end:
                key = (place - begin, data[ends[i] + begin : ends[i] + end + length - 1].tobytes())
                held = parts.setdefault(key, [0, []])
                held[0] += int(times[i])
                held[1].append((i, place, begin, end))
            begin = place + 1
    return [(n, uses) for n, uses in parts.values()]


def _whole_blocks(batches: Iterator[pa.RecordBatch], limit: int, keys: int = 1) -> Iterator[pa.Table]:
    """Tables of about limit bytes from batches sorted by their first columns; rows with equal ones stay together."""
    held: list[pa.Table] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        table = pa.Table.from_batches([batch])
        if size >= limit and last != tuple(key[:, 0]):
            yield pa.concat_tables(held)
            held, size = [], 0
        last = tuple(key[:, -1])
        cut = int(np.flatnonzero((key != key[:, -1:]).any(0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
        if size + batch.nbytes >= limit and cut:
            yield pa.concat_tables([*held, table.slice(0, cut)])
            held, size, table = [], 0, table.slice(cut)
        held.append(table)
        size += table.nbytes
    if held:
        yield pa.concat_tables(held)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """A table for each value of the first columns, by which the batches are sorted."""
    for table in _whole_blocks(batches, 1, keys):
        key = np.stack([table.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)


def _column(table: pa.Table, k: int) -> np.ndarray:
    return table.column(k).to_numpy()


def _with_segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments of each row (h1, h2, data) as lists."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Parts of bounded size: the working arrays take many bytes for each byte of text.
            ends = bytes_of(batch.column(2))[1]
            cuts = [0, *(np.flatnonzero(np.diff(ends[1:] // CHUNK_BYTES)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield listed(batch.slice(a, b - a))

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ends = bytes_of(batch.column(2))
        text, *columns = segments(data, np.diff(ends), length, gram)
        offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
        kinds = [np.int64, np.int32, np.int16, np.int16]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(t))) for x, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["h1", "h2", "buckets", "starts", "counts", "anchors"])

    return rows.select("h1", "h2", "data").mapInArrow(find, "h1 long, h2 long, buckets array<long>, starts array<int>, counts array<short>, anchors array<short>")


def _cut_segments(texts: DataFrame, length: int) -> DataFrame:
    """A row for each wanted segment: its bucket and the size of that, its text, start, anchor and bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch.column(2))
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            bucket, size, start, count, anchor = (x.to_numpy() for x in lists.flatten().flatten())
            row = np.repeat(np.arange(len(lists)), np.diff(at))
            begin, n = ends[:-1][row] + start, count.astype(np.int64) + length - 1
            offsets = np.concatenate([[0], np.cumsum(n)])
            held = memoryview(data)
            joined = b"".join([held[a : a + k] for a, k in zip(begin.tolist(), n.tolist(), strict=True)])
            parts = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined)])
            h1, h2 = (batch.column(k).to_numpy()[row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (bucket, size, h1, h2, start, anchor)), parts], ["bucket", "size", "h1", "h2", "start", "anchor", "bytes"])

    return texts.select("h1", "h2", "data", "wanted").mapInArrow(cut, "bucket long, size long, h1 long, h2 long, start int, anchor short, bytes binary")


def _by_columns(rows: DataFrame, length: int, gram: int, block_bytes: int) -> DataFrame:
    """Runs (h1, h2, first, end) of repeated starts, from whole buckets in blocks of bounded size."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_blocks(batches, block_bytes):
            row, first, end = repeated_runs(_column(block, 0), _column(block, 4).astype(np.int64), block.column(5).combine_chunks(), length, gram)
            if len(row):
                start = _column(block, 3).astype(np.int64)[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_column(block, 1)[row], _column(block, 2)[row], start + first, start + end)], ["h1", "h2", "first", "end"])

    dealt = rows.select("bucket", "h1", "h2", "start", "anchor", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(find, "h1 long, h2 long, first long, end long")


_PRINT = np.dtype([("a", "<u8"), ("b", "<u8")])


def _prints(column: pa.Array, length: int, families: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """128-bit fingerprints of all strings of all values, how many each value has, the bytes of all, and where in them each string begins."""
    data, ends = bytes_of(column)
    count = np.diff(ends) - length + 1
    first = np.cumsum(count) - count
    at = np.arange(count.sum()) + np.repeat(ends[:-1] - first, count)
    out = np.empty(len(at), _PRINT)
    for family, name in zip(families, "ab", strict=True):
        out[name] = rolling(data, length, family)[at]
    return out, count, data, at


def _alike(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by fingerprint, and the number of each one's group in that order."""
    order = np.lexsort((prints["b"], prints["a"]))
    s = prints[order]
    return order, np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)


def _firsts(number: np.ndarray) -> np.ndarray:
    """Where each group begins in such an order."""
    return np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1]).astype(np.int64) if len(number) else np.empty(0, np.int64)


def _among(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The place of each asked fingerprint among the held ones, which are distinct; -1 if it isn't there."""
    order, sorted_number = _alike(np.concatenate([asked, held]))
    number = np.empty(len(order), np.int64)
    number[order] = sorted_number
    place = np.full(len(order), -1)
    place[number[len(asked) :]] = np.arange(len(held))
    return place[number[: len(asked)]]


def unequal(one: bytes, at: np.ndarray, other: bytes, there: np.ndarray, length: int) -> bool:
    """Whether a string of this length at a place of one differs from that at the same turn's place of the other.

    Places that go on side by side are compared as one stretch, so a run of strings costs its bytes once.
    """
    cuts = [0, *(np.flatnonzero((np.diff(at) != 1) | (np.diff(there) != 1)) + 1).tolist(), len(at)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            p, q, n = int(at[a]), int(there[a]), b - a + length - 1
            if one[p : p + n] != other[q : q + n]:
                return True
    return False


def packed(data: bytes, at: np.ndarray, length: int) -> tuple[bytes, np.ndarray]:
    """The bytes that strings at these ascending places cover, and where each string begins in them."""
    first = _firsts(np.cumsum(np.concatenate([[0], np.diff(at) > length])))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    sizes = at[last] + length - at[first]
    moved = np.repeat(at[first] - (np.cumsum(sizes) - sizes), np.diff(np.concatenate([first, [len(at)]])))
    return b"".join(data[p : p + n] for p, n in zip(at[first].tolist(), sizes.tolist(), strict=True)), at - moved


def _by_prints(rows: DataFrame, length: int, largest: int, families: tuple) -> DataFrame:
    """Runs of repeated starts (rows of kind RUN in a written table) in segments of large buckets, which have their bucket's size.

    A bucket's segments fall into blocks of bounded size. Each block sends the distinct fingerprints of its strings in ranges, a row
    for each range that it has any of. The task of a range finds those of several blocks, or of several places in one; each block hears
    which of its own these are and to which next block it has to show the bytes of which. Where bytes differ from what fingerprints told, the next pair of families is taken.
    """
    RUN, SHOWN, DIFFERS = 0, 1, 2
    parts = F.ceil(F.col("size") / largest)
    placed = rows.withColumn("ranges", parts).withColumn("block", F.pmod(F.xxhash64("h1", "h2", "start"), parts))
    placed = written(placed.select("bucket", "block", "ranges", "h1", "h2", "start", "bytes"), "repeats-blocks")

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys)

    def step(pair: tuple) -> DataFrame | None:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _groups(batches, 2):
                prints = _prints(block.column(3).combine_chunks(), length, pair)[0]
                order, number = _alike(prints)
                first = _firsts(number)
                own, again = prints[order][first], np.diff(np.concatenate([first, [len(number)]])) > 1
                ranges = own["a"] % np.uint64(_column(block, 2)[0])
                turn = np.argsort(ranges, kind="stable")
                for chosen in np.split(turn, _firsts(ranges[turn])[1:]):
                    yield pa.RecordBatch.from_pydict({"bucket": [_column(block, 0)[0]], "range": [int(ranges[chosen[0]])], "block": [_column(block, 1)[0]], "prints": [own[chosen].tobytes()], "again": [again[chosen].tobytes()]}, schema)

        schema = pa.schema([("bucket", pa.int64()), ("range", pa.int64()), ("block", pa.int64()), ("prints", pa.binary()), ("again", pa.binary())])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _groups(batches, 2):
                data, ends = bytes_of(group.column(3).combine_chunks())
                prints, again = np.frombuffer(data.tobytes(), _PRINT), bytes_of(group.column(4).combine_chunks())[0].view(bool)
                block = np.repeat(_column(group, 2), np.diff(ends) // 16)
                order, number = _alike(prints)
                several = np.bincount(number) > 1
                several[number[again[order]]] = True
                told = order[several[number]]
                near = number[1:] == number[:-1]
                # Told ones go to their block (to -1); those of the next block too are to be shown to it.
                at = np.concatenate([told, order[:-1][near]])
                to = np.concatenate([np.full(len(told), -1), block[order[1:][near]]])
                turn = np.lexsort((to, block[at]))
                at, to = at[turn], to[turn]
                if len(at):
                    first = np.concatenate([[0], np.flatnonzero((np.diff(block[at]) != 0) | (np.diff(to) != 0)) + 1])
                    lists = [prints[x].tobytes() for x in np.split(at, first[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(_column(group, 0)[:1], len(first))), pa.array(block[at][first]), pa.array(to[first]), pa.array(lists, pa.binary())], ["bucket", "block", "to", "prints"])

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _groups(batches, 2):
                said, own = group.filter(group.column(7).is_valid()), group.filter(group.column(5).is_valid())
                if not said.num_rows or not own.num_rows:
                    continue
                prints, count, data, at = _prints(own.column(5).combine_chunks(), length, pair)
                data = data.tobytes()
                order, number = _alike(prints)
                first = order[_firsts(number)]
                held, held_at = prints[first], at[first]
                raw, cuts = bytes_of(said.column(7).combine_chunks())
                place = _among(np.frombuffer(raw.tobytes(), _PRINT), held)
                to = np.repeat(_column(said, 6), np.diff(cuts) // 16)
                hit = np.zeros(len(held), bool)
                hit[place[to < 0]] = True
                known, one = np.empty(len(at), bool), np.empty(len(at), np.int64)
                known[order], one[order] = hit[number], held_at[number]
                differs = unequal(data, at[one != at], data, one[one != at], length)
                # A run ends where its segment does.
                ends = np.cumsum(count)
                a, b = _runs(np.insert(known, ends, False))
                row = np.searchsorted(ends + np.arange(1, len(ends) + 1), a, "right")
                base = _column(own, 4).astype(np.int64)[row] - (ends - count)[row] - row
                runs = [pa.array(x) for x in (_column(own, 2)[row], _column(own, 3)[row], a + base, b + base)]
                yield _row_batch(marks, kind=pa.array(np.full(len(row), RUN)), h1=runs[0], h2=runs[1], first=runs[2], end=runs[3])
                if differs:
                    yield _row_batch(marks, kind=pa.array([DIFFERS]))
                shown = np.flatnonzero(to >= 0)
                shown = shown[np.lexsort((held_at[place[shown]], to[shown]))]
                for mine in np.split(shown, _firsts(to[shown])[1:]) if len(shown) else []:
                    part, there = packed(data, held_at[place[mine]], length)
                    where = {"bucket": pa.array([_column(own, 0)[0]]), "block": pa.array([to[mine[0]]])}
                    yield _row_batch(marks, kind=pa.array([SHOWN]), **where, prints=pa.array([held[place[mine]].tobytes()]), places=pa.array([there.tolist()]), part=pa.array([part]))

        def hold_against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _groups(batches, 2):
                shown, own = group.filter(group.column(3).is_valid()), group.filter(group.column(2).is_valid())
                if not shown.num_rows:
                    continue
                prints, _, data, at = _prints(own.column(2).combine_chunks(), length, pair)
                data = data.tobytes()
                order, number = _alike(prints)
                first = order[_firsts(number)]
                raw, cuts = bytes_of(shown.column(3).combine_chunks())
                mine = at[first][_among(np.frombuffer(raw.tobytes(), _PRINT), prints[first])]
                parts = shown.column(5).to_pylist()
                for k, (a, b) in enumerate(zip(cuts // 16, cuts[1:] // 16, strict=False)):
                    if unequal(data, mine[a:b], parts[k], np.array(shown.column(4)[k].values), length):
                        yield pa.RecordBatch.from_arrays([pa.array([_column(group, 0)[0]])], ["bucket"])

        marks = pa.schema([("kind", pa.int64()), *((c, pa.int64()) for c in ("h1", "h2", "first", "end", "bucket", "block")), ("prints", pa.binary()), ("places", pa.list_(pa.int64())), ("part", pa.binary())])
        sent = dealt(placed.select("bucket", "block", "ranges", "bytes"), "bucket", "block").mapInArrow(send, "bucket long, range long, block long, prints binary, again binary")
        told = dealt(sent, "bucket", "range").mapInArrow(compare, "bucket long, block long, to long, prints binary")
        both = placed.drop("ranges").withColumns({"to": F.lit(None).cast("long"), "prints": F.lit(None).cast("binary")}).unionByName(told, allowMissingColumns=True)
        marked = dealt(both.select("bucket", "block", "h1", "h2", "start", "bytes", "to", "prints"), "bucket", "block")
        marked = written(marked.mapInArrow(mark, "kind long, h1 long, h2 long, first long, end long, bucket long, block long, prints binary, places array<long>, part binary"), "repeats-marked")
        shown = marked.filter(F.col("kind") == SHOWN).select("bucket", "block", "prints", "places", "part")
        asked = placed.join(shown.select("bucket", "block").distinct(), ["bucket", "block"], "left_semi").select("bucket", "block", "bytes")
        against = asked.unionByName(shown, allowMissingColumns=True).select("bucket", "block", "bytes", "prints", "places", "part")
        wrong = marked.filter(F.col("kind") == DIFFERS).select("bucket").unionByName(dealt(against, "bucket", "block").mapInArrow(hold_against, "bucket long"))
        if not wrong.count():
            return marked
        removed(marked)
        return None

    try:
        for pair in families:
            marked = step(pair)
            if marked is not None:
                return marked
    finally:
        removed(placed)
    raise ValueError("unequal strings have equal fingerprints in all pairs of hash families; pass others")


def _row_batch(schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    """A batch in which columns that aren't given are null."""
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _shared_runs(texts: DataFrame, length: int, gram: int, largest: int, block_bytes: int, tag: str, families: tuple) -> DataFrame:
    """h1, h2 and runs of repeated starts, from distinct texts (h1, h2, data)."""
    marks = written(_with_segments(texts, length, gram), f"{tag}-marks")
    each = marks.select("h1", "h2", F.explode(F.arrays_zip("buckets", "starts", "counts", "anchors")).alias("s")).select("h1", "h2", "s.*")
    shared = each.groupBy("buckets").agg(F.count(F.lit(1)).alias("size"), F.min("anchors").alias("least")).filter("size > 1 or least < 0")
    shared = written(shared.select("buckets", "size"), f"{tag}-shared")
    wanted = each.join(shared, "buckets").groupBy("h1", "h2").agg(F.collect_list(F.struct("buckets", "size", "starts", "counts", "anchors")).alias("wanted"))
    cut = written(_cut_segments(texts.join(wanted, ["h1", "h2"]), length), f"{tag}-segments")
    found = _by_columns(cut.filter(F.col("size") <= largest), length, gram, block_bytes)
    marked = _by_prints(cut.filter(F.col("size") > largest), length, largest, families)
    found = found.unionByName(marked.filter("kind = 0").select("h1", "h2", "first", "end"))
    found = written(found.groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "end")).alias("runs")), f"{tag}-runs")
    removed(marks, shared, cut, marked)
    return found


def _pieces(texts: DataFrame, least: int, reach: int) -> DataFrame:
    """The parts of texts (h1, h2, n, data, runs) that runs of at least so many starts cover, with the reach of the last start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch.column(3))
            row, start, parts = [], [], []
            for k, runs in enumerate(batch.column(4).to_pylist()):
                for first, end in joined_runs(runs):
                    if end - first >= least:
                        row.append(k)
                        start.append(first)
                        parts.append(data[ends[k] + first : ends[k] + end + reach - 1].tobytes())
            own = [pa.array(batch.column(k).to_numpy()[row]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(start, pa.int64()), pa.array(parts, pa.binary())], ["t1", "t2", "n", "start", "data"])

    return texts.select("h1", "h2", "n", "data", "runs").mapInArrow(cut, "t1 long, t2 long, n long, start long, data binary")


def joined_runs(runs: list[dict]) -> list[tuple[int, int]]:
    """Runs of starts in order; those that touch or overlap are one."""
    out: list[list[int]] = []
    for first, end in sorted((r["first"], r["end"]) for r in runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def _cleaned(texts: DataFrame, length: int, text: bool) -> DataFrame:
    """h1, h2, n_removed, n_spans, n_passages, kept_sha256 and (if asked for) kept, the text that is left, from texts with runs of
    repeated starts and runs of repeated shorter strings (held).

    Where a removed string begins or ends inside a character, the text leaves out what is left of that character.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, spans, passages, kept, digest = [], [], [], [], []
            for data, runs, held in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                cut: list[list[int]] = []
                for first, end in joined_runs(runs or []):
                    if cut and first <= cut[-1][1]:
                        cut[-1][1] = end + length - 1
                    else:
                        cut.append([first, end + length - 1])
                rest = b"".join(data[x:y] for x, y in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(data)], strict=True))
                gone.append(sum(b - a for a, b in cut))
                spans.append(len(cut))
                passages.append(len(joined_runs(held)))
                digest.append(hashlib.sha256(rest).hexdigest())
                if text:
                    kept.append(rest.decode(errors="ignore"))
            columns = [*(pa.array(x, pa.int64()) for x in (gone, spans, passages)), *(pa.array(x, pa.string()) for x in ((digest, kept) if text else (digest,)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    names = ["h1", "h2", "n_removed", "n_spans", "n_passages", "kept_sha256", *(["kept"] if text else [])]
    kinds = ["long"] * 5 + ["string"] * (len(names) - 5)
    return texts.select("h1", "h2", "data", "runs", "held").mapInArrow(clean, ", ".join(map(" ".join, zip(names, kinds, strict=True))))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a 128-bit key (h1, h2) of the text; null counts as empty."""
    return docs.withColumns({"h1": F.xxhash64(or_empty(text)), "h2": F.xxhash64(F.lit(1), or_empty(text))})


def repeated_strings(docs: DataFrame, *, length: int = LENGTH, passage: int | None = None, gram: int = GRAM, text: str = "text", largest: int = LARGEST_BUCKET, block_bytes: int = BLOCK_BYTES, keep_text: bool = True, families: tuple = FAMILIES) -> DataFrame:
    """For each text that holds a repeated string, by key: n_removed, n_spans, n_passages, kept_sha256 and kept (text, if asked for).

    passage, a number of bytes below length: n_passages counts runs of repeated strings of that many bytes, else of length;
    bytes go by length in any case.
    """
    small_batches(docs.sparkSession)
    shortest = passage or length
    rows = keyed(docs.select(or_empty(text).alias("text"))).select("h1", "h2", F.col("text").cast("binary").alias("data"))
    one_each = rows.filter(F.octet_length("data") >= shortest).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.first("data").alias("data"))
    texts = bucketed(one_each, "repeats-texts", "h1", "h2")

    def with_runs(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
        """Texts of several rows repeat as wholes; others have the runs that were found, or go."""
        whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.octet_length("data") - length + 1).cast("long").alias("end")))
        both = texts.join(found, ["h1", "h2"], "left").withColumn("runs", F.when(F.col("n") > 1, whole).otherwise(F.col("runs")))
        return both.filter("runs is not null")

    outer = _shared_runs(texts, shortest, gram, largest, block_bytes, "repeats", families)
    found = with_runs(texts, outer, shortest)
    if passage is None:
        done = written(_cleaned(found.withColumn("held", F.col("runs")), length, keep_text), "repeats-found")
        removed(texts, outer)
        return done
    pieces = _pieces(found, length - passage + 1, passage).withColumns({"h1": F.xxhash64("data"), "h2": F.xxhash64(F.lit(1), "data")})
    pieces = written(pieces, "repeats-pieces")
    distinct = bucketed(pieces.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.first("data").alias("data")), "repeats-distinct", "h1", "h2")
    inner = _shared_runs(distinct, length, gram, largest, block_bytes, "repeats-inner", families)
    moved = pieces.select("t1", "t2", "start", "h1", "h2").join(with_runs(distinct, inner, length).select("h1", "h2", "runs"), ["h1", "h2"])
    moved = moved.select(F.col("t1").alias("h1"), F.col("t2").alias("h2"), F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).alias("first"), (r["end"] + F.col("start")).alias("end"))).alias("part"))
    moved = written(moved.groupBy("h1", "h2").agg(F.flatten(F.collect_list("part")).alias("runs")), "repeats-moved")
    removed(pieces, distinct, inner)
    done = written(_cleaned(found.withColumnRenamed("runs", "held").join(moved, ["h1", "h2"], "left"), length, keep_text), "repeats-found")
    removed(texts, outer, moved)
    return done


def op5_column_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = repeated_strings(docs, passage=PASSAGE, keep_text=False)
    rows = keyed(docs).select("doc_id", "h1", "h2", F.octet_length(or_empty("text")).cast("long").alias("n_bytes"), F.sha2(or_empty("text"), 256).alias("whole"))
    rows = rows.join(found, ["h1", "h2"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), count("n_passages"))


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 1312) AS p FROM (SELECT doc_id, n, h, unnest(range(0, n, 256)) AS c FROM d)),
k AS (SELECT doc_id, c, p, greatest(0, least(256, n - 399 - c)) AS long, greatest(0, least(256, n - 249 - c)) AS short FROM pieces),
long AS (SELECT doc_id, c + unnest(range(0, long)) AS s, unnest(list_transform(range(0, long), lambda i: hash(substr(p, 2 * i + 1, 800)))) AS key FROM k),
short AS (SELECT doc_id, c + unnest(range(0, short)) AS s, unnest(list_transform(range(0, short), lambda i: hash(substr(p, 2 * i + 1, 500)))) AS key FROM k),
again AS (SELECT doc_id, s FROM long WHERE key IN (SELECT key FROM long GROUP BY key HAVING count(*) > 1)),
held AS (SELECT doc_id, s FROM short WHERE key IN (SELECT key FROM short GROUP BY key HAVING count(*) > 1)),
marked AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER w + 400 THEN 1 ELSE 0 END AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked),
spans AS (SELECT doc_id, min(s) AS b, max(s) + 400 AS e FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a, b FROM spans UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
LEFT JOIN (
  SELECT doc_id, count(DISTINCT run) AS n_passages FROM (SELECT doc_id, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS run FROM held) GROUP BY doc_id) USING (doc_id)
"""
