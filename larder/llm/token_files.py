"""Operator 7: token ids as flat binary files with document offsets.

Format, one shard for each range of document ids, in ascending order of ids:

- ``*.ids``: the ids of all documents of the shard, one after another, unsigned little-endian integers of 16 bits where the
  vocabulary has at most 65,536 entries, of 32 bits elsewhere;
- ``*.offsets``: where each document begins in the shard, and the end of the last, unsigned 64-bit little-endian;
- ``*.keys``: the document ids, signed 64-bit little-endian (0 where the id is null).

Spark deals documents out by ranges of their ids; each task sorts its range and writes its shard under a name of
its own, so a task that is run again leaves no mixed files. The shards' totals, one row for each task, are
summed to the place of each shard's first id in the whole. Readers map the files into memory.

Texts are split where a single space or line end stands between two characters that are no white space: the tokenizer's
pattern always begins a new piece there, so ids of such units don't depend on their neighbours, and each
worker remembers units up to a fixed number, the least recently met half going first. A text that holds an added token as a string is encoded whole.

Defined cases: a null text is an empty document and has the end id alone; null ids come first; equal ids are
ordered by a hash of the text; an empty table gives no shards. The folder must be mounted as a file system.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import documents, or_empty, posix_path, shared_dir, small_batches

REMEMBERED = 600_000
LONGEST_REMEMBERED = 64
UNIT = re.compile(r"(?<=\S) (?=\S)")
LETTERS_AND_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,!?;:*%$&#]+)")
READ_ROWS = 8192
#: Texts are encoded together up to these bounds, so that words which recur are looked up once.
GATHER_ROWS, GATHER_BYTES = 2048, 8_000_000


class UnitEncoder:
    """The library's ids of whole texts as bytes of the shards' integer type, from remembered units."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.library.get_vocab()
        self.type = id_type(max(vocabulary.values()))
        self.newline = vocabulary["Ċ"]
        #: Ids of tokens that begin with a space, which in units joined by spaces are the first of each.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.units, self.firsts = Remembered(), Remembered()  # units after a space (kept without it), and at the begin of lines

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type).tobytes()

    def _learn(self, known: Remembered, new: list[str], by: str) -> None:
        """Encodes units in one text, each after a space or (by) joined by line ends, and parts the ids again."""
        if by == " ":
            # Letters and the signs after them are always two pieces.
            parts = {u: m.groups() for u in new if (m := LETTERS_AND_SIGNS.fullmatch(u))}
            heads = sorted({h for h, _ in parts.values() if h not in known.now})
            self._learn_each(known, [*heads, *(u for u in new if u not in parts)], by)
            for u, (head, tail) in parts.items():
                known.now[u] = known.now[head] + self._signs(tail)
        else:
            self._learn_each(known, new, by)

    @lru_cache(maxsize=4096)  # noqa: B019
    def _signs(self, signs: str) -> bytes:
        return self.whole(signs)

    def _learn_each(self, known: Remembered, new: list[str], by: str) -> None:
        for k in range(0, len(new), 2_000):
            units = new[k : k + 2_000]
            text = " " + " ".join(units) if by == " " else "\n".join(units)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            width, data = self.type.itemsize, ids.astype(self.type).tobytes()
            if by == " ":
                at = np.flatnonzero(self.spaced[ids]) * width
                begins, ends = at.tolist(), [*at[1:].tolist(), len(data)]
            else:
                at = np.flatnonzero(ids == self.newline) * width
                begins, ends = [0, *(at + width).tolist()], [*at.tolist(), len(data)]
            if len(begins) == len(units):
                known.now.update({u: data[a:b] for u, a, b in zip(units, begins, ends, strict=True)})
            else:
                known.now.update({u: self.whole((" " if by == " " else "") + u) for u in units})

    def encode_all(self, texts: list[str]) -> list[bytes]:
        lines = [None if not t or self.added and self.added.search(t) else [line.split(" ") for line in t.split("\n")] for t in texts]
        for known, used, by in (
            (self.firsts, {p[0] for line in lines if line for p in line}, "\n"),
            (self.units, set().union(*[p[1:] for line in lines if line for p in line]), " "),
        ):
            new = known.missing(used)
            # A unit with white space at an end, or none at all, isn't apart from its neighbours.
            apart = [u for u in new if u and not u[0].isspace() and not u[-1].isspace()]
            self._learn(known, sorted(apart), by)
        units, firsts, newline = self.units.now, self.firsts.now, np.array([self.newline], self.type).tobytes()
        out = []
        for text, parts in zip(texts, lines, strict=True):
            if parts:
                try:
                    out.append(newline.join([firsts[p[0]] + b"".join(map(units.__getitem__, p[1:])) for p in parts]))
                except KeyError:  # white space that isn't a single space or line end between other characters
                    first, *rest = UNIT.split(text)
                    out.append(self.whole(first) + b"".join([units.get(u) or self.whole(" " + u) for u in rest]))
            else:
                out.append(self.whole(text) if text else b"")
        self.units.forget()
        self.firsts.forget()
        return out


class Remembered:
    """Units and their ids: a younger and an older half; what is met again moves to the younger."""

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.now: dict = {}
        self.older: dict = {}

    def missing(self, used: set[str]) -> set[str]:
        new = used - self.now.keys()
        if self.older:
            for u in new & self.older.keys():
                self.now[u] = self.older[u]
            new -= self.now.keys()
        return new

    def forget(self) -> None:
        """Bounds what is held, between batches."""
        if len(self.now) > self.most:
            self.now, self.older = {}, {u: ids for u, ids in self.now.items() if len(u) <= LONGEST_REMEMBERED}


def id_type(largest: int) -> np.dtype:
    """The narrowest unsigned little-endian type for ids up to largest."""
    return np.dtype("<u2" if largest < 2**16 else "<u4")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHER_ROWS or sum(b.nbytes for b in held) >= GATHER_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


@lru_cache(maxsize=2)
def encoder(model: str) -> UnitEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
    return UnitEncoder(model)


def write_token_files(docs: DataFrame, model: str, folder: str, *, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> list[dict]:
    """Writes the shards of docs below folder; gives the manifest, which is also written as manifest.json.

    A manifest entry has the shard's name, its documents, ids, documents with a null id, bytes of an id, and first: ids before it.
    """
    spark, path = docs.sparkSession, posix_path(folder)
    small_batches(spark)
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, name = encoder(model), f"{path}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        end, width = np.array([end_id], tool.type).tobytes(), tool.type.itemsize
        offset = n_docs = n_null = 0
        with open(f"{name}.ids", "wb") as ids, open(f"{name}.offsets", "wb") as offsets, open(f"{name}.keys", "wb") as keys:
            offsets.write(np.array([0], "<u8").tobytes())
            for batch in _gathered(batches):
                n_null += batch.column(0).null_count
                keys.write(batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
                sizes = []
                for x in tool.encode_all(batch.column(1).to_pylist()):
                    ids.write(x)
                    ids.write(end)
                    sizes.append(len(x) // width + 1)
                at = offset + np.cumsum(np.array(sizes, "<u8"), dtype="<u8")
                offsets.write(at.tobytes())
                offset, n_docs = int(at[-1]) if len(at) else offset, n_docs + len(sizes)
        yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "name": [name], "n_docs": [n_docs], "n_ids": [offset], "n_null": [n_null], "width": [width]})

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), or_empty(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.col("tie")]
    ranges = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = ranges.mapInArrow(write, "shard long, name string, n_docs long, n_ids long, n_null long, width long").collect()  # a row for each shard
    manifest, first = [], 0
    for row in sorted(done):
        if row.n_docs:
            manifest.append({"name": row.name, "n_docs": row.n_docs, "n_ids": row.n_ids, "n_null": row.n_null, "width": row.width, "first": first})
            first += row.n_ids
    with open(f"{path}/manifest.json", "w") as out:
        json.dump(manifest, out)
    return manifest


def read_token_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the memory-mapped shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (row for batch in batches for row in batch.to_pylist()):
            offsets = np.memmap(f"{shard['name']}.offsets", "<u8", "r")
            keys = np.memmap(f"{shard['name']}.keys", "<i8", "r")
            ids = np.memmap(f"{shard['name']}.ids", f"<u{shard['width']}", "r")
            for at in range(0, len(keys), READ_ROWS):
                to = min(at + READ_ROWS, len(keys))
                begin, stop = offsets[at:to].astype("i8"), offsets[at + 1 : to + 1].astype("i8")
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(begin, stop, strict=True)]
                key = pa.array(np.array(keys[at:to]), pa.int64(), mask=np.arange(at, to) < shard["n_null"])
                yield pa.RecordBatch.from_arrays([key, pa.array(begin + shard["first"]), pa.array(stop - begin), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "name string, n_docs long, n_ids long, n_null long, width long, first long"
    shards = spark.createDataFrame([tuple(x[k] for k in ("name", "n_docs", "n_ids", "n_null", "width", "first")) for x in manifest], schema)
    return shards.repartition(max(1, len(manifest)), "name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-files"))
    return read_token_files(spark, manifest)
