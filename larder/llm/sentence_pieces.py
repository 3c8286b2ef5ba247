"""Operator 6: SentencePiece encoding and decoding with a merge-type prefix table.

In the encoding of any text, two neighbours are compatible: encoding their joined text gives the same two tokens
back. So each prefix of a text has one last token, the token that ends there and is compatible with the last
token of the prefix before it. The table of last tokens is filled from left to right: an Aho-Corasick automaton
of the vocabulary gives the tokens that end at a place, longest first, and a test of the pair accepts one. The
ids are then read backwards from the end of the table.

The pair test undoes merges instead of running them: it takes back the later of the last merges of both tokens
until single characters are left, and fails when, at a point in time, the two parts that touch would have merged
before the merge that was just taken back.

No piece holds a space after another character, so text is tabled in units of one word with the spaces before it, and these in
parts where a letter meets a sign that no piece joins with letters, such as a comma. Words and parts are remembered by a task, up to a fixed
number in each worker, those not met for long going first. Characters that the vocabulary lacks stand alone and become bytes.

Defined cases: null texts are empty texts and give no ids; repeated rows get equal results; the replacement
character stands for ids whose bytes are no UTF-8; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import documents, or_empty, small_batches
from larder.llm.token_files import Remembered

SPACE = "▁"
REMEMBERED = 300_000
LETTERS, SIGNS = "A-Za-zÀ-ɏ", ".,!?;:\n\"()"


class PrefixTable:
    """Encoder and decoder of a SentencePiece BPE model without normalisation, with byte fallback."""

    def __init__(self, model: str, as_bytes: bool = False):
        import ahocorasick
        import sentencepiece

        self.as_bytes = as_bytes
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = library.get_piece_size()
        self.text = [library.id_to_piece(i) for i in range(n)]
        self.bytes_id = {int(self.text[i][3:5], 16): i for i in range(n) if library.is_byte(i)}
        normal = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.id = {self.text[i]: i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece holds a space after another character, so words cannot be tabled by themselves")
        # The place of a token's last merge in the order of merges; single characters have none.
        by_score = sorted((i for i in normal if len(self.text[i]) > 1), key=lambda i: (-library.get_score(i), i))
        self.rank = [-1] * n
        for k, i in enumerate(by_score):
            self.rank[i] = k
        self.parts: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}
        # Words as they stand after a space, and parts of words: ids (as text or as bytes), and the decoded text.
        self.words, self.parts_of_words = Remembered(REMEMBERED), Remembered(REMEMBERED)
        signs = re.escape("".join(c for c in SIGNS if not any(re.search(f"[{LETTERS}]{re.escape(c)}|{re.escape(c)}[{LETTERS}]", p) for p in self.id)))
        self.apart = re.compile(f"(?<=[{LETTERS}])(?=[{signs}])|(?<=[{signs}])(?=[{LETTERS}])") if signs else re.compile("(?!)")
        usable = [p for p in self.id if len(p) == 1 or self._merges_to(p)]
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, (len(p), self.id[p]))
        self.automaton.make_automaton()
        self.decoded = [b"" if library.is_control(i) else bytes([int(self.text[i][3:5], 16)]) if library.is_byte(i) else (" ⁇ " if library.is_unknown(i) else self.text[i].replace(SPACE, " ")).encode() for i in range(n)]

    def _merges_to(self, piece: str) -> bool:
        """Runs the merges inside one piece; keeps its last pair. Pieces that their own merges never reach can't occur."""
        parts = [self.id.get(c, -1) for c in piece]
        last = None
        while len(parts) > 1:
            best, at, into = None, -1, -1
            for k in range(len(parts) - 1):
                if parts[k] >= 0 and parts[k + 1] >= 0:
                    joined = self.id.get(self.text[parts[k]] + self.text[parts[k + 1]])
                    if joined is not None and (best is None or self.rank[joined] < best):
                        best, at, into = self.rank[joined], k, joined
            if best is None:
                return False
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [into]
        if last:
            self.parts[parts[0]] = last
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (found := self.known.get(key)) is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        before = float("inf")  # merges up to here are done; ties go to the left
        text, rank, ids = self.text, self.rank, self.id
        while True:
            joined = ids.get(text[a] + text[b])
            if joined is not None and rank[joined] < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], self.parts[a][1]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.parts[b][0]
            else:
                return True

    def encode_unit(self, unit: str) -> list[int]:
        """Fills the table of last tokens for one unit and reads the ids from its end."""
        last: list[int] = [-2] * (len(unit) + 1)  # last[k]: last token of the first k characters; -2: a character outside the vocabulary
        known, compatible, filled = self.known, self.compatible, -1
        for end, (length, token) in self.automaton.iter(unit):  # for each end the longest token first
            if end == filled:
                continue
            begin = end + 1 - length
            if not begin or (prior := last[begin]) == -2 or (known[key] if (key := prior << 20 | token) in known else compatible(prior, token)):
                last[end + 1], filled = token, end
        out, k = [], len(unit)
        while k:
            if (token := last[k]) == -2:
                out += [self.bytes_id[x] for x in reversed(unit[k - 1].encode())]
                k -= 1
            else:
                out.append(token)
                k -= len(self.text[token])
        return out[::-1]

    def _row(self, ids: list[int]) -> tuple[str | bytes, str]:
        held = np.array(ids, np.int32).tobytes() if self.as_bytes else ",".join(map(str, ids))
        return held, b"".join([self.decoded[i] for i in ids]).decode(errors="replace")

    def _word(self, word: str) -> tuple[str | bytes, str]:
        """A word after a space, from its parts."""
        known, rows = self.parts_of_words.now, []
        for part in self.apart.split(SPACE + word):
            if (row := known.get(part)) is None:
                row = known[part] = self.parts_of_words.older.get(part) or self._row(self.encode_unit(part))
            rows.append(row)
        if len(rows) == 1:
            return rows[0]
        return (b"" if self.as_bytes else ",").join([r[0] for r in rows]), "".join([r[1] for r in rows])

    def split(self, text: str) -> list[str]:
        """Units of a text, the first with the space that encoding puts before it."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)

    def rows(self, texts: list[str]) -> Iterator[tuple[list, list]]:
        """Ids and decoded text of the units of each text."""
        # Words between single spaces; texts with other spaces, or with the mark of a space as a character, go unit by unit.
        split = [None if not t or SPACE in t or "  " in t or t[0] == " " or t[-1] == " " else t.split(" ") for t in texts]
        known = self.words
        for word in known.missing(set().union(*[w for w in split if w])):
            known.now[word] = self._word(word)
        for text, words in zip(texts, split, strict=True):
            found = list(map(known.now.__getitem__, words)) if words else [self._row(self.encode_unit(u)) for u in self.split(text)]
            yield [r[0] for r in found], [r[1] for r in found]
        known.forget()
        self.parts_of_words.forget()

    def forget(self) -> None:
        """Words, parts and pairs go; the table stays."""
        self.known.clear()
        self.words, self.parts_of_words = Remembered(REMEMBERED), Remembered(REMEMBERED)

    def encode(self, text: str) -> list[int]:
        return [i for u in self.split(text) for i in self.encode_unit(u)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.decoded[i] for i in ids]).decode(errors="replace").removeprefix(" ")


@lru_cache(maxsize=2)
def table(model: str, as_bytes: bool = False) -> PrefixTable:
    return PrefixTable(model, as_bytes)


@contextmanager
def table_of_task(model: str, as_bytes: bool = False) -> Iterator[PrefixTable]:
    """The table of this worker, which outlives the task; what it remembers goes at the end, since idle workers would hold it through all later steps."""
    tool = table(model, as_bytes)
    try:
        yield tool
    finally:
        tool.forget()


def encode_decode(docs: DataFrame, model: str, *, text: str = "text", doc_id: str = "doc_id", outputs: str = "digests") -> DataFrame:
    """Encodes and decodes each row. outputs "digests": n_tokens and SHA-256 values; "ids": n_tokens, the ids, the text decoded from them and whether it is the text that was encoded."""
    small_batches(docs.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed: Callable[[str], str] = lambda s: hashlib.sha256(s.encode()).hexdigest()
        with table_of_task(model, False) as tool:
            for batch in batches:
                n, ids, back = [], [], []
                for held, decoded in tool.rows(batch.column(1).to_pylist()):
                    line = ",".join(held)
                    n.append(line.count(",") + 1 if line else 0)
                    ids.append(hexed(line))
                    back.append(hexed("".join(decoded).removeprefix(" ")))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with table_of_task(model, True) as tool:
            for batch in batches:
                ids, back, same = [], [], []
                texts = batch.column(1).to_pylist()
                for t, (held, decoded) in zip(texts, tool.rows(texts), strict=True):
                    ids.append(b"".join(held))
                    back.append("".join(decoded).removeprefix(" "))
                    same.append(back[-1] == t)
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists, pa.array(back, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "decoded", "restored"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if outputs == "ids":
        return rows.mapInArrow(whole, f"doc_id {kind}, n_tokens long, ids array<int>, decoded string, restored boolean")
    return rows.mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
