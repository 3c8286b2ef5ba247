"""Operator 2: token counts by overlap resynchronisation.

Texts up to ``chunk`` characters are encoded whole. A longer one is cut into chunks that overlap; each chunk is
encoded on its own with the character offsets of its tokens, and neighbours are spliced at a boundary that both
encodings have inside the overlap and that is proven stable: no piece of the vocabulary holds the two characters
beside it next to each other, so no merge can reach over it and what stands on one side cannot change the other.
Where an overlap has no such boundary it is widened, twice as wide each time, up to the rest of the text.

A stable boundary makes the two sides independent, so counts and ids equal those of the whole text.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows get equal counts; an empty table
gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import documents, or_empty, small_batches

CHUNK, OVERLAP = 32_768, 256
SPACE = "▁"


class ChunkedEncoder:
    """A SentencePiece model without normalisation, and the pairs of characters that its pieces hold."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def tokens(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """(offset of the first character in text, id) of each token of text[start:end].

        The library puts a space before what it encodes; it belongs to the text only at start 0, where its offset is -1.
        """
        pieces = self.library.encode(text[start:end], out_type=str)
        ids = self.library.encode(text[start:end])
        out, at, need = [], start - 1, 0
        for piece, token in zip(pieces, ids, strict=True):
            out.append((at, token))
            if need:  # further bytes of a character that the vocabulary lacks
                need -= 1
                at += need == 0
            elif self.library.is_byte(token):
                lead = int(piece[3:5], 16)
                need = 0 if lead < 0x80 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
                at += need == 0
            else:
                at += 1 if self.library.is_unknown(token) else len(piece)
        return out

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Ids of the whole text, from chunks that are spliced at stable boundaries."""
        ids: list[int] = []
        start, kept_from, end = 0, -1, min(chunk, len(text))
        now = self.tokens(text, 0, end)
        while end < len(text):
            wide = overlap
            while True:
                begin, stop = max(start + 1, end - wide), min(end - min(wide, end - start - 1) + chunk + wide, len(text))
                then = self.tokens(text, begin, stop)
                here = {at for at, _ in now if at > max(begin, kept_from)}
                splice = next((at for at, _ in then if at in here and self.stable(text, at)), None)
                if splice is not None:
                    ids += [token for at, token in now if kept_from <= at < splice]
                    now, start, end, kept_from = then, begin, stop, splice
                    break
                if begin == start + 1:  # the overlap is the whole chunk: the chunk itself must grow
                    end = min(len(text), end + chunk + wide)
                    now = self.tokens(text, start, end)
                    if end == len(text):
                        break
                wide *= 2
        return ids + [token for at, token in now if at >= kept_from]


@lru_cache(maxsize=2)
def encoder(model: str) -> ChunkedEncoder:
    return ChunkedEncoder(model)


def token_counts(docs: DataFrame, model: str, *, limit: int = 4096, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; model is a path that executors can open."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for i, ids in zip(short, tool.library.encode([texts[i] for i in short], num_threads=1), strict=True):
                n[i] = len(ids)
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = len(tool.encode(t, chunk, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), or_empty(text).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
