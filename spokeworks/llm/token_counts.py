"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Neighbouring chunks are spliced at a
boundary that both encodings have and that is proven stable: no piece of the vocabulary holds the
two characters beside it next to each other, so no merge can ever cross it, whatever stands around.
Where the overlap holds no such boundary, or the two encodings disagree, it is widened.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, text_of

SPACE = "▁"


class ChunkedCounter:
    """Counts of one sentencepiece model whose normaliser is the identity (BPE, dummy prefix, byte fallback)."""

    def __init__(self, path: str, chunk: int, overlap: int):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        ids = range(self.model.get_piece_size())
        plain = [not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)) for i in ids]
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.inside = {p[k : k + 2] for p, ok in zip(pieces, plain, strict=True) if ok for k in range(len(p) - 1)}
        self.width = np.array([1 if self.model.is_byte(i) else len(pieces[i].encode()) for i in ids])

    def stable(self, text: str, start: int, overlap: int) -> tuple[int, int]:
        """The first proven boundary from ``start`` on, or the text's end, and the overlap at which it was found."""
        at = start
        while at < len(text):
            stop = min(start + overlap, len(text))
            for p in range(at, stop):
                if text[p - 1 : p + 1] not in self.inside:
                    return p, overlap
            at, overlap = stop, overlap * 2
        return len(text), overlap

    def pieces(self, text: str) -> list[tuple[int, int, int]]:
        """(from, splice, next splice) of each chunk of a text in which spaces are written as SPACE."""
        out, splice, before = [], 0, self.overlap
        while splice < len(text):
            after, wide = self.stable(text, splice + self.chunk, self.overlap)
            out.append((max(0, splice - before), splice, after))
            splice, before = after, wide
        return out

    def count_chunk(self, text: str, start: int, splice: int, after: int) -> int:
        """Tokens between two splices, found in an encoding that reaches beyond both."""
        wide = self.overlap
        while True:
            stop = min(len(text), after + wide)
            ids = np.array(self.model.encode(text[start:stop]), np.int64)
            ends = np.concatenate([[0], np.cumsum(self.width[ids])])
            lead = len(SPACE.encode())  # the dummy prefix
            low = 0 if splice == 0 else lead + len(text[start:splice].encode())
            high = lead + len(text[start:after].encode())
            i, j = np.searchsorted(ends, [low, high])
            if ends[i] == low and ends[j] == high:
                return int(j - i)
            if start == 0 and stop == len(text):
                raise ValueError("the encoding has no boundary at a splice")
            start, wide = max(0, start - wide), wide * 2

    def count(self, texts: list[str]) -> list[int]:
        short = [len(t) <= self.chunk for t in texts]
        encoded = iter(self.model.encode([t for t, s in zip(texts, short, strict=True) if s], num_threads=1))
        return [len(next(encoded)) if s else self.count_long(t) for t, s in zip(texts, short, strict=True)]

    def count_long(self, text: str) -> int:
        text = text.replace(" ", SPACE)
        return sum(self.count_chunk(text, *piece) for piece in self.pieces(text))


@lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> ChunkedCounter:
    """One per Python worker."""
    return ChunkedCounter(path, chunk, overlap)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes long (UTF-8), n_tokens long.

    tokenizer: file of a sentencepiece model, present on every executor. chunk: characters of a chunk;
    longer texts are spliced. Counts equal the library's over the whole text. Null texts count as
    empty, with 0 of both; repeated rows give repeated rows; an empty table gives none; other columns
    are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = counter(tokenizer, chunk, overlap).count(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    inputs = [F.col(doc_id), text_of(text), F.octet_length(text_of(text)).cast("long")]
    return over_batches(docs, inputs, work, f"doc_id {kind}, n_bytes long, n_tokens long")
