"""Token counts: batch encoding inside Arrow functions that return lengths only.

A text is cut at ASCII white space, a safe boundary of the word tokenizer: its normaliser is local to the
characters between two white spaces, its pre-tokenizer drops white space and no match spans it. Long texts are
walked in windows of about ``window_bytes``, each ending at such a boundary or, as some scripts have no white space, between a
letter and a punctuation mark (no match holds both, and the mark doesn't compose with what is before it). The pieces not
yet counted are gathered into batches of about ``batch_bytes`` and each distinct piece is encoded once per batch. Lengths of
short pieces are remembered, up to ``memo_entries`` of them (about 150 bytes each, 40 MB a worker); the memory of a task is
thus bounded by those three and by the longest piece without any boundary.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; columns besides
the two that are named are not read, so clashing names don't matter; an empty table gives no rows; bytes that are
not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mustra.llm.common import text_or_empty

WINDOW_BYTES = 1 << 20
BATCH_BYTES = 1 << 18
MEMO_ENTRIES = 1 << 18
MEMO_PIECE_BYTES = 48
TOKEN_LIMIT = 2048
#: ASCII letters, ideographs U+5000 to U+8FFF and syllables U+B000 to U+CFFF, in UTF-8.
_LETTER = rb"(?:(?<=[A-Za-z])|(?<=[\xe5-\xe8][\x80-\xbf][\x80-\xbf])|(?<=[\xeb\xec][\x80-\xbf][\x80-\xbf]))"
#: . , ; : ! ? and the wide 、 。 ！ ， ： ； ？
_MARK = rb"(?:[.,;:!?]|\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9a\x9b\x9f])"
_BOUNDARY = re.compile(rb"[ \t\n\r\x0b\x0c]|" + _LETTER + rb"(?=" + _MARK + rb")")
_STOPS = (b".", b",")
#: One counter for each tokenizer and worker process: what one task has learned, the next need not encode again.
_COUNTERS: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts the tokens of UTF-8 texts with one loaded tokenizer."""

    def __init__(self, tokenizer, window_bytes: int = WINDOW_BYTES, batch_bytes: int = BATCH_BYTES, memo_entries: int = MEMO_ENTRIES):
        self.tokenizer, self.window_bytes, self.batch_bytes, self.memo_entries = tokenizer, window_bytes, batch_bytes, memo_entries
        self.memo: dict[bytes, int] = {}

    def _windows(self, text: bytes) -> Iterator[bytes]:
        start = 0
        while len(text) - start > self.window_bytes:
            hit = _BOUNDARY.search(text, start + self.window_bytes)
            if hit is None:
                break
            yield text[start : hit.start()]
            start = hit.start()
        yield text[start:] if start else text

    def _encode(self, pieces: list[bytes]) -> list[int]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], known: dict[bytes, int]) -> None:
        """Adds the lengths of ``pieces`` to ``known``, in batches of about the same number of bytes."""
        batch, size = [], 0
        for piece in pieces:
            batch.append(piece)
            size += len(piece)
            if size >= self.batch_bytes:
                known.update(zip(batch, self._encode(batch), strict=True))
                batch, size = [], 0
        if batch:
            known.update(zip(batch, self._encode(batch), strict=True))

    def _learn_short(self, pieces: set[bytes], known: dict[bytes, int]) -> None:
        """Also cuts a last full stop or comma off after an ASCII letter: no match of the tokenizer spans that place."""
        stems, ended = set(), []
        for piece in pieces:
            if piece[-1:] in _STOPS and piece[-2:-1].isalpha():
                ended.append(piece)
                stems.add(piece[:-1])
                stems.add(piece[-1:])
            else:
                stems.add(piece)
        self._learn(sorted(p for p in stems if p not in known), known)
        for piece in ended:
            known[piece] = known[piece[:-1]] + known[piece[-1:]]

    def count_all(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text; the new pieces of a run of texts share their batches."""
        totals, waiting, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for window in self._windows(text):
                waiting.append((i, window.split()))
                size += len(window)
                if size >= self.window_bytes:
                    self._settle(waiting, totals)
                    waiting, size = [], 0
        self._settle(waiting, totals)
        return totals

    def _settle(self, waiting: list[tuple[int, list[bytes]]], totals: list[int]) -> None:
        if len(self.memo) > self.memo_entries:
            self.memo.clear()
        memo = self.memo
        new = {p for _, pieces in waiting for p in pieces if p not in memo}
        long = {p for p in new if len(p) > MEMO_PIECE_BYTES}
        self._learn_short(new - long, memo)
        once: dict[bytes, int] = {}
        self._learn(sorted(long), once)
        for i, pieces in waiting:
            if once and not once.keys().isdisjoint(pieces):
                totals[i] += sum(once[p] if p in once else memo[p] for p in pieces)
            else:
                totals[i] += sum(map(memo.__getitem__, pieces))


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _COUNTERS[path] = PieceCounter(Tokenizer.from_file(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens`` and whether that is over ``limit``.

    ``tokenizer_path``: a ``.json`` file of the ``tokenizers`` library, whose words do not span white space.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counter.count_all(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {id_type.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
