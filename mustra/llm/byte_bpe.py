"""Byte-level BPE by monoid tree reduction.

A text's encoding is a reduction over its halves. A leaf of at most ``leaf_chars`` characters is encoded as it is; two
neighbours are joined by encoding again only a window around their seam. The window grows, doubling, until both of its
ends are *settled cuts*: places where the split pattern has a match boundary whatever surrounds them. As the
matches are encoded each for itself, tokens outside the window can't depend on what is on the seam's other side, so
they are kept and the window's tokens replace those between. A node's own ends are the last resort.

Settled cuts (none of the split pattern's alternatives has the two characters side by side in one match):
white space after anything else; an ASCII letter beside an ASCII digit; sentence punctuation after a letter.

Decoding concatenates the bytes of both halves up a tree of the same kind.

A window without any cut is encoded whole, however long. The library's matcher fails on runs of about a million white spaces; where
there is one of ``SPACE_RUN`` or more, another matcher gives it the same pieces.

Defined results: a null text is empty (no tokens, empty bytes); special strings are ordinary text; repeated rows
give a row each; columns that aren't named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mustra.llm.common import valid_text

LEAF_CHARS = 16384
WINDOW_CHARS = 64
PART_ROWS = 256
SPACE_RUN = 500_000
_SPACE_RUN = re.compile(rf"\s{{{SPACE_RUN}}}")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿぁ-ゖァ-ヺ一-龥가-힣"
_CUT = re.compile(rf"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[{_LETTER}])(?=[.,;:!?。、，！？])")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeBpe:
    """Encodes and decodes by reduction over halves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        import tiktoken

        self.flat = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.leaf_chars, self.window_chars = pattern, max(1, leaf_chars), max(1, window_chars)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length_of = [len(b) for b in self.bytes_of]
        self.name_of = [str(i) for i in range(len(self.bytes_of))]

    def _encode_flat(self, text: str) -> list[int]:
        if len(text) < SPACE_RUN or not _SPACE_RUN.search(text):
            return self.flat.encode_ordinary(text)
        import regex

        return [i for piece in regex.finditer(self.pattern, text) for i in self.flat._encode_single_piece(piece[0])]

    def _window(self, text: str, low: int, middle: int, high: int) -> tuple[int, int]:
        """The smallest window tried around the seam whose two ends are settled cuts (or the node's ends)."""
        width, start, end = self.window_chars, None, None
        while start is None or end is None:
            if start is None:
                floor = max(low, middle - width)
                # both characters of a cut must be on the seam's left
                hits = [m.start() for m in _CUT.finditer(text, floor + 1, middle)] if middle - floor > 1 else []
                hits = [p for p in hits if p < middle]
                start = hits[-1] if hits else low if floor == low else None
            if end is None:
                ceiling = min(high, middle + width)
                hit = _CUT.search(text, middle + 1, ceiling) if ceiling - middle > 1 else None
                end = hit.start() if hit and hit.start() < ceiling else high if ceiling == high else None
            width *= 2
        return start, end

    def _join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        start, end = self._window(text, low, middle, high)
        length_of = self.length_of
        keep, spare = len(left), len(text[start:middle].encode())
        while spare > 0:
            keep -= 1
            spare -= length_of[left[keep]]
        skip, ahead = 0, len(text[middle:end].encode())
        while ahead > 0:
            ahead -= length_of[right[skip]]
            skip += 1
        if spare or ahead:
            raise AssertionError("a settled cut lies inside a token")
        return left[:keep] + self._encode_flat(text[start:end]) + right[skip:]

    def _node(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf_chars:
            return self._encode_flat(text[low:high])
        middle = (low + high) // 2
        return self._join(text, low, middle, high, self._node(text, low, middle), self._node(text, middle, high))

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``, halves concatenated up the tree."""
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])

    def name(self, ids: list[int]) -> str:
        return ",".join(map(self.name_of.__getitem__, ids))


#: One coder for each vocabulary and worker process.
_CODERS: dict[tuple[str, str], TreeBpe] = {}


def _coder(ranks_path: str, pattern: str) -> TreeBpe:
    if (ranks_path, pattern) not in _CODERS:
        _CODERS[ranks_path, pattern] = TreeBpe(load_ranks(ranks_path), pattern)
    return _CODERS[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids_col`` of token ids (array of int)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode_all(texts: pd.Series) -> pd.Series:
        coder = _coder(ranks_path, pattern)
        return texts.map(lambda t: np.array(coder.encode(t), np.int32))

    return docs.withColumn(ids_col, encode_all(valid_text(text_col)))


def decode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` replaced by what ``ids_col`` decodes to; null ids are an empty text."""

    @F.pandas_udf(T.StringType())
    def decode_all(ids: pd.Series) -> pd.Series:
        coder = _coder(ranks_path, pattern)
        return ids.map(lambda x: coder.decode([] if x is None else x.tolist()).decode("utf-8", "replace"))

    return docs.withColumn(text_col, decode_all(ids_col))


def recode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", rows: int = PART_ROWS) -> DataFrame:
    """``docs`` with a column ``ids_col`` of token ids behind the others, and ``text_col`` replaced by what they decode to; each
    text is encoded once, and ``rows`` of them are held at a time."""
    place = docs.columns.index(text_col)
    given = docs.withColumn(text_col, valid_text(text_col))
    schema = T.StructType([*given.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids, texts = [], []
                for text in part.column(place):
                    ids.append(np.array(coder.encode(text.as_py()), np.int32))
                    texts.append(coder.decode(ids[-1].tolist()).decode("utf-8", "replace"))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=schema.names)

    return given.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the number of tokens, a digest of the ids, and a digest of what the ids decode to."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(coder.name(ids).encode()).hexdigest())
                text_digests.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), valid_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
