"""Fill-in-the-middle transformation by a streaming matcher that passes over a text twice.

Units are runs of other characters with the ASCII white space before them, and white space at the end. The first pass counts
them; the second advances a lazy iterator over the matches to the first rank, then on to the second. No pass keeps a unit, so besides the text and
its transform the memory is constant, however long the text is.

Draws come from the SHA-256 of seed and id, so reruns and retries agree and rows need nothing of each other: there is
no shuffle and no state, and a task writes its rows in batches of about ``batch_bytes``.

Markers don't overlap themselves or each other at any offset, and texts that contain one stay as they are; so a marker that is
found in a transform was put there, and ``restored`` cuts it at its markers to give the exact text again.

Defined results: a null text is empty; an empty one and one with a marker are ``plain``; a null id draws as an empty one would;
rows that repeat give the same row each; only the id and the text are read, so other columns may have any name; an empty table gives
no rows; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mustra.llm.common import valid_text

SEED = 42
#: Percent of texts that are transformed, and of these in the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
BATCH_BYTES = 1 << 22
#: Quantifiers don't give back: the two classes share no character, so nothing else could match.
_UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


class Transformed(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits."""
    h = sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def count_units(text: str) -> int:
    return sum(1 for _ in _UNIT.finditer(text))


def ends(text: str, ranks: Sequence[int]) -> list[int]:
    """Where the first ``r`` units end for each of the ascending ``ranks``, as a number of characters."""
    units, done, at, out = _UNIT.finditer(text), 0, 0, []
    for rank in ranks:
        if rank > done:
            at, done = next(islice(units, rank - done - 1, None)).end(), rank
        out.append(at)
    return out


def transform(text: str, key: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Transformed:
    n = count_units(text)
    one, two, form, order = draws(seed, key)
    if form % 100 >= rate or not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return Transformed(n, PLAIN, None, None, text)
    a, b = ends(text, sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm_rate:
        return Transformed(n, SPM, a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    return Transformed(n, PSM, a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))


def transform_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain) and ``output``."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, rows = 0, 0, []
            for i, (key, text) in enumerate(zip(batch.column(1), batch.column(2), strict=True), 1):
                rows.append(transform(text.as_py(), key.as_py(), seed, rate, spm_rate))
                size += len(rows[-1].output)
                if size >= batch_bytes or i == batch.num_rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i - start), *columns], names=["id", *Transformed._fields])
                    start, size, rows = i, 0, []

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), key.alias("key"), valid_text(text_col).alias("text"))
    return read.mapInArrow(run, f"id {id_type.simpleString()}, {_FIELDS}").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that a transform was made of."""
    at = lambda marker: F.instr(output, marker)
    between = lambda first, last: F.substring(output, at(first) + 3, at(last) - at(first) - 3)
    middle = F.substring(output, at(MIDDLE) + 3, F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
