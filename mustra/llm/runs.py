"""Periodic runs of words on a harmonic grid.

A run is a stretch of words with smallest period ``q`` that is ``least_exponent`` periods and ``least_length`` words long and that no
neighbour extends. For each period ``p`` every run of two periods holds two neighbouring points ``jp`` and ``(j + 1)p`` of the grid;
how far the words agree from these two points on (forward LCE) and up to them (backward LCE) gives the stretch with period ``p`` around them. Both come
from a suffix array of the words and one of the reversed words: a common extension is the least entry between two ranks of the array
of neighbours' common prefixes, found by a range-minimum structure of blocks. A text of n words has n ln n points, of which only those with equal
words are asked. A stretch with period ``p`` whose smallest period is another is found with that one too, so the least period of
each stretch is kept.

Suffixes are sorted by doubling, and only those that still tie are sorted again. Their common prefixes come with the sort: where
``h`` words tie and ``2h`` don't, they are ``h`` and what the known ones say of the rest. A word of a run occurs at least
``least_exponent`` times in its text, so texts are first cut at words that don't, which loses nothing; the rests of many texts are
worked on as one array in which each text's words and each end are symbols of their own. Numpy does the rest.

Scale. A text is a row by itself: no shuffle, no state. A task works on arrays of about ``batch_words`` words, or on one text if
that is longer, at about 100 bytes a word.

Defined results: a null text has no words; a text without runs has an empty list of them and stays; ties need none, as runs differ in
start or period; rows that repeat give the same row each; only id and text are read, so other columns may have any name; an empty table
gives no rows; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mustra.llm.common import valid_text

LEAST_EXPONENT = 4
LEAST_LENGTH = 6
BATCH_WORDS = 1 << 18
#: Grid points that are looked at together.
GRID_POINTS = 1 << 20
_WIDTH = 16
_OPEN = np.iinfo(np.int32).max
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

#: Words of a text, changed according to its id before runs are looked for.
Change = Callable[[int | None, list[bytes]], list[bytes]]


class RangeMinimum:
    """Minima of ranges: prefixes and suffixes of blocks, and a table over whole blocks by powers of two."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // _WIDTH)
        self.values = np.full(blocks * _WIDTH, _OPEN, np.int32)
        self.values[: len(values)] = values
        rows = self.values.reshape(blocks, _WIDTH)
        self.head = np.minimum.accumulate(rows, 1).ravel()
        self.tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        table = [rows.min(1)]
        while 2 << (len(table) - 1) <= blocks:
            half, last = 1 << (len(table) - 1), table[-1]
            grown = last.copy()
            np.minimum(last[:-half], last[half:], out=grown[:-half])
            table.append(grown)
        self.table = np.stack(table)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value of each range, both ends included."""
        a, b = first // _WIDTH, last // _WIDTH
        out = np.minimum(self.tail[first], self.head[last])
        far = np.flatnonzero(b - a > 1)
        if len(far):
            left, right = a[far] + 1, b[far] - 1
            level = np.frexp(right - left + 1)[1] - 1
            inner = np.minimum(self.table[level, left], self.table[level, right + 1 - (1 << level)])
            out[far] = np.minimum(out[far], inner)
        same = np.flatnonzero(a == b)
        if len(same):
            left, right = first[same], last[same]
            least = self.values[left]
            for step in range(1, _WIDTH):
                least = np.minimum(least, self.values[np.minimum(left + step, right)])
            out[same] = least
        return out


class Suffixes:
    """Ranks of the suffixes of ``text`` and common extensions of two of them; the last symbol of ``text`` and those that end
    its parts occur once, so no comparison leaves a part."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = np.argsort(text, kind="stable")
        first = np.ones(n, bool)
        first[1:] = text[order[1:]] != text[order[:-1]]
        shared = np.where(first, 0, _OPEN).astype(np.int32)
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = group
        h = 1
        while True:
            alone = first.copy()
            alone[:-1] &= first[1:]
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            known, at = RangeMinimum(shared), order[tied]
            then = self.rank[at + h]
            by = np.lexsort((then, group[tied]))
            at, then = at[by], then[by]
            order[tied] = at
            apart = np.flatnonzero(~first[tied][1:] & (then[1:] != then[:-1])) + 1
            cut = tied[apart]
            shared[cut] = h + known(then[apart - 1] + 1, then[apart])
            first[cut] = True
            group[tied] = np.maximum.accumulate(np.where(first[tied], tied, 0))
            self.rank[at] = group[tied]
            h *= 2
        self.least = RangeMinimum(shared)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols agree from different places ``a`` and ``b`` on."""
        x, y = self.rank[a], self.rank[b]
        return self.least(np.minimum(x, y) + 1, np.maximum(x, y))


def _grid(starts: np.ndarray, sizes: np.ndarray, least_exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points and their periods, each point p short of the next; about ``GRID_POINTS`` at once."""
    most = sizes // least_exponent
    part = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(part)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (sizes[part] - 1) // period
    upto = np.cumsum(points)
    at = 0
    while at < len(part):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GRID_POINTS, "right")))
        n, p = points[at:end], period[at:end]
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(p, n)
        yield np.repeat(starts[part[at:end]], n) + j * p, p
        at = end


def runs_of(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> np.ndarray:
    """start, length, period of the runs of the parts of ``text``, by start and period; symbols of ``text`` between parts and at
    its end occur once."""
    n = len(text)
    forward, backward = Suffixes(text), Suffixes(np.append(text[-2::-1], text[-1]))
    found = [np.zeros((0, 3), np.int64)]
    for point, period in _grid(starts, sizes, least_exponent):
        same = text[point] == text[point + period]
        point, period = point[same], period[same]
        if not len(point):
            continue
        on = forward.extension(point, point + period).astype(np.int64)
        back = backward.extension(n - 2 - point, n - 2 - point - period).astype(np.int64) - 1
        length = back + period + on
        long = length >= np.maximum(least_length, least_exponent * period)
        found.append(np.unique(np.stack([point - back, length, period], 1)[long], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    if len(runs):  # by start, length and period: the least period of a stretch comes first
        runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


class _Gathered:
    """Texts whose runs are looked for together."""

    def __init__(self, least_exponent: int, least_length: int):
        self.least_exponent, self.least_length = least_exponent, least_length
        self.often = re.compile(rb"\x01{%d,}" % least_length)
        self.words: list[list[bytes]] = []
        self.symbols: list[np.ndarray] = []
        #: text, first word and size of each part
        self.parts: list[tuple[int, int, int]] = []
        self.n_symbols, self.n_words, self.size = 0, 0, 0

    def add(self, words: list[bytes]) -> None:
        often = {w: i for i, (w, n) in enumerate(Counter(words).items()) if n >= self.least_exponent}
        for hit in self.often.finditer(bytes(map(often.__contains__, words))) if often else ():
            part = np.fromiter(map(often.__getitem__, words[hit.start() : hit.end()]), np.int64, hit.end() - hit.start())
            self.symbols.append(part + self.n_symbols)
            self.parts.append((len(self.words), hit.start(), len(part)))
            self.size += len(part)
        self.n_symbols += len(words)
        self.n_words += len(words)
        self.words.append(words)

    def runs(self) -> list[list[tuple[int, int, int]]]:
        """Of each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.words]
        if self.parts:
            owner, offset, sizes = np.array(self.parts).T
            ends = np.arange(len(sizes))[:, None] + self.n_symbols
            text = np.concatenate([x for part, end in zip(self.symbols, ends, strict=True) for x in (part, end)])
            starts = np.cumsum(sizes + 1) - sizes - 1
            found = runs_of(text, starts, sizes, self.least_exponent, self.least_length)
            part = np.searchsorted(starts, found[:, 0], "right") - 1
            for i, start, length, period in zip(owner[part].tolist(), (found[:, 0] - starts[part] + offset[part]).tolist(), found[:, 1].tolist(), found[:, 2].tolist(), strict=True):
                out[i].append((start, length, period))
        return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: all but those behind a run's first period."""
    if not runs:
        return b" ".join(words)
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\x01" * (length - period)
    return b" ".join(w for w, g in zip(words, gone, strict=True) if not g)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH, change: Change | None = None, batch_words: int = BATCH_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``runs`` (start, length and period in words, by start and period), and the
    ``collapsed`` text: its words joined by blanks, of each run only the first period."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held = 0, _Gathered(least_exponent, least_length)
            texts = batch.column(1).cast(pa.binary())
            for i, text in enumerate(texts, 1):
                words = text.as_py().split()
                held.add(words if change is None else change(batch.column(0)[i - 1].as_py(), words))
                if held.size >= batch_words or held.n_words >= 4 * batch_words or i == batch.num_rows:
                    found = held.runs()
                    short = pa.array([collapsed(w, r) for w, r in zip(held.words, found, strict=True)], pa.binary()).cast(pa.string())
                    dicts = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], _RUN)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i - start), pa.array(map(len, held.words), pa.int64()), dicts, short], names=["id", "n_words", "runs", "collapsed"])
                    start, held = i, _Gathered(least_exponent, least_length)

    read = docs.select(F.col(id_col).alias("id"), valid_text(text_col).alias("text"))
    return read.mapInArrow(run, f"id {id_type.simpleString()}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").withColumnRenamed("id", id_col)


def digest_runs(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, ``n_runs``, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    out = found.withColumns({"best": best, "runs_sha256": F.sha2(lines, 256), "collapsed_sha256": F.sha2("collapsed", 256), "n_runs": F.size("runs").cast("long")})
    longest = {"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period"), "exponent_milli": F.expr("1000 * best.length DIV -best.period")}
    return out.select(id_col, "n_runs", *(c.alias(name) for name, c in longest.items()), "runs_sha256", "collapsed_sha256")
