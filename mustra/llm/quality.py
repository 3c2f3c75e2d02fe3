"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text is described by ``FEATURES``: shares of character classes, word, repetition and line statistics, none of them
bound to a language. The trees are grown on quantile bins of a bounded sample of labelled rows, on the driver, with
logistic loss, and flattened into arrays of complete binary trees, which numpy walks for all rows and trees at once.

``sample_rows`` bounds the sample: labelled rows whose crc32(id as text) mod 5 isn't 0, in the order of a seeded hash of
the id, so reruns agree. Scoring covers every row and the whole text; the words of a text beyond
``WINDOW_CHARS`` are counted window by window in one counter, so that only its distinct words are held at once.

Defined results: a null text is empty and gets the score that the trees give to all-zero statistics; labels that aren't
0 or 1 or whose id is null don't count, of several labels of an id the highest counts; without labels of both
kinds the score is the smoothed share of label 1 (0.5 without any label); rows repeated in full get equal
scores; a null id counts as held out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mustra.llm.common import fresh, valid_text

SAMPLE_ROWS = 20_000
SEED = 11
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
LEAST_HESSIAN = 2.0
RIDGE = 1.0
CUTOFF = 0.3
HELD_OUT_OF = 5
WINDOW_CHARS = 1 << 20
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "stop_comma", "exclamation", "bar", "symbol", "bracket", "other_punctuation",
    "space", "non_ascii", "distinct_words", "repeated_next", "commonest_word", "short_words", "capital_words", "log_lines", "line_length", "distinct_lines",
)
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop_comma": b".,", "exclamation": b"!?", "bar": b"|", "symbol": b"#$%&*@^~+=", "bracket": b"()[]{}<>", "other_punctuation": b"-_:;'\"/\\`", "space": b" \t\n\r\x0b\x0c"}


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(_CLASSES) + 1))
    for i, chars in enumerate(_CLASSES.values()):
        out[list(chars), i] = 1
    out[128:, -1] = 1
    return out


_MATRIX = _class_matrix()


def _windows(text: str) -> Iterator[str]:
    """The text in pieces of about WINDOW_CHARS that don't cut a word."""
    start, space = 0, re.compile(r"\s")
    while start < len(text):
        gap = space.search(text, start + WINDOW_CHARS)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def _word_statistics(text: str) -> tuple[int, np.ndarray]:
    """Words, and the sums over them of the word statistics."""
    counts, repeated, last = Counter(), 0, None
    for window in _windows(text):
        words = window.split()
        if words:
            counts.update(words)
            repeated += (words[0] == last) + sum(map(operator.eq, words, words[1:]))
            last = words[-1]
    if not counts:
        return 0, np.zeros(6)
    short = sum(n for w, n in counts.items() if len(w) < 4)
    capital = sum(n for w, n in counts.items() if w[0].isupper())
    return counts.total(), np.array([sum(len(w) * n for w, n in counts.items()), len(counts), repeated, max(counts.values()), short, capital], float)


def describe(text: str) -> np.ndarray:
    """The statistics of one text, in the order of FEATURES."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    classes = (np.bincount(data, minlength=256) @ _MATRIX) / max(1, len(data))
    n, sums = _word_statistics(text)
    word = sums / max(1, n)
    lines = text.count("\n") + 1 if text else 0
    distinct = len(set(map(hash, text.split("\n")))) / lines if lines else 0.0
    return np.concatenate([[math.log1p(len(text)), math.log1p(n), word[0]], classes, word[1:], [math.log1p(lines), len(text) / max(1, lines), distinct]])


class Trees(NamedTuple):
    """Complete binary trees in arrays (tree, node); inner nodes in breadth-first order, leaves by their number."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature) or not len(x):
            return np.full(len(x), 1 / (1 + math.exp(-self.base)))
        at = np.zeros((len(x), len(self.feature)), np.int64)
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        for _ in range(int(math.log2(self.leaf.shape[1]))):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        raw = self.base + self.leaf[trees, at - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0 and 1, from histograms of gradients over quantile bins."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(share / (1 - share))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if len(np.unique(y)) < 2:
        return Trees(feature[:0], cut[:0], leaf[:0], base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: edges[b - 1] < x <= edges[b]
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = node * bins + binned[:, j]
                g, h = (np.bincount(key, w, wide * bins).reshape(wide, bins).cumsum(1) for w in (gradient, hessian))
                total_g, total_h = g[:, -1:], h[:, -1:]
                g, h = g[:, : len(e)], h[:, : len(e)]
                value = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                value[(h < LEAST_HESSIAN) | (total_h - h < LEAST_HESSIAN)] = -1
                at = value.argmax(1)
                gain = value[np.arange(wide), at]
                for k in np.flatnonzero(gain > best):
                    best[k], feature[t, first + k], cut[t, first + k] = gain[k], j, e[at[k]]
            heap = first + node
            node = 2 * node + (x[np.arange(len(y)), feature[t, heap]] > cut[t, heap])
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, hessian, leaves)
        leaf[t] = -rate * g / (h + RIDGE)
        raw += leaf[t][node]
    return Trees(feature, cut, leaf, base)


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _describe_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: describe(t or ""))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = SEED, **growth) -> Trees:
    """Trees from at most ``sample_rows`` labelled documents that aren't held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    sample = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows)
    chosen = docs.select(F.col(id_col).alias("id"), valid_text(text_col).alias("text")).join(F.broadcast(sample), "id")
    described = chosen.select("id", "label", _describe_all("text").alias("x")).groupBy("id", "label").agg(F.min("x").alias("x"))
    rows = described.toPandas().sort_values("id")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return grow(x, rows["label"].to_numpy(float), **growth)


def score(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher where label 1 is likelier."""

    @F.pandas_udf("double")
    def score_all(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(trees.score(np.stack([describe(t or "") for t in texts])))

    return docs.withColumn(score_col, score_all(valid_text(text_col)))


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score ``cutoff`` or more, with the same columns."""
    name = fresh(docs, "score")
    return score(docs, trees, text_col, name).filter(F.col(name) >= cutoff).drop(name)
