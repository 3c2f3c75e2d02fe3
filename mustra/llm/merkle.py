"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

Sections are divided by blank lines, paragraphs by line ends, and a paragraph's leaves are its sentences, long ones cut
behind words that their own hash picks, so that an edit moves few cuts. What is long and without white space, as in some
scripts, is cut where a hash of its last characters says so. A leaf's digest is of its text, every other
node's of its children's digests, so roots are equal exactly if texts are. The fingerprint writes the tree down::

    root|section:paragraph=leaf.length,leaf.length;paragraph=...|section:...

with the root's digest whole, the others' first ``SHORT`` hex digits, and lengths in characters. ``likeness`` of two
fingerprints is 1 for equal roots, else the share of characters in leaves that both have; ``differences`` walks down
differing branches to the paragraphs that were edited.

``neighbour_likeness`` gives every document the next one by descending id without an order in one task: ids are dealt to
ranges of about the same size, the first row of each range is copied to the range before, and each task reads its
sorted range as a stream. The text is shuffled once.

Defined results: null text is empty, its tree has no section; equal texts, so repeated rows too, have equal fingerprints;
of equal ids the smaller text comes first; null ids come last; a single document is its own next; an empty
table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mustra.llm.common import valid_text

SHORT = 8
#: Leaves of more characters are cut, behind about every eighth word.
LEAF_CHARS = 64
CUT_EVERY = 8
#: And at this length whatever the words.
LEAF_MOST = 256
#: Tokens of more than ``LEAF_CHARS`` characters are cut where a hash of four characters says so, behind ``PIECE_LEAST`` at the
#: least and behind about ``PIECE_CHARS`` more.
PIECE_LEAST, PIECE_CHARS = 16, 32
_SECTION = re.compile(r"\n[^\S\n]*\n\s*")
_STOP = ".!?。！？"
_SENTENCE = re.compile(rf"[^{_STOP}]*[{_STOP}]+\s*|[^{_STOP}]+\Z")
_TOKEN = re.compile(r"\S+\s*|\s+")
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


class Tree(NamedTuple):
    """A fingerprint and the characters of its leaves by short digest."""

    text: str
    root: str
    leaves: dict[str, int]
    size: int


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=32).digest()


def _pieces(token: str) -> Iterator[str]:
    """A token without white space in pieces of up to ``LEAF_MOST`` characters; an edit moves the cuts next to it only."""
    codes = np.frombuffer(token.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = sum(codes[i : len(codes) - 3 + i] * np.uint64(_FACTORS[i]) for i in range(4))
    start = 0
    for cut in (np.flatnonzero((mixed >> np.uint64(29)) % np.uint64(PIECE_CHARS) == 0) + 4).tolist():
        while cut - start > LEAF_MOST:
            yield token[start : start + LEAF_MOST]
            start += LEAF_MOST
        if cut - start >= PIECE_LEAST:
            yield token[start:cut]
            start = cut
    for at in range(start, len(token), LEAF_MOST):
        yield token[at : at + LEAF_MOST]


def _leaves(paragraph: str) -> Iterator[str]:
    for sentence in _SENTENCE.findall(paragraph):
        if len(sentence) <= LEAF_CHARS:
            yield sentence
            continue
        held, size = [], 0
        for token in _TOKEN.findall(sentence):
            if len(token) > LEAF_CHARS:
                for piece in _pieces(token):
                    yield "".join((*held, piece))
                    held, size = [], 0
                continue
            held.append(token)
            size += len(token)
            if size >= LEAF_MOST or not zlib.crc32(token.strip().encode("utf-8", "surrogatepass")) % CUT_EVERY:
                yield "".join(held)
                held, size = [], 0
        if held:
            yield "".join(held)


def _sections(text: str) -> Iterator[str]:
    """The sections, each with the blank lines behind it, so that together they are the text."""
    start = 0
    for gap in _SECTION.finditer(text):
        yield text[start : gap.end()]
        start = gap.end()
    if start < len(text):
        yield text[start:]


def fingerprint(text: str) -> Tree:
    sections, tops, chars = [], [], Counter()
    for section in _sections(text):
        paragraphs, nodes = [], []
        for paragraph in section.splitlines(keepends=True):
            names, below = [], []
            for leaf in _leaves(paragraph):
                digest = _digest(leaf.encode("utf-8", "surrogatepass"))
                name = digest.hex()[:SHORT]
                names.append(f"{name}.{len(leaf)}")
                chars[name] += len(leaf)
                below.append(digest)
            node = _digest(b"p" + b"".join(below))
            nodes.append(node)
            paragraphs.append(f"{node.hex()[:SHORT]}={','.join(names)}")
        top = _digest(b"s" + b"".join(nodes))
        tops.append(top)
        sections.append(f"{top.hex()[:SHORT]}:{';'.join(paragraphs)}")
    root = _digest(b"r" + b"".join(tops)).hex()
    return Tree("|".join([root, *sections]), root, dict(chars), len(text))


def parse(written: str) -> Tree:
    root, *sections = written.split("|")
    chars: Counter = Counter()
    for leaf in re.findall(r"([0-9a-f]+)\.(\d+)", written):
        chars[leaf[0]] += int(leaf[1])
    return Tree(written, root, dict(chars), sum(chars.values()))


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots; else twice the characters in common leaves over the characters of both."""
    if a.root == b.root:
        return 1.0
    few, many = (a.leaves, b.leaves) if len(a.leaves) <= len(b.leaves) else (b.leaves, a.leaves)
    common = sum(min(n, many[name]) for name, n in few.items() if name in many)
    return 2 * common / (a.size + b.size)


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of the second fingerprint's paragraphs that its differing branches lead to."""
    (root_a, *old), (root_b, *new) = a.split("|"), b.split("|")
    if root_a == root_b:
        return []
    known = set(old)
    paragraphs = {p for s in old for p in s.partition(":")[2].split(";")}
    return [(i, j) for i, s in enumerate(new) if s not in known for j, p in enumerate(s.partition(":")[2].split(";")) if p not in paragraphs]


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t).text for t in batch.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), valid_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _range_of(bounds: list[int], id_: Column) -> Column:
    """How many of the descending ``bounds`` are above the id, by two steps over lists of about their square root."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    number = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    coarse = F.size(F.filter(number([g[-1] for g in groups]), lambda b: b > id_))
    fine = F.size(F.filter(F.get(F.array(*map(number, groups)), coarse), lambda b: b > id_))
    return F.when(coarse >= len(groups), F.lit(len(bounds))).otherwise(coarse * step + fine)


def _ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows (id, text) with the range they belong to; a copy of each range's first rows, marked, in the one before."""
    spark = rows.sparkSession
    found = rows.agg(F.percentile_approx("id", [(i + 1) / ranges for i in range(ranges - 1)] or [1.0], 10_000).alias("b")).first().b or []
    bounds = sorted(set(found), reverse=True) if ranges > 1 else []
    range_ = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(_range_of(bounds, F.col("id")))
    first = sorted(rows.select(range_.alias("range"), "id").groupBy("range").agg(F.max("id").alias("id")).collect())
    guards = spark.createDataFrame([(r.id, first[i - 1].range) for i, r in enumerate(first)], "guard_id long, before int")
    marked = rows.withColumn("range", range_).join(F.broadcast(guards), F.col("id").eqNullSafe(F.col("guard_id")), "left")
    places = F.array_compact(F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guard")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("at"), F.lit(True).alias("guard")))))
    dealt = marked.withColumn("place", F.explode(places)).select("id", "text", "place.at", "place.guard")
    return dealt.repartitionById(len(bounds) + 2, F.col("at").cast("int")).sortWithinPartitions("at", "guard", F.desc_nulls_last("id"), "text")


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row of ``docs``, its fingerprint against that of its edited text and of the next document.

    ``id_col`` holds integers, else it's an error. ``ranges``: how many tasks share the order, Spark's number of shuffle partitions if not given.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is no integer")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(id_, text: str, tree: Tree, next_text: str, next_tree: Tree) -> tuple:
        changed = edited(text, next_text)
        other = fingerprint(changed)
        return id_, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), tree.text, other.text, likeness(tree, other), likeness(tree, next_tree)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, rows, size = None, None, [], 0
        for batch in batches:
            for id_, text, range_, guard in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if range_ != at:
                    at, waiting = range_, None
                elif guard and waiting is None:
                    continue  # the range has its next document already
                tree = fingerprint(text)
                if waiting is not None:
                    rows.append(row(*waiting, text, tree))
                    size += len(text)
                waiting = None if guard else (id_, text, tree)
                if size > 1 << 22:
                    yield out(rows)
                    rows, size = [], 0
        yield out(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), valid_text(text_col).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _ranges(rows, ranges).mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
