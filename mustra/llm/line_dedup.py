"""Line dedup by a log-template tree, with DataFrame functions only.

Parsing. A line's tokens are its words, one with a digit being a variable field. The tree has fixed depth: number of
tokens, then the ``LEADING`` first tokens; the rest is cut into at most ``FIELDS`` runs of tokens. As all lines of a
leaf have equally many tokens, their fields align; the leaf's most frequent line is a template, and lines that agree with
it in ``AGREEMENT`` of the fields belong to it, their other fields being its variable ones. Of the lines that don't
agree the most frequent one is the next template, until no line is left; a line that agrees with several templates
belongs to the first of them.

Recurrence. A template recurs across documents if texts of ``min_docs`` different groups of copies hold it. Texts are
copies if most of their lines agree in how they begin, how they end and how long they are; what recurs doesn't make
unrelated texts copies as long as most of what they hold is their own. So copies count once however many they are and
aren't taken for boilerplate (whole copies are the near-duplicate operator's task), and neither copies nor frequency save
a line that recurs in enough other documents. All occurrences of a recurring template are dropped.

Copies. The first and last ``ENDS`` tokens and the leaf of each line of a text are sketched by ``BANDS`` bands of
``BAND_ROWS`` hashes, each the nearest to a fixed point. A text is compared with the smallest text of each of its bands: of
texts with likeness J (of these features) a share of 1 - (1 - J^4)^16 shares a band (0.9999 at 0.82, 0.64 at 0.5). Where sketches
agree in a share of ``ALIKE`` the link is followed to its ends, so copies of copies are one group however many they are.
Where they agree in a share of ``RELATED`` it is followed one step, from a group to the smallest one it meets, so that texts
that hold much of the same boilerplate aren't chained into one group.

Scale. Lines are rows before they are parsed, so that parsing is compiled code; only hashes of lines are written and shuffled (text
key, position, leaf, fields, ends), and equal lines and the lines of a text are aggregated before the shuffle. The decision is a
list of line numbers per text key, a table of its own, joined to the texts at the end.

Defined results: a null text is empty and has no lines; lines of fewer than ``min_tokens`` tokens stay; line ends are
``\\n``; equal texts get equal results, repeated rows a row each; an empty table gives no rows; ties between a
leaf's lines fall to the larger hash of the line; other columns pass through ``clean``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mustra.llm.common import fresh, stage, text_or_empty
from mustra.llm.near_dedup import components

LEADING = 2
FIELDS = 8
AGREEMENT = 0.7
MIN_DOCS = 3
MIN_TOKENS = LEADING + 1
ENDS = 3
BANDS = 16
BAND_ROWS = 4
#: 0.999 of the pairs of likeness 0.8 agree in so much, 0.01 of those of 0.5.
ALIKE = 0.65
#: 0.95 of the pairs of likeness 0.5 do, 0.0002 of those of 0.2.
RELATED = 0.4
#: Lines with a digit or white space other than blanks (and those with blanks that don't stand alone between tokens). Single characters
#: are looked up at once, a range isn't.
_REWRITTEN = r"[0123456789\t\r\f\x0B]"


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def parse_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line: key (of its text), at (position from 0), tokens (how many), leaf, fields (hashes), head and tail."""
    text = text_or_empty(text_col)
    # the key before the lines, else it is computed for each of them
    rows = docs.select(text_key(text).alias("key"), text.alias("text")).select("key", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    # few lines need their white space and variable fields rewritten; the rest is never split into words
    plain = F.array_join(F.transform(F.array_remove(F.split("line", r"\s+"), ""), lambda w: F.when(w.rlike("[0-9]"), "<*>").otherwise(w)), " ")
    line = F.col("line")
    odd = line.rlike(_REWRITTEN) | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    rows = rows.select("key", "at", F.when(odd, plain).otherwise(F.col("line")).alias("line"))
    rows = rows.select("key", "at", "line", F.when(F.col("line") == "", 0).otherwise(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("tokens"))
    n, line, rest = F.col("tokens"), F.col("line"), F.col("rest")
    rows = rows.select("key", "at", "line", "tokens", F.greatest(n - LEADING, F.lit(0)).alias("rest"))
    part = lambda text, count: F.call_function("substring_index", text, F.lit(" "), count)
    # field j holds the tokens from cut j to cut j + 1 behind the leading ones; halves are halved, so a line is walked three times
    # whatever FIELDS is, by compiled code (a function over an array of cuts is not)
    cut = lambda j: F.floor(j * rest / FIELDS).cast("int")
    spans, parts = [(0, FIELDS)], [line]
    while spans[0][1] > 1:
        halved = []
        for (i, j), of in zip(spans, parts, strict=True):
            mid = (i + j) // 2
            halved += [((i, mid), part(of, cut(mid) - cut(i) + (0 if i else LEADING))), ((mid, j), part(of, cut(mid) - cut(j)))]
        spans = [span for span, _ in halved]
        names = [f"part{i}" for i in range(len(halved))]
        rows = rows.select("key", "at", "line", "tokens", "rest", *(c.alias(as_) for (_, c), as_ in zip(halved, names, strict=True)))
        parts = [F.col(c) for c in names]
    parts[0] = part(parts[0], -cut(1))
    short = F.transform(F.slice(F.split("line", " "), LEADING + 1, rest), lambda w: F.hash(w))
    fields = F.when(rest >= FIELDS, F.array(*map(F.hash, parts))).when(rest > 0, short).otherwise(F.array().cast("array<int>"))
    return rows.select("key", "at", "tokens", F.xxhash64(n, part(line, F.lit(LEADING))).alias("leaf"), fields.alias("fields"), F.xxhash64(F.lit(0), part(line, F.lit(ENDS))).alias("head"), F.xxhash64(F.lit(1), part(line, F.lit(-ENDS))).alias("tail"))


def copy_groups(lines: DataFrame) -> DataFrame:
    """key, group of the texts that others are copies of or that are copies; the others are groups of their own, named by the key's hash."""
    # the feature next to a point by exclusive or; the points of a band lie in different quarters
    points = [random.Random(i).getrandbits(62) | (i % BAND_ROWS) << 62 for i in range(BANDS * BAND_ROWS)]
    least = lambda i: F.min(F.least(*(F.col(c).bitwiseXOR(F.lit(points[i] - (1 << 63))) for c in ("leaf", "head", "tail"))))
    sketch = lines.filter("tokens > 0").groupBy("key").agg(*(least(i).alias(f"h{i}") for i in range(BANDS * BAND_ROWS)))
    bands = F.array(*(F.xxhash64(F.lit(b), *(f"h{b * BAND_ROWS + i}" for i in range(BAND_ROWS))) for b in range(BANDS)))
    # seven bits of a value tell features apart well enough
    few = F.array(*((F.col(f"h{i}").bitwiseAND(F.lit(127))).cast("tinyint") for i in range(BANDS * BAND_ROWS)))
    sketches = stage(sketch.select("key", F.xxhash64("key").alias("mark"), bands.alias("bands"), few.alias("values")))
    bands = sketches.select("mark", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).filter("least < most")
    shared = stage(shared.select("band", "least"))
    links = stage(_links(bands.join(shared, "band").filter("mark <> least").select("mark", "least").distinct(), sketches))
    joined = components(stage(links.filter(F.col("agreed") >= ALIKE * BANDS * BAND_ROWS).select(F.col("mark").alias("a"), F.col("least").alias("b"))))
    of = lambda end, as_: joined.select(F.col("node").alias(end), F.col("comp").alias(as_))
    met = links.join(of("mark", "own"), "mark", "left").join(of("least", "other"), "least", "left")
    step = met.groupBy(F.coalesce("own", "mark").alias("own")).agg(F.min(F.coalesce("other", "least")).alias("other"))
    texts = sketches.select("key", "mark").join(of("mark", "own"), "mark", "left").select("key", "mark", F.coalesce("own", "mark").alias("own"))
    return texts.join(step, "own", "left").select("key", "mark", F.least("own", F.coalesce("other", "own")).alias("group")).filter("group <> mark").select("key", "group")


def _links(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The ``pairs`` (mark, least) whose sketches agree in a share of ``RELATED``, and in how many values they do."""
    of = lambda end: sketches.select(F.col("mark").alias(end), F.col("values").alias(f"of_{end}"))
    agreed = F.size(F.filter(F.zip_with("of_mark", "of_least", lambda x, y: x == y), lambda same: same))
    both = pairs.join(of("mark"), "mark").join(of("least"), "least").select("mark", "least", agreed.alias("agreed"))
    return both.filter(F.col("agreed") >= RELATED * BANDS * BAND_ROWS)


def _joined(fields: Column, sets: Callable[[int], list[Sequence[int]]], length: Column) -> Column:
    """Hashes of the fields at each of the sets of positions that ``sets`` gives for a number of fields."""
    out = F.array().cast("array<bigint>")
    for m in range(1, FIELDS + 1):
        if wanted := sets(m):
            out = F.when(length == m, F.array(*[F.xxhash64(F.lit(i), "leaf", *[F.get(fields, F.lit(j)) for j in at]) for i, at in enumerate(wanted)])).otherwise(out)
    return out


def templates(lines: DataFrame, min_docs: int = MIN_DOCS, agreement: float = AGREEMENT) -> DataFrame:
    """leaf, fields, template of the lines (of leaves of that many) that may recur ``min_docs`` times.

    In each leaf the most frequent line is a template, those that agree with it are matched, and so on with the rest until
    no line is left. Lines agree if they are equal outside of some ``spare`` fields, so they meet by hashes of the other
    fields. Every line that is more frequent than all unmatched lines it agrees with is a template at once.
    """
    spare = lambda m: m - math.ceil(agreement * m - 1e-9)
    parts = lambda m: [range(i * m // (spare(m) + 1), (i + 1) * m // (spare(m) + 1)) for i in range(spare(m) + 1)] if spare(m) else []
    masks = lambda m: list(combinations(range(m), m - spare(m))) if spare(m) else []
    shapes = lines.groupBy("leaf", "fields").agg(F.count("*").alias("n"))
    shapes = stage(shapes.withColumn("rank", F.struct("n", F.xxhash64("leaf", "fields").alias("id"))))
    size = F.size("fields")
    # lines that agree have one of spare + 1 parts in common; the others need no masks
    by_part = shapes.select("rank.id", F.explode(_joined(F.col("fields"), parts, size)).alias("part"))
    common = stage(by_part.groupBy("part").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("part"))
    some = by_part.join(common, "part").select("id").distinct()
    near = shapes.join(some, shapes["rank.id"] == some["id"], "left_semi").select("rank", F.explode(_joined(F.col("fields"), masks, size)).alias("mask"))
    near = stage(near)
    met = near.groupBy("mask").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most").select("mask")
    near = stage(near.join(met, "mask"))
    open_, first = near, None
    while not open_.isEmpty():
        best = open_.groupBy("mask").agg(F.max("rank").alias("best"))
        firsts = open_.join(best, "mask").groupBy("rank").agg(F.min(F.col("rank") == F.col("best")).alias("first")).filter("first").select("rank")
        taken = stage(open_.join(firsts, "rank").select("mask", F.col("rank").alias("first")))
        first = taken if first is None else first.unionByName(taken)
        matched = open_.join(taken.select("mask"), "mask").select("rank").distinct()
        open_ = stage(open_.join(matched, "rank", "left_anti"))
    own = F.col("rank.id").alias("template")
    if first is None:
        return shapes.filter(F.col("n") >= min_docs).select("leaf", "fields", own)
    found = near.join(first, "mask").groupBy("rank").agg(F.max("first").alias("first"))
    # a shape that is a template of its own recurs only if it is frequent enough by itself
    both = shapes.join(found, "rank", "left").filter(F.col("first").isNotNull() | (F.col("n") >= min_docs))
    return both.select("leaf", "fields", F.coalesce("first.id", "rank.id").alias("template"))


def recurring_lines(lines: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, agreement: float = AGREEMENT) -> DataFrame:
    """From ``parse_lines``: key and ``dropped``, the positions of its lines whose template recurs."""
    # blank lines are left out behind the stage: a filter before it is pushed to the texts and parses every line again, some parts four times
    lines = stage(lines)
    groups = copy_groups(lines)
    lines = lines.filter(F.col("tokens") >= max(min_tokens, 1)).select("key", "at", "leaf", "fields")
    # most leaves hold one line; only those of min_docs and more are looked into
    leaves = stage(lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"))
    lines = stage(lines.join(leaves, "leaf", "left_semi"))
    shapes = templates(lines, min_docs, agreement)
    held = stage(lines.join(shapes, ["leaf", "fields"]).select("key", "at", "template"))
    texts = held.select("template", "key").distinct()
    often = texts.groupBy("template").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_docs)
    grouped = texts.join(stage(often.select("template")), "template").join(groups, "key", "left")
    grouped = grouped.select("template", F.coalesce("group", F.xxhash64("key")).alias("group")).distinct()
    recurring = grouped.groupBy("template").agg(F.count("*").alias("groups")).filter(F.col("groups") >= min_docs)
    # a table of its own: its size is known when the join is planned, and a hot template's rows can be split
    recurring = stage(recurring.select("template"))
    return held.join(recurring, "template", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("dropped"))


def _without(text: Column, dropped: Column) -> Column:
    """``text`` without the lines at the sorted positions ``dropped``: the runs of lines between them, in one walk."""

    def rest(v: Column) -> Column:
        ends = F.concat(v.dropped, F.array(F.size(v.lines)))
        run = lambda end, i: F.slice(v.lines, F.when(i == 0, F.lit(0)).otherwise(F.get(v.dropped, i - 1) + 1) + 1, end - F.when(i == 0, F.lit(0)).otherwise(F.get(v.dropped, i - 1) + 1))
        return F.array_join(F.flatten(F.transform(ends, run)), "\n")

    # a list of one binds the lines, which would be split anew for every run otherwise
    return F.get(F.transform(F.array(F.struct(_lines(text).alias("lines"), dropped.alias("dropped"))), rest), F.lit(0))


def clean(docs: DataFrame, text_col: str = "text", counts: bool = False, **options) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of the text.

    ``counts`` adds n_lines and n_dropped, in place of columns of these names.
    """
    # a table of its own, so that the texts of a hot key can be split
    dropped = stage(recurring_lines(parse_lines(docs, text_col), **options))
    key, gone = fresh(docs, "text_key"), fresh(docs, "dropped_lines")
    joined = docs.withColumn(key, text_key(text_or_empty(text_col))).join(dropped.select(F.col("key").alias(key), F.col("dropped").alias(gone)), key, "left")
    text = text_or_empty(text_col)
    rest = _without(text, F.col(gone))
    kept = [c for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    columns = [F.when(F.col(gone).isNull(), F.col(c)).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in kept]
    if counts:
        columns += [F.when(text == "", 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*columns)


def drop_emptied(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """``clean`` without the documents of which nothing is left, and with the count of characters brought up to date."""
    mark = fresh(docs, "was_blank")
    rows = clean(docs.withColumn(mark, F.trim(text_or_empty(text_col)) == ""), text_col, **options)
    rows = rows.filter(F.col(mark) | (F.trim(text_or_empty(text_col)) != "")).drop(mark)
    if chars_col in docs.columns:
        rows = rows.withColumn(chars_col, F.length(text_or_empty(text_col)).cast(docs.schema[chars_col].dataType))
    return rows.select(*docs.columns)
