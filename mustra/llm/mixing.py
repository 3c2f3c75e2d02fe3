"""Mixing sources to target weights by subset-sum budget fitting.

Targets. The sources, in the order of their code points and null last, weigh ``weights`` in turn. They share ``share``
times all words; a target stops at ``max_repeats`` times its source's size and what is over is shared again by weight.

Fit. A source takes every document ``r = floor(target / size)`` times. For what remains of its budget the documents are
counted by exact length; each length gives the same fraction of its count, the rest goes from long to short as far as it
fits, and the last words are fitted by bounded-knapsack dynamic programming over the shortest lengths (a bit set of the
reachable sums, some documents of these lengths being given back first). Where that misses what the lengths' common
divisor allows, the short lengths may have a divisor that some others lack: the same programme over residues says which of those
are taken more, and the rest is fitted without them. Where that misses too, longer lengths are used and four times as many words given
back, until nothing is missed, everything was given back (which is the optimum), or ``MOST_WORDS`` are (which bounds the memory; the nearest
sum found stays). That yields how many documents of each length are taken once more; which ones, a seeded hash decides.

Scale. The histograms are aggregated before they are shuffled and fitted per source, in parallel. Selection ranks rows
by hash within (source, length); a length of more than ``bucket_rows`` documents is split into hash buckets whose counts
give each bucket its quota, so that no task needs a whole length. The driver sees one row for each source.

Defined results: null text has size 0, takes nothing, and is returned; a null source is a source of its own; rows
repeated in full are documents of their own; ties of the hash fall to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mustra.llm.common import stage, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MAX_REPEATS = 2
SEED = 20
BUCKET_ROWS = 256
BUCKETS = 1 << 16
#: The first knapsack's budget in words, and how many of the shortest lengths it may use.
FIT_WORDS = 1 << 16
FIT_LENGTHS = 256
#: The last one's, which bounds its memory: 40 bytes for each of twice as many sums at most.
MOST_WORDS = 1 << 22
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space."""
    return F.when(text.rlike(_WORD), F.length(F.regexp_replace(text, f"{_SPACE}*{_WORD}+{_SPACE}*", "x"))).otherwise(0).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, max_repeats: int = MAX_REPEATS) -> dict[str | None, Fraction]:
    """Words each source is to give."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > max_repeats * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(max_repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as found."""
    counts = {x: n for x, n in counts.items() if x > 0 and n > 0}
    total = _words(counts)
    if budget >= total:
        return counts
    if 2 * budget > total:  # the same to choose what stays out, which is less
        out = fit(counts, total - budget)
        return {x: n - out.get(x, 0) for x, n in counts.items()}
    least = min(budget % math.gcd(*counts), -budget % math.gcd(*counts))
    best = _near(counts, budget, FIT_WORDS)
    for other in (_by_residue, lambda c, b: _near(c, b, MOST_WORDS)):
        if abs(budget - _words(best)) <= least:
            break
        found = other(counts, budget)
        if found is not None and abs(budget - _words(found)) < abs(budget - _words(best)):
            best = found
    return best


def _words(counts: dict[int, int]) -> int:
    return sum(x * n for x, n in counts.items())


def _near(counts: dict[int, int], budget: int, most: int) -> dict[int, int]:
    """The same fraction of each length, the rest from long to short, and the last words by knapsacks over windows that grow to ``most``."""
    total, lengths, divisor = _words(counts), sorted(counts), math.gcd(*counts)
    take = {x: n * budget // total if budget < total else n for x, n in counts.items()}
    left = budget - _words(take)
    for x in reversed(lengths):
        if x <= left and take[x] < counts[x]:
            take[x] += 1
            left -= x
    if left <= 0:
        return take
    best, rest, window = take, left, FIT_WORDS
    over = next((x for x in lengths if take[x] < counts[x]), None)
    if over is not None and abs(over - left) < left:
        best, rest = take | {over: take[over] + 1}, abs(over - left)
    pool = [x for x in lengths if x <= window][:FIT_LENGTHS]
    while True:
        if pool and window >= left:
            unit = math.gcd(*pool)
            found = _knapsack(counts, take, left, pool, window, min(left % unit, -left % unit))
            off = abs(budget - _words(found))
            if off < rest:
                best, rest = found, off
        if rest <= min(budget % divisor, -budget % divisor) or window >= min(budget, most):
            return best
        window *= 4
        pool = [x for x in lengths if x <= window]


def _by_residue(counts: dict[int, int], budget: int) -> dict[int, int] | None:
    """Where the short lengths have a divisor that others lack: some of the others more, so that what is left has the right
    residue, and the rest from the lengths with that divisor. None if that can't be."""
    unit = math.gcd(*sorted(counts)[:FIT_LENGTHS])
    even, odd = ({x: n for x, n in counts.items() if bool(x % unit) == other} for other in (False, True))
    total = _words(counts)
    take = {x: n * budget // total for x, n in odd.items()}
    first, parts = np.full(unit, -1, np.int32), []
    first[0], wanted = len(odd) * 64, (budget - _words(take)) % unit
    for x in sorted(odd):
        for part in _parts(min(odd[x] - take[x], unit - 1)):
            reached = np.flatnonzero(first >= 0)
            new = (reached + x * part) % unit
            new = new[first[new] < 0]
            first[new] = len(parts)
            parts.append((x, part))
        if first[wanted] >= 0:
            break
    at = min(np.flatnonzero(first >= 0).tolist(), key=lambda r: min((r - wanted) % unit, (wanted - r) % unit))
    while at:
        x, part = parts[first[at]]
        take[x] += part
        at = (at - x * part) % unit
    left = budget - _words(take)
    return take | _near(even, left, FIT_WORDS) if left >= 0 else None


def _parts(n: int) -> Iterator[int]:
    """Numbers that add up to every number up to ``n``."""
    part = 1
    while n > 0:
        part = min(part, n)
        yield part
        n, part = n - part, part * 2


def _knapsack(counts: dict[int, int], take: dict[int, int], left: int, pool: list[int], window: int, least: int) -> dict[int, int]:
    """``take`` with the lengths of ``pool`` fitted anew to what is left, documents of up to ``window`` words given back before.

    Of every sum the first part that reaches it is kept, which is enough to walk back: the sum before was there without it.
    """
    take = dict(take)
    for x in pool:
        back = max(0, min(take[x], (window - left) // x))
        take[x] -= back
        left += back * x
    reach, mask, first, parts = 1, (1 << (2 * left + 1)) - 1, np.zeros(2 * left + 8, np.int32), []
    near = lambda: reach >> max(0, left - least) & 1 or reach >> (left + least) & 1
    for x in pool:
        for part in _parts(min(counts[x] - take[x], 2 * left // x)):
            new = reach << x * part & mask & ~reach
            if new:
                whole = np.frombuffer(new.to_bytes(2 * left // 8 + 1, "little"), np.uint8)
                some = np.flatnonzero(whole)
                byte, bit = np.nonzero(np.unpackbits(whole[some, None], axis=1, bitorder="little"))
                first[8 * some[byte] + bit] = len(parts)
                reach |= new
            parts.append((x, part))
        if near():
            break
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    next_up = left + (above & -above).bit_length() if above else None
    at = below if next_up is None or left - below <= next_up - left else next_up
    while at:
        x, part = parts[first[at]]
        take[x] += part
        at -= x * part
    return take


def _source_key(source_col: str) -> Column:
    """A key that is never null, different for a null source and any string."""
    source = F.col(source_col).cast("string")
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _source_key(source_col).alias("source_key"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    return rows.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))


def _plan(sized: DataFrame, weights: Sequence[int], share: Fraction, max_repeats: int) -> DataFrame:
    """Per (source, length): the source's size and target, the repeats of all, and how many are taken once more."""
    counts = sized.groupBy("source_key", "size").agg(F.count("*").alias("n"))
    found = counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    sizes = {r.source_key[1:] if r.source_key[0] == "=" else None: r.words for r in found}
    of = {"-" if s is None else "=" + s: (sizes[s], t) for s, t in targets(sizes, weights, share, max_repeats).items()}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        size, target = of[rows["source_key"].iloc[0]]
        repeats = int(target // size) if size else 0
        budget = int(target - repeats * size + Fraction(1, 2)) if size else 0
        more = fit(dict(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), budget) if budget else {}
        return rows.assign(source_size=size, target=float(target), repeats=repeats, more=[more.get(x, 0) for x in rows["size"].tolist()])

    return counts.groupBy("source_key").applyInPandas(one, "source_key string, size long, n long, source_size long, target double, repeats long, more long")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, max_repeats: int = MAX_REPEATS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source_key, text_hash, size, source_size, target and ``copies``."""
    sized = stage(_sized(docs, id_col, text_col, source_col, seed))
    plan = stage(_plan(sized, weights, share, max_repeats))
    known = sized.join(plan, ["source_key", "size"])
    certain = known.filter((F.col("more") == 0) | (F.col("more") == F.col("n"))).withColumn("chosen", (F.col("more") > 0).cast("long"))
    partial = known.filter((F.col("more") > 0) & (F.col("more") < F.col("n"))).withColumn("buckets", F.least(F.lit(BUCKETS), F.ceil(F.col("n") / bucket_rows)))
    partial = partial.withColumn("bucket", F.pmod(F.shiftright("draw", 20), F.col("buckets")))
    group = ["source_key", "size", "bucket"]
    dealt = partial.filter("buckets > 1").groupBy(*group, "more").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = dealt.select(*group, F.greatest(F.lit(0), F.least(F.col("held"), F.col("more") - before)).alias("quota"))
    large = partial.filter("buckets > 1").join(quotas, group)
    small = partial.filter("buckets = 1").withColumn("quota", F.col("more"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("draw", "doc_id"))
    ranked = small.unionByName(large).withColumn("chosen", (rank <= F.col("quota")).cast("long"))
    cols = ["doc_id", "source_key", "text_hash", "size", "source_size", "target", (F.col("repeats") + F.col("chosen")).alias("copies")]
    return certain.select(*cols).unionByName(ranked.select(*cols))


def mix_words(docs: DataFrame, **options) -> DataFrame:
    """The decisions as words: doc_id, size, source_size, target, taken."""
    return decide(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns of ``docs``.

    Of rows that agree in id, source and text, any may stand for the others.
    """
    key = ["doc_id", "source_key", "text_hash"]
    kept = decide(docs, id_col, text_col, source_col, seed=seed, **options)
    kept = kept.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    # the row travels as one struct, so none of its columns can clash with these
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), _source_key(source_col).alias("source_key"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"))
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.source_key") == F.col("k.source_key")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    both = marked.alias("d").join(kept.alias("k"), same).select("d.*", "copies", "rows")
    even = both.filter("copies % rows = 0").select("row", (F.col("copies") / F.col("rows")).cast("int").alias("times"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    odd = both.filter("copies % rows <> 0").withColumn("nth", nth).select("row", F.expr("CAST(copies DIV rows + IF(nth <= copies % rows, 1, 0) AS INT)").alias("times"))
    return even.unionByName(odd).filter("times > 0").select("row", F.explode(F.expr("sequence(1, times)")).alias("time")).select("row.*")
