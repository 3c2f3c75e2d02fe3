"""From a resolved query to a table of person ids: in one pass, by semi and anti joins, or by stored bitmaps.

One pass reads the facts that any clause wants, and asks per person which clauses hold; its cost hardly depends on the
number of clauses, and the aggregation combines before it shuffles. Joins begin with the clause that the fewest persons
meet, hand its ids to the next one, and so on, so what is shuffled is bounded by that clause. Bitmaps unite and intersect the
index's blocks and read no facts. All give the same ids.

Which one is taken depends on the persons a clause can match at most, as the vocabulary counts them for each value: joins if
they are few enough to be broadcast by the first clause's bound, bitmaps if blocks are stored and many persons are to be
read, else one pass. Without such counts the number of clauses decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mustra.operators import bitmap
from mustra.plans.resolve import ResolvedQuery, Term, any_term

ONE_PASS, JOINS, BITMAP, AUTO = "onepass", "joins", "bitmap", "auto"
MOST_JOINED = 1
#: Ids that a broadcast may hold (8 MB of them), and persons from which on blocks are read rather than facts.
BROADCAST_IDS = 1_000_000
BITMAP_FROM = 100_000

Clause = tuple[Term, ...]


def positive_clauses(q: ResolvedQuery) -> list[Clause]:
    """All but that of events.anyOf."""
    return [(t,) for t in q.all_of] + ([q.attr_any] if q.attr_any else [])


def _nobody(facts: DataFrame) -> DataFrame:
    return facts.select("person_id").filter(F.lit(False))


def _hit(rows: DataFrame, found: Column) -> Column:
    """Whether any row at all is one of events.anyOf; a scalar of one row."""
    return rows.filter(found).limit(1).agg((F.count("*") > 0).alias("hit")).scalar()


def _vanishing(q: ResolvedQuery) -> bool:
    """Whether events.anyOf is no restriction if nobody at all matches it: lenient, beside other positive clauses."""
    return bool(q.event_any and q.lenient and positive_clauses(q)) and q.hit is None


def _dropped(q: ResolvedQuery) -> bool:
    return bool(q.lenient and positive_clauses(q)) and q.hit is False


def estimates(clauses: Sequence[Clause], words: DataFrame) -> list[int] | None:
    """How many persons each clause can match at most, by one look at the vocabulary; None where it has no counts."""
    if not clauses:
        return []
    of = [any_term(t.timeless() for t in c) for c in clauses]
    sums = words.filter(reduce(or_, of)).agg(F.bool_or(F.col("n_persons").isNull()).alias("unknown"), *(F.sum(F.when(c, F.col("n_persons"))).alias(f"n{i}") for i, c in enumerate(of))).first()
    return None if sums.unknown else [n or 0 for n in sums[1:]]


def one_pass(q: ResolvedQuery, facts: DataFrame, held: Column | None = None) -> DataFrame:
    """``held``: a predicate on facts; with it, ``held`` lists the (attr, value) of each person's facts that meet it."""
    if q.void:
        nobody = _nobody(facts)
        return nobody if held is None else nobody.withColumn("held", F.lit(None).cast("array<struct<attr: string, value: string>>"))
    positive = positive_clauses(q)
    flags = {f"p{i}": any_term(c) for i, c in enumerate(positive)}
    if q.event_any and not _dropped(q):
        flags["any"] = any_term(q.event_any)
    if q.exclude:
        flags["no"] = any_term(q.exclude)
    # the comparison with a null month is null: without coalesce a person with timeless facts only would be lost
    sums = [F.bool_or(F.coalesce(p, F.lit(False))).alias(k) for k, p in flags.items()]
    lists = [] if held is None else [F.collect_set(F.when(held, F.struct("attr", "value"))).alias("held")]
    per_person = facts.filter(reduce(or_, [*flags.values(), *([] if held is None else [held])])).groupBy("person_id").agg(*sums, *lists)
    wanted = [F.col(k) for k in flags if k.startswith("p")]
    if "any" in flags:
        wanted.append(F.col("any") | ~_hit(facts, flags["any"]) if _vanishing(q) else F.col("any"))
    if q.exclude:
        wanted.append(~F.col("no"))
    return per_person.filter(reduce(and_, wanted)).select("person_id", *([] if held is None else ["held"]))


def joined(q: ResolvedQuery, facts: DataFrame, bounds: Sequence[int] | None = None) -> DataFrame:
    """``bounds``: of the positive clauses, events.anyOf last; the smallest comes first, and is broadcast if it is small."""
    if q.void:
        return _nobody(facts)
    ids = lambda c: facts.filter(any_term(c)).select("person_id")
    sets = positive_clauses(q)
    if q.event_any and not _vanishing(q) and not _dropped(q):
        sets.append(q.event_any)
    small = bounds is not None and len(bounds) >= len(sets) and min(bounds[: len(sets)]) <= BROADCAST_IDS
    if bounds is not None and len(bounds) >= len(sets):
        sets = [c for _, c in sorted(zip(bounds, sets, strict=False), key=lambda x: x[0])]
    if small:
        held = lambda found: F.broadcast(found)
        out = ids(sets[0]).distinct()
        for c in sets[1:]:
            out = ids(c).join(held(out), "person_id", "left_semi").distinct()
    else:
        held = lambda found: found
        out = reduce(lambda a, b: a.join(b, "person_id", "left_semi"), map(ids, sets)).distinct()
    if _vanishing(q):
        found = any_term(q.event_any)
        some = ids(q.event_any)
        some = (some.join(held(out), "person_id", "left_semi") if small else some).distinct().withColumn("in_any", F.lit(True))
        out = out.join(some, "person_id", "left").filter(F.col("in_any").isNotNull() | ~_hit(facts, found)).select("person_id")
    if not q.exclude:
        return out
    no = ids(q.exclude)
    return out.join(no.join(held(out), "person_id", "left_semi") if small else no, "person_id", "left_anti")


def _of_blocks(clause: Clause) -> Column:
    """Which blocks hold a clause's ids: of the months asked for, or of all facts."""
    return reduce(or_, (t.predicate() if t.months else t.predicate() & F.col("yyyymm").isNull() for t in clause))


def bitmaps(q: ResolvedQuery, blocks: DataFrame) -> DataFrame:
    """The ids as a bitmap set, from an index's blocks."""
    if q.void:
        return blocks.select("bucket", "bitmap").filter(F.lit(False))
    sets, counted = [_of_blocks(c) for c in positive_clauses(q)], {}
    if q.event_any and not _dropped(q):
        sets.append(_of_blocks(q.event_any))
        if _vanishing(q):
            counted[len(sets) - 1] = _hit(blocks, sets[-1])
    return bitmap.clauses(blocks, sets, [_of_blocks(q.exclude)] if q.exclude else [], counted)


def choose(q: ResolvedQuery, words: DataFrame | None, blocks: DataFrame | None) -> tuple[str, list[int] | None]:
    """The planner for a query, and the bounds of its positive clauses, where the vocabulary has them."""
    clauses = positive_clauses(q) + ([q.event_any] if q.event_any and not _dropped(q) else [])
    if q.void or words is None:
        return (JOINS if len(clauses) + bool(q.exclude) <= MOST_JOINED else ONE_PASS), None
    found = estimates([*clauses, *([q.exclude] if q.exclude else [])], words)
    if found is None:
        return (JOINS if len(clauses) + bool(q.exclude) <= MOST_JOINED else ONE_PASS), None
    bounds = found[: len(clauses)]
    if blocks is not None and sum(found) >= BITMAP_FROM:
        return BITMAP, bounds
    surely = bounds[:-1] if _vanishing(q) else bounds
    # the first clause's ids go to every task; worth it if the others would send many more
    few = min(surely) <= BROADCAST_IDS and 4 * min(surely) <= sum(found)
    return (JOINS if few or len(clauses) + bool(q.exclude) <= MOST_JOINED else ONE_PASS), bounds


def plan(q: ResolvedQuery, facts: DataFrame, planner: str = AUTO, words: DataFrame | None = None, blocks: DataFrame | None = None, bounds: Sequence[int] | None = None) -> DataFrame:
    """Distinct person_id of those who match."""
    if planner == AUTO:
        planner, bounds = choose(q, words, blocks)
    if planner == BITMAP:
        if blocks is None:
            raise ValueError("the bitmap planner needs an index's blocks")
        return bitmap.ids_of(bitmaps(q, blocks))
    return one_pass(q, facts) if planner == ONE_PASS else joined(q, facts, bounds)
