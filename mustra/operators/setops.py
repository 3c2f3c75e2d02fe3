"""Set algebra over tables of person_id, and the index's own query overloads.

A set is a table with one column person_id; results are distinct.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (attr, value) and (attr, value, yyyymm)
Value = tuple[str, str]
Bucket = tuple[str, str, int]


def union_ids(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def intersect_ids(*sets: DataFrame) -> DataFrame:
    """Semi joins rather than INTERSECT: a small side is broadcast and duplicates go once, at the end."""
    return reduce(lambda a, b: a.join(b, "person_id", "left_semi"), sets).distinct()


def subtract_ids(left: DataFrame, *rights: DataFrame) -> DataFrame:
    return left.join(reduce(DataFrame.unionByName, rights), "person_id", "left_anti").distinct() if rights else left.distinct()


def _one(item: Sequence) -> Column:
    out = (F.col("attr") == item[0]) & (F.col("value") == item[1])
    return out & (F.col("yyyymm") == item[2]) if len(item) > 2 else out


def holders(facts: DataFrame, items: Sequence[Sequence]) -> DataFrame:
    """Distinct ids of those who hold any of the values or buckets; nobody for no items."""
    found = reduce(lambda a, b: a | b, map(_one, items), F.lit(False))
    return facts.filter(found).select("person_id").distinct()


def _held(facts: DataFrame, groups: Sequence[Sequence[Sequence]]) -> DataFrame:
    """person_id and, for each group of items, whether the person holds one of them: one reading of the facts, combined by person
    before it is shuffled. A group of no items is held by nobody."""
    found = [reduce(or_, map(_one, items), F.lit(False)) for items in groups]
    # the month of timeless facts is null, and so is what it is compared to
    flags = (F.bool_or(F.coalesce(f, F.lit(False))).alias(f"g{i}") for i, f in enumerate(found))
    return facts.filter(reduce(or_, found)).groupBy("person_id").agg(*flags)


def _select(facts: DataFrame, needed: Sequence[Sequence[Sequence]], minus: Sequence[Sequence]) -> DataFrame:
    """Those who hold one item of each group, and none of ``minus``; nobody for no groups."""
    if not needed:
        return holders(facts, [])
    held = _held(facts, [*needed, minus])
    return held.filter(reduce(and_, (F.col(f"g{i}") for i in range(len(needed)))) & ~F.col(f"g{len(needed)}")).select("person_id")


def query_all(facts: DataFrame, values: Sequence[Value], buckets: Sequence[Bucket] = (), minus: Sequence[Value] = ()) -> DataFrame:
    """Those who hold all values and buckets, and none of ``minus``; nobody if nothing is asked for."""
    return _select(facts, [[x] for x in (*values, *buckets)], minus)


def query_any(facts: DataFrame, any_of: Sequence[Value] = (), values: Sequence[Value] = (), buckets: Sequence[Bucket] = (), minus: Sequence[Value] = ()) -> DataFrame:
    """Those who hold one of ``any_of`` (if there are any), all values and buckets, and none of ``minus``."""
    return _select(facts, ([any_of] if any_of else []) + [[x] for x in (*values, *buckets)], minus)


def query_any_bucket(facts: DataFrame, buckets: Sequence[Bucket], values: Sequence[Value] = (), minus: Sequence[Value] = ()) -> DataFrame:
    """Those who hold one of the buckets, all values, and none of ``minus``."""
    return _select(facts, [buckets, *([v] for v in values)], minus)


def query_widening(facts: DataFrame, all_of: Sequence[Sequence] = (), any_of: Sequence[Sequence] = (), minus: Sequence[Sequence] = ()) -> DataFrame:
    """The older full query: those of all_of *or* any_of, without ``minus``; nobody as soon as all_of, if given, matches nobody."""
    if not all_of:
        return _select(facts, [any_of], minus) if any_of else holders(facts, [])
    held = _held(facts, [*([x] for x in all_of), any_of, minus])
    every, one, none = reduce(and_, (F.col(f"g{i}") for i in range(len(all_of)))), F.col(f"g{len(all_of)}"), ~F.col(f"g{len(all_of) + 1}")
    # all flags take part, so the scalar's plan is the same up to its shuffle and Spark reads the facts once for both
    some = held.agg(F.max(F.struct(every.alias("every"), *(c for c in held.columns if c != "person_id"))).alias("most")).scalar()
    return held.filter((every | one) & none & F.coalesce(some.getField("every"), F.lit(False))).select("person_id")
