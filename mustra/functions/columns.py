"""Column forms of the scalar functions that cohort queries use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yyyymm(ts: Column) -> Column:
    """Month of a date or timestamp as an integer."""
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def year_of(ts: Column) -> Column:
    return F.year(ts).cast("int")


def month_list(start: Column, end: Column) -> Column:
    """The months from start to end as an array of integers; empty if start is after end."""
    first, last = (F.to_date(c.cast("string"), "yyyyMM") for c in (start, end))
    months = F.transform(F.sequence(first, last, F.expr("interval 1 month")), lambda d: yyyymm(d))
    return F.when(start <= end, months).otherwise(F.array().cast("array<int>"))


def normalised_code(code: Column) -> Column:
    """x and X, which clinicians write for any rest of a code, as the wildcard."""
    return F.regexp_replace(code, "[xX]", "*")


def match_tier(value: Column, keyword: str, contains: bool, first: int = 0) -> Column:
    """``first`` where the value starts with the keyword, ``first + 1`` where it contains it (if asked for), else null; case doesn't count."""
    key, low = keyword.lower(), F.lower(value)
    tier = F.when(low.startswith(key), F.lit(first))
    return tier.when(low.contains(key), F.lit(first + 1)) if contains else tier
