"""Type-ahead search over codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mustra.functions.columns import match_tier

PREFIX, CONTAINS = "prefix", "contains"
PAGE, MOST = 20, 100


def ranked(values: DataFrame, keyword: str, mode: str = PREFIX, crosswalk: DataFrame | None = None) -> DataFrame:
    """value, tier: matches of ``values`` (one column value), then of crosswalk sources, then of targets of these sources
    that match themselves; each value in its first tier."""
    contains = mode == CONTAINS
    found = values.select("value", match_tier(F.col("value"), keyword, contains, 0).alias("tier"))
    if crosswalk is not None:
        sources = crosswalk.filter(match_tier(F.col("source"), keyword, contains).isNotNull())
        found = found.unionByName(sources.select(F.col("source").alias("value"), match_tier(F.col("source"), keyword, contains, 2).alias("tier")))
        found = found.unionByName(sources.select(F.col("target").alias("value"), match_tier(F.col("target"), keyword, contains, 4).alias("tier")))
    return found.filter(F.col("tier").isNotNull()).groupBy("value").agg(F.min("tier").alias("tier"))


#: Stands before a value's first character.
START = "\x02"
GRAM = 3


def grams(words: DataFrame) -> DataFrame:
    """attr, gram, value: the substrings of up to ``GRAM`` characters of each value in lower case, those at its start with a mark."""
    text = F.concat(F.lit(START), F.lower("value"))
    cut = lambda size: F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    each = words.select("attr", "value").distinct()
    return each.select("attr", F.explode(F.array_distinct(F.flatten(F.array(*map(cut, range(1, GRAM + 1)))))).alias("gram"), "value")


def candidates(index: DataFrame, attr: str, keyword: str, mode: str = PREFIX) -> DataFrame:
    """value: those of ``attr`` that have all the keyword's grams, a few more than match; only rows with these grams are read."""
    key = keyword.lower() if mode == CONTAINS else START + keyword.lower()
    needed = sorted({key[i : i + GRAM] for i in range(max(1, len(key) - GRAM + 1))})
    rows = index.filter((F.col("attr") == attr) & F.col("gram").isin(*needed))
    return rows.groupBy("value").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(needed)).select("value")


def page(found: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """value, position (from 0), total: one page in the order of tier and value; limit from 1 to 100, offset not negative.

    Only the first ``offset + limit`` values are put in order; all are only counted.
    """
    limit, offset = max(1, min(limit, MOST)), max(0, offset)
    total = found.agg(F.count("*").alias("total")).scalar()
    first = found.orderBy("tier", "value").limit(offset + limit)
    numbered = first.select("value", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tier", "value")) - 1).alias("position"))
    return numbered.filter(F.col("position") >= offset).withColumn("total", total)
