"""Crosswalk files: one source code per line with one target code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_MARK = "rxnorm_code"


def read_crosswalk(spark: SparkSession, path: str, header_mark: str = HEADER_MARK) -> DataFrame:
    """source, target, ord: distinct pairs, ``ord`` in the file's order.

    Line ends may be of any kind. The first line that isn't empty is dropped if it holds ``header_mark``, in any case. The first
    comma splits; white space of any kind, then quotes are trimmed; lines without comma or with an empty side don't
    count. The file is a list of codes, small enough to be one row.
    """
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\r\n|\r|\n"), lambda x: x != "").alias("lines"))
    lines = lines.select(F.posexplode("lines").alias("ord", "line")).filter(~((F.col("ord") == 0) & F.lower("line").contains(header_mark.lower())))
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    side = lambda i: F.regexp_replace(trimmed(F.get(F.split(trimmed(F.col("line")), ",", 2), F.lit(i))), '^"+|"+$', "")
    pairs = lines.select(side(0).alias("source"), side(1).alias("target"), "ord").filter("source <> '' AND target <> ''")
    return pairs.groupBy("source", "target").agg(F.min("ord").alias("ord"))


def crosswalk_of(spark: SparkSession, codes: dict[str, list[str]]) -> DataFrame:
    rows = [(s, t, i) for i, (s, t) in enumerate((s, t) for s, targets in codes.items() for t in dict.fromkeys(targets))]
    return spark.createDataFrame(rows, "source string, target string, ord int")
