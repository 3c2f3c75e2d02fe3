"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mustra.sources.store import gone_at_exit, shared_root


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data set, through Spark's own reader (any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text"):
    """The text column as string, a null text being an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def valid_text(column: str = "text"):
    """The same with U+FFFD for bytes that are not UTF-8, for code that can't read such."""
    return F.make_valid_utf8(text_or_empty(column))


def stage(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again; gone when the driver ends.

    It cuts the lineage, and is for what is used more than once and must survive the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
