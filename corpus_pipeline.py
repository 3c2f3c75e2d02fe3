"""A training corpus from raw documents: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
``docs``; all but the last return the columns of ``documents``.

Defined results: a null text is an empty one, and what the trees score an empty text decides on it; a document that line dedup
empties goes, one that was blank before stays; rows repeated in full are near-duplicates, so one of them stays; null ids and sources stay
apart from all others as the operators define it; other columns pass through, whatever their names; long texts are
read whole; an empty table gives no rows, and so does one without labels only if the smoothed share is under the cutoff.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mustra.llm import byte_bpe, line_dedup, mixing, near_dedup, quality
from mustra.llm.common import fresh, read, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents go, and documents that had no others."""
    return line_dedup.drop_emptied(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number (``ids`` and ``n_tokens``, with underscores behind where documents have such columns), and
    as text what the ids decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids, number = fresh(docs, "ids"), fresh(docs, "n_tokens")
    return byte_bpe.recode_documents(docs, path, pattern, ids_col=ids).withColumn(number, F.size(ids).cast("long"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("byte_bpe", token_stage)]

#: Trees, signatures, knapsack and merges can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
