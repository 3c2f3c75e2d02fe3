"""Facts dealt by person once, for requests that then need no shuffle.

A bucketed table keeps each person's facts in one bucket, sorted; Spark knows that from the catalog, so an aggregation by
person, a profile's and a semi join between two such tables find their rows where they are. It costs one shuffle of the distinct facts when
it is written and pays where many requests follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mustra.engine import CohortEngine
from mustra.model import CohortModel


def deal_by_person(facts: DataFrame, table: str, buckets: int | None = None) -> DataFrame:
    """Writes distinct facts as the bucketed table ``table`` of the session's catalog; Spark's number of shuffle partitions if no
    number of buckets is given. The number should make buckets of some hundred MB, as it stays."""
    n = buckets or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = facts.select("person_id", "attr", "value", "yyyymm").distinct()
    # by the same hash as the buckets, so that a task writes one file a bucket
    dealt = distinct.repartition(n, "person_id").sortWithinPartitions("person_id", "attr", "value")
    dealt.write.bucketBy(n, "person_id").sortBy("person_id").mode("overwrite").saveAsTable(table)
    return facts.sparkSession.table(table)


def dealt_engine(spark: SparkSession, model: CohortModel, table: str, persons: DataFrame, **options) -> CohortEngine:
    """An engine over a table that ``deal_by_person`` wrote."""
    return CohortEngine(model, spark.table(table), persons, **options)
