"""Appending events to a facts table as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mustra.functions.columns import yyyymm
from mustra.sources.facts import append_to_index, has_index


def stream_facts(events: DataFrame, person: Column, attr: str, value: Column, ts: Column, delay: str = "1 day") -> DataFrame:
    """Distinct facts of a stream of events; a fact repeats only if it comes again after ``delay``."""
    marked = events.withColumn("event_time", ts.cast("timestamp")).withWatermark("event_time", delay)
    month = yyyymm(F.col("event_time")).alias("yyyymm")
    facts = marked.select(person.cast("long").alias("person_id"), F.lit(attr).alias("attr"), value.cast("string").alias("value"), month, "event_time")
    facts = facts.filter(F.col("person_id").isNotNull() & F.col("value").isNotNull())
    return facts.dropDuplicatesWithinWatermark(["person_id", "attr", "value", "yyyymm"]).drop("event_time")


def append_facts(facts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream of facts behind those of the index saved at ``path``, batch by batch, with their codes and blocks; a batch that is
    done again after a failure repeats facts, which changes no answer. Where no index is, facts are written to ``path``/facts."""
    if not has_index(facts.sparkSession, path):
        writer = facts.writeStream.format("parquet").partitionBy("attr").option("path", f"{path}/facts").outputMode("append")
    else:
        writer = facts.writeStream.foreachBatch(lambda batch, number: append_to_index(batch, path)).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
