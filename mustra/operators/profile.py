"""Counting: cohort sizes, profiles, index statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mustra.model import CohortModel
from mustra.operators import bitmap
from mustra.plans.resolve import Term, any_term


def cohort_count(ids: DataFrame) -> DataFrame:
    return ids.agg(F.count("*").alias("count"))


def _counts(facts: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    held = facts.select("person_id", "attr", "value").join(ids, "person_id", "left_semi")
    return held.groupBy("attr", "value").agg(F.countDistinct("person_id").alias("count")).select(F.lit(kind).alias("kind"), F.col("attr").alias("name"), F.col("value").alias("key"), "count")


def profile_attributes(facts: DataFrame, ids: DataFrame, model: CohortModel) -> DataFrame:
    """kind, name, key, count: how many of the cohort hold each attribute value; none for zero."""
    if not model.attributes:
        return _counts(facts.filter(F.lit(False)), ids, "attribute")
    return _counts(facts.filter(F.col("attr").isin(*model.attributes)), ids, "attribute")


def profile_events(facts: DataFrame, ids: DataFrame, included: Sequence[Term]) -> DataFrame:
    """The same for the codes that the query's positive event clauses name, in any month."""
    return _counts(facts.filter(any_term(included) if included else F.lit(False)), ids, "event")


def profiled(model: CohortModel, included: Sequence[Term]) -> Column:
    """Which facts a profile counts: the attributes and the codes named."""
    of_model = F.col("attr").isin(*model.attributes) if model.attributes else F.lit(False)
    return of_model | any_term(included) if included else of_model


def profile_both(facts: DataFrame, ids: DataFrame, model: CohortModel, included: Sequence[Term]) -> DataFrame:
    """The profiles of attributes and of the codes named, from one reading of the facts."""
    of_model = F.col("attr").isin(*model.attributes) if model.attributes else F.lit(False)
    held = facts.filter(profiled(model, included)).select("person_id", "attr", "value").join(ids, "person_id", "left_semi")
    counts = held.groupBy("attr", "value").agg(F.countDistinct("person_id").alias("count"))
    return counts.select(F.when(of_model, "attribute").otherwise("event").alias("kind"), F.col("attr").alias("name"), F.col("value").alias("key"), "count")


def profile_of_held(held: DataFrame, model: CohortModel) -> DataFrame:
    """The same of persons with lists of what they hold (``one_pass``), without reading the facts again."""
    of_model = F.col("attr").isin(*model.attributes) if model.attributes else F.lit(False)
    counts = held.select(F.inline("held")).groupBy("attr", "value").agg(F.count("*").alias("count"))
    return counts.select(F.when(of_model, "attribute").otherwise("event").alias("kind"), F.col("attr").alias("name"), F.col("value").alias("key"), "count")


def ordered(profile: DataFrame, model: CohortModel) -> DataFrame:
    """Attributes in the model's order, then event types by name; keys by count, largest first, then by key."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, model.attributes)).cast("array<string>"), F.col("name")), F.lit(0))
    return profile.orderBy("kind", place, "name", F.desc("count"), "key")


def nested(profile: DataFrame) -> DataFrame:
    """kind, name, values: a list of (key, count) per group, largest count first."""
    pairs = F.collect_list(F.struct((-F.col("count")).alias("order"), "key", "count"))
    return profile.groupBy("kind", "name").agg(F.transform(F.array_sort(pairs), lambda p: F.struct(p.key.alias("key"), p["count"].alias("count"))).alias("values"))


def value_cardinality(facts: DataFrame) -> DataFrame:
    """Persons per (attr, value)."""
    return facts.groupBy("attr", "value").agg(F.countDistinct("person_id").alias("n_persons"))


def month_cardinality(facts: DataFrame) -> DataFrame:
    """Persons per (attr, value, yyyymm)."""
    return facts.filter("yyyymm IS NOT NULL").groupBy("attr", "value", "yyyymm").agg(F.countDistinct("person_id").alias("n_persons"))


def index_stats(facts: DataFrame, persons: DataFrame) -> DataFrame:
    """patient_count, and fact_count: distinct (value, person) and distinct (value, month, person) together.

    Facts become blocks before they are shuffled, so what is shuffled follows the values and months, not the facts.
    """
    months = bitmap.to_bitmaps(facts, "attr", "value", "yyyymm")
    return _stats(months, F.bitmap_count(F.bitmap_or_agg("bitmap")), F.col("yyyymm").isNotNull(), persons)


def index_stats_of_blocks(blocks: DataFrame, persons: DataFrame) -> DataFrame:
    """The same from an index's blocks alone."""
    one = bitmap.merged(blocks, "attr", "value", "yyyymm")
    return _stats(one, F.lit(0), F.lit(True), persons)


def _stats(blocks: DataFrame, whole: Column, counted: Column, persons: DataFrame) -> DataFrame:
    """The blocks for which ``counted`` holds, and ``whole`` of those of each value."""
    each = blocks.groupBy("attr", "value", "bucket").agg((whole + F.coalesce(F.sum(F.when(counted, F.bitmap_count("bitmap"))), F.lit(0))).alias("n"))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("fact_count"))
    return total.select(persons.agg(F.count("*").alias("n")).scalar().alias("patient_count"), "fact_count")


def profile_of_blocks(blocks: DataFrame, cohort: DataFrame, model: CohortModel, included: Sequence[Term]) -> DataFrame:
    """The profiles of ``profile_both`` for a bitmap set, from an index's blocks alone."""
    of_model = F.col("attr").isin(*model.attributes) if model.attributes else F.lit(False)
    counts = bitmap.profile(bitmap.whole(blocks.filter(profiled(model, included))), cohort)
    return counts.select(F.when(of_model, "attribute").otherwise("event").alias("kind"), F.col("attr").alias("name"), F.col("value").alias("key"), "count")
