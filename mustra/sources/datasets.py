"""The models over the star-schema tables: orders as people's histories, click streams, a text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mustra.engine import CohortEngine
from mustra.functions.columns import yyyymm
from mustra.model import CohortModel
from mustra.sources.crosswalk import crosswalk_of
from mustra.sources.facts import deal_rows, facts_of, traits, union

ORDERS = CohortModel(attributes=("segment", "nation", "region"), event_types=("brand", "ptype", "priority"), crosswalk_event="ptype")
CLICKS = CohortModel(attributes=(), event_types=("event_type",))
CORPUS = CohortModel(attributes=("lang", "source", "quality", "toxic"), event_types=())
ORDERS_CROSSWALK = {"promo-all": ["PROMO"], "sized": ["SMALL", "MEDIUM", "LARGE"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str, once: bool = False, dealt: bool = False) -> DataFrame:
    """``once``: line items are joined once and give all their facts, for those who read every fact; else each attribute
    is a branch of its own, which filters on it and its values can remove or reach down to the scan. ``dealt``: once, and by month
    and part of a block, for an index to be saved."""
    read = lambda name: table(spark, sf_dir, name)
    person, month = F.col("c_custkey"), yyyymm(F.col("o_orderdate"))
    customer, orders = read("customer"), read("orders")
    nation = customer.join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    region = nation.join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyer = F.col("o_custkey")
    of_orders = facts_of(orders, buyer, "priority", F.col("o_orderpriority"), month)
    if dealt:
        # months once an order, and hashed rather than sorted: items needn't be in order
        dated = orders.filter(buyer.isNotNull()).select("o_orderkey", buyer.cast("long").alias("person_id"), month.alias("yyyymm")).hint("shuffle_hash")
        items = read("lineitem").join(dated, F.col("l_orderkey") == F.col("o_orderkey")).join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
        wide = deal_rows(items.select("person_id", "yyyymm", F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype")))
        of_orders = deal_rows(of_orders)
    else:
        items = read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    if once:
        wide = items.select(buyer.cast("long").alias("person_id"), month.alias("yyyymm"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"))
    if once or dealt:
        bought = wide.unpivot(["person_id", "yyyymm"], ["brand", "ptype"], "attr", "value").select("person_id", "attr", "value", "yyyymm")
        of_items = [bought.filter("person_id IS NOT NULL AND value IS NOT NULL")]
    else:
        of_items = [facts_of(items, buyer, "brand", F.col("p_brand"), month), facts_of(items, buyer, "ptype", F.col("p_type"), month)]
    return union([
        traits(customer, person, {"segment": F.col("c_mktsegment")}), traits(nation, person, {"nation": F.col("n_name")}), traits(region, person, {"region": F.col("r_name")}),
        *of_items, of_orders,
    ])


def orders_engine(spark: SparkSession, sf_dir: str, once: bool = False, dealt: bool = False, **options) -> CohortEngine:
    persons = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("person_id"), F.col("c_name").alias("person_guid"))
    return CohortEngine(ORDERS, order_facts(spark, sf_dir, once, dealt), persons, crosswalk=crosswalk_of(spark, ORDERS_CROSSWALK), **options)


def clicks_engine(spark: SparkSession, sf_dir: str, **options) -> CohortEngine:
    events = table(spark, sf_dir, "events")
    persons = events.select(F.col("user_id").alias("person_id")).distinct().withColumn("person_guid", F.col("person_id").cast("string"))
    return CohortEngine(CLICKS, facts_of(events, F.col("user_id"), "event_type", F.col("event_type"), yyyymm(F.col("ts"))), persons, **options)


def corpus_engine(spark: SparkSession, sf_dir: str, **options) -> CohortEngine:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    facts = union([traits(docs, F.col("doc_id"), {"lang": F.col("lang"), "source": F.col("source")}), traits(labels, F.col("doc_id"), {"quality": F.col("quality"), "toxic": F.col("toxic")})])
    persons = docs.select(F.col("doc_id").alias("person_id"), F.col("doc_id").cast("string").alias("person_guid"))
    return CohortEngine(CORPUS, facts, persons, **options)
