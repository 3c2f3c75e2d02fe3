"""The cohort engine's queries over the star-schema tables, each with the SQL that says the same."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mustra.engine import CohortEngine
from mustra.functions.columns import month_list, normalised_code, year_of, yyyymm
from mustra.operators import bitmap, profile, search, setops
from mustra.plans.planner import BITMAP, JOINS, ONE_PASS
from mustra.plans.resolve import STRICT
from mustra.request import QueryRequest
from mustra.sources.bucketed import deal_by_person, dealt_engine
from mustra.sources.crosswalk import crosswalk_of, read_crosswalk
from mustra.sources.datasets import ORDERS, ORDERS_CROSSWALK, clicks_engine, corpus_engine, order_facts, orders_engine, table
from mustra.sources.facts import append_to_index, compact_index, facts_of
from mustra.sources.store import new_place
from mustra.sql import CohortSql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FACTS = """
  items AS (
    SELECT o_custkey, p_brand, p_type, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS yyyymm
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  ), facts AS (
    SELECT c_custkey AS person_id, 'segment' AS attr, c_mktsegment AS value, CAST(NULL AS INTEGER) AS yyyymm FROM customer
    UNION ALL SELECT c_custkey, 'nation', n_name, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT c_custkey, 'region', r_name, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT o_custkey, 'brand', p_brand, yyyymm FROM items
    UNION ALL SELECT o_custkey, 'ptype', p_type, yyyymm FROM items
    UNION ALL SELECT o_custkey, 'priority', o_orderpriority, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) FROM orders
  )
"""


def held(attr: str, *values: str, months: tuple[int, int] | None = None) -> str:
    """SQL: the ids of those who hold one of the values; a trailing % is a prefix."""
    of = " OR ".join(f"starts_with(value, '{v[:-1]}')" if v.endswith("%") else f"value = '{v}'" for v in values)
    return f"(SELECT person_id FROM facts WHERE attr = '{attr}' AND ({of})" + (f" AND yyyymm BETWEEN {months[0]} AND {months[1]})" if months else ")")


def who(*conditions: str) -> str:
    """SQL: distinct ids for which all conditions hold; each is ``IN (...)`` or ``NOT IN (...)``, or several of them."""
    where = " AND ".join(c if c.startswith("(") else f"person_id {c}" for c in conditions)
    return f"SELECT DISTINCT person_id FROM facts WHERE {where}"


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql if sql.lstrip().upper().startswith("WITH") else f"WITH {FACTS} {sql}"


def cohort(name: str, sql: str, counted: bool = False, options: dict | None = None, **lists) -> None:
    """A request's ids; or, where they may be none, how many they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = orders_engine(spark, sf_dir, **(options or {})).cohort(QueryRequest.of(**lists))
        return profile.cohort_count(ids) if counted else ids

    add(name, run, f"SELECT count(*) AS count FROM ({sql})" if counted else sql)


BUILDING, ASIA = ("segment", "BUILDING"), ("region", "ASIA")
FLAGSHIP = {
    "attr_all": [BUILDING], "attr_any": [ASIA, ("region", "EUROPE")],
    "event_all": [("brand", "Brand#1*", 199701, 199712)], "event_exclude": [("brand", "Brand#25", 199901, 199906)],
}
FLAGSHIP_SQL = who(f"IN {held('segment', 'BUILDING')}", f"IN {held('region', 'ASIA', 'EUROPE')}", f"IN {held('brand', 'Brand#1%', months=(199701, 199712))}", f"NOT IN {held('brand', 'Brand#25', months=(199901, 199906))}")
IN_BUILDING = f"IN {held('segment', 'BUILDING')}"


def flagship(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return orders_engine(spark, sf_dir, **options).cohort(QueryRequest.of(**FLAGSHIP))


cohort("cohort_flagship", FLAGSHIP_SQL, **FLAGSHIP)
cohort("cohort_flagship_joins", FLAGSHIP_SQL, options={"planner": JOINS}, **FLAGSHIP)
cohort("attr_equality", who(IN_BUILDING), attr_all=[BUILDING])
cohort("attr_all_of", who(IN_BUILDING, f"IN {held('region', 'ASIA')}"), attr_all=[BUILDING, ASIA])
cohort("attr_any_of", who(f"IN {held('nation', 'NATION_3', 'NATION_11')}"), attr_any=[("nation", "NATION_3"), ("nation", "NATION_11")])
cohort("event_exact_timeless", who(f"IN {held('brand', 'Brand#1')}"), event_all=[("brand", "Brand#1")])
cohort("event_all_of_exact_month", who(f"IN {held('brand', 'Brand#12', months=(199703, 199703))}"), event_all=[("brand", "Brand#12", 199703, 199703)])
cohort("event_all_of_two", who(f"IN {held('brand', 'Brand#3', months=(199601, 199612))}", f"IN {held('ptype', 'PROMO', months=(199701, 199706))}"), options={"once": True}, event_all=[("brand", "Brand#3", 199601, 199612), ("ptype", "PROMO", 199701, 199706)])
cohort("event_prefix_timeless", who(f"IN {held('brand', 'Brand#2%')}"), event_all=[("brand", "Brand#2*")])
cohort("event_prefix_month", who(f"IN {held('brand', 'Brand#2%', months=(200001, 200003))}"), event_all=[("brand", "Brand#2*", 200001, 200003)])
cohort("event_prefix_single_month", who(f"IN {held('brand', 'Brand#1%', months=(199805, 199805))}"), event_all=[("brand", "Brand#1*", 199805, 199805)])
cohort("event_any_of", who(IN_BUILDING, f"IN {held('brand', 'Brand#7', months=(199601, 199603))} OR person_id IN {held('ptype', 'SMALL', months=(199705, 199705))}".join(("(person_id ", ")"))), attr_all=[BUILDING], event_any=[("brand", "Brand#7", 199601, 199603), ("ptype", "SMALL", 199705, 199705)])
MISS = {"attr_all": [BUILDING], "event_any": [("brand", "Brand#1", 199001, 199012)]}
for _planner in (ONE_PASS, JOINS):
    cohort(f"event_any_of_strict_{_planner}", who(IN_BUILDING, f"IN {held('brand', 'Brand#1', months=(199001, 199012))}"), counted=True, options={"semantics": STRICT, "planner": _planner}, **MISS)
    cohort(f"event_any_of_lenient_vanish_{_planner}", who(IN_BUILDING), options={"planner": _planner}, **MISS)
cohort("any_of_both_kinds", who(f"IN {held('region', 'ASIA', 'AFRICA')}", f"IN {held('brand', 'Brand#9', months=(199601, 199606))}"), attr_any=[ASIA, ("region", "AFRICA")], event_any=[("brand", "Brand#9", 199601, 199606)])
cohort("exclude_attr_event", who(IN_BUILDING, f"NOT IN {held('region', 'EUROPE')}", f"NOT IN {held('ptype', 'PROMO', months=(199601, 199612))}"), attr_all=[BUILDING], attr_exclude=[("region", "EUROPE")], event_exclude=[("ptype", "PROMO", 199601, 199612)])
cohort("exclude_unknown_ignored", who(IN_BUILDING), attr_all=[BUILDING], attr_exclude=[("region", "ATLANTIS")], event_exclude=[("brand", "*")])
cohort("exclude_only_empty", "SELECT 1 WHERE false", counted=True, attr_exclude=[ASIA])
cohort("request_empty", "SELECT 1 WHERE false", counted=True)
cohort("unresolved_sibling_dropped", who(IN_BUILDING), attr_all=[BUILDING, ("segment", "BOGUS")])
cohort("unresolved_sibling_strict", "SELECT 1 WHERE false", counted=True, options={"semantics": STRICT}, attr_all=[BUILDING, ("segment", "BOGUS")])
cohort("unresolved_all_zero", "SELECT 1 WHERE false", counted=True, attr_all=[BUILDING], event_all=[("brand", "Nothing")])
cohort("month_miss_all_of_zero", "SELECT 1 WHERE false", counted=True, event_all=[("brand", "Brand#1", 199001, 199012)])
cohort("inverted_range_dropped", who(f"IN {held('brand', 'Brand#2')}"), event_all=[("brand", "Brand#1", 199712, 199701), ("brand", "Brand#2")])
cohort("one_sided_range_timeless", who(f"IN {held('brand', 'Brand#1')}"), event_all=[("brand", "Brand#1", 199001, None)])
cohort("invalid_month_ends", who(f"IN {held('brand', 'Brand#4', months=(199601, 199612))}"), event_all=[("brand", "Brand#4", 199600, 199699)])
cohort("bare_star_unresolved", "SELECT 1 WHERE false", counted=True, event_all=[("brand", "*")])
cohort("inner_star_literal", "SELECT 1 WHERE false", counted=True, event_all=[("brand", "Brand*1")])
cohort("attr_star_literal", "SELECT 1 WHERE false", counted=True, attr_all=[("segment", "BUILD*")])
cohort("crosswalk_exact", who(f"IN {held('ptype', 'PROMO', months=(199701, 199702))}"), event_all=[("ptype", "promo-all", 199701, 199702)])
cohort("crosswalk_many", who(f"IN {held('ptype', 'SMALL', 'MEDIUM', 'LARGE', months=(199801, 199801))}"), event_all=[("ptype", "sized", 199801, 199801)])
cohort("crosswalk_not_for_wildcards", "SELECT 1 WHERE false", counted=True, event_all=[("ptype", "promo-all*")])


def _request(request: dict, kind: str, once: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = orders_engine(spark, sf_dir, once).query(QueryRequest.of(**request), count_only=False, profile=True)
        return {"count": result.count, "patients": result.patients, "profile": result.profile}[kind]

    return run


PROFILED = {"attr_all": [BUILDING], "event_all": [("brand", "Brand#1*", 199701, 199703)], "event_any": [("ptype", "PROMO", 199801, 199812)]}
PROFILED_SQL = who(IN_BUILDING, f"IN {held('brand', 'Brand#1%', months=(199701, 199703))}", f"IN {held('ptype', 'PROMO', months=(199801, 199812))}")
_COUNTS = "name, key, count(DISTINCT person_id) AS count FROM (SELECT attr AS name, value AS key, person_id FROM facts WHERE person_id IN ({who}) AND ({which})) GROUP BY name, key"
add("cohort_count", _request(FLAGSHIP, "count"), f"SELECT count(*) AS count FROM ({FLAGSHIP_SQL})")
add("cohort_ids_guid", _request(FLAGSHIP, "patients"), f"SELECT c_custkey AS person_id, c_name AS person_guid FROM customer WHERE c_custkey IN ({FLAGSHIP_SQL})")
_ATTRS, _EVENTS = "attr IN ('segment', 'nation', 'region')", "attr = 'brand' AND starts_with(value, 'Brand#1') OR attr = 'ptype' AND value = 'PROMO'"
add("profile_full", _request(PROFILED, "profile", once=True), f"SELECT 'attribute' AS kind, {_COUNTS.format(who=PROFILED_SQL, which=_ATTRS)} UNION ALL SELECT 'event', {_COUNTS.format(who=PROFILED_SQL, which=_EVENTS)}")


def _profile_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = orders_engine(spark, sf_dir)
    return profile.profile_attributes(engine.facts, engine.cohort(QueryRequest.of(attr_all=[BUILDING])), ORDERS)


def _profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = orders_engine(spark, sf_dir)
    resolved = engine.resolve(QueryRequest.of(**PROFILED))
    return profile.profile_events(engine.facts, engine.cohort(QueryRequest.of(**PROFILED)), resolved.included)


def _profile_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.nested(_profile_attributes(spark, sf_dir))
    return rows.select("kind", "name", F.size("values").cast("long").alias("keys"), F.col("values")[0]["key"].alias("first_key"), F.col("values")[0]["count"].alias("first_count"))


add("profile_attributes", _profile_attributes, f"SELECT 'attribute' AS kind, {_COUNTS.format(who=who(IN_BUILDING), which=_ATTRS)}")
add("profile_events_timeless", _profile_events, f"SELECT 'event' AS kind, {_COUNTS.format(who=PROFILED_SQL, which=_EVENTS)}")
add("profile_nested", _profile_nested, f"""SELECT 'attribute' AS kind, name, count(*) AS keys, arg_min(key, (-count, key)) AS first_key, max(count) AS first_count
    FROM (SELECT {_COUNTS.format(who=who(IN_BUILDING), which=_ATTRS)}) GROUP BY name""")
add("index_stats", lambda spark, sf_dir: orders_engine(spark, sf_dir, once=True).stats(), """SELECT (SELECT count(*) FROM customer) AS patient_count,
    (SELECT count(*) FROM (SELECT DISTINCT attr, value, person_id FROM facts)) + (SELECT count(*) FROM (SELECT DISTINCT attr, value, yyyymm, person_id FROM facts WHERE yyyymm IS NOT NULL)) AS fact_count""")
add("posting_cardinality", lambda spark, sf_dir: profile.value_cardinality(order_facts(spark, sf_dir, once=True)), "SELECT attr, value, count(DISTINCT person_id) AS n_persons FROM facts GROUP BY attr, value")
add("month_cardinality", lambda spark, sf_dir: profile.month_cardinality(order_facts(spark, sf_dir, once=True)), "SELECT attr, value, yyyymm, count(DISTINCT person_id) AS n_persons FROM facts WHERE yyyymm IS NOT NULL GROUP BY attr, value, yyyymm")
add("facts_value_postings", lambda spark, sf_dir: order_facts(spark, sf_dir, once=True).select("attr", "value", "person_id").distinct(), "SELECT DISTINCT attr, value, person_id FROM facts")
add("facts_month_postings", lambda spark, sf_dir: order_facts(spark, sf_dir, once=True).filter("yyyymm IS NOT NULL").select("attr", "value", "yyyymm", "person_id").distinct(), "SELECT DISTINCT attr, value, yyyymm, person_id FROM facts WHERE yyyymm IS NOT NULL")


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = facts_of(table(spark, sf_dir, "orders"), F.col("o_custkey"), "priority", F.col("o_orderpriority"), year_of(F.col("o_orderdate")))
    return facts.withColumnRenamed("yyyymm", "year").groupBy("attr", "value", "year").agg(F.countDistinct("person_id").alias("n_persons"))


add("yearly_buckets", _yearly, "SELECT 'priority' AS attr, o_orderpriority AS value, CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS n_persons FROM orders GROUP BY o_orderpriority, CAST(year(o_orderdate) AS INTEGER)")


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many persons each month lies between the first and the last order of."""
    month = yyyymm(F.col("o_orderdate"))
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(month).alias("start"), F.max(month).alias("end"))
    return spans.select(F.explode(month_list(F.col("start"), F.col("end"))).alias("yyyymm")).groupBy("yyyymm").agg(F.count("*").alias("n_persons"))


add("month_expansion", _months, """WITH spans AS (SELECT o_custkey, min(year(o_orderdate) * 100 + month(o_orderdate)) AS start, max(year(o_orderdate) * 100 + month(o_orderdate)) AS last FROM orders GROUP BY o_custkey),
    months AS (SELECT m FROM (SELECT unnest(range(190001, 210013)) AS m) WHERE m % 100 BETWEEN 1 AND 12)
    SELECT CAST(m AS INTEGER) AS yyyymm, count(*) AS n_persons FROM spans JOIN months ON m BETWEEN start AND last GROUP BY m""")


def overload(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda spark, sf_dir: run(order_facts(spark, sf_dir)), sql)


B1, B2, PROMO = ("brand", "Brand#1"), ("brand", "Brand#2"), ("ptype", "PROMO")
MAY, JUNE = ("brand", "Brand#1", 199705), ("ptype", "PROMO", 199706)
_in = lambda x: f"IN {held(*x[:2], months=x[2:] * 2 or None)}"
_either = lambda *xs: "(" + " OR ".join(f"person_id {_in(x)}" for x in xs) + ")"
_not = lambda x: f"NOT {_in(x)}"
overload("legacy_all_of", lambda f: setops.query_all(f, [BUILDING, B1]), who(_in(BUILDING), _in(B1)))
overload("legacy_all_of_in_years", lambda f: setops.query_all(f, [BUILDING], [MAY]), who(_in(BUILDING), _in(MAY)))
overload("legacy_any_and_in_years_minus", lambda f: setops.query_any(f, [B1, B2], [BUILDING], [JUNE], [ASIA]), who(_either(B1, B2), _in(BUILDING), _in(JUNE), _not(ASIA)))
overload("legacy_any_in_years", lambda f: setops.query_any_bucket(f, [MAY, JUNE], [BUILDING], [ASIA]), who(_either(MAY, JUNE), _in(BUILDING), _not(ASIA)))
overload("legacy_all_of_minus", lambda f: setops.query_all(f, [BUILDING, B1], minus=[ASIA, B2]), who(_in(BUILDING), _in(B1), _not(ASIA), _not(B2)))
overload("legacy_any_of_minus", lambda f: setops.query_any(f, [BUILDING, ASIA], minus=[B1]), who(_either(BUILDING, ASIA), _not(B1)))
overload("legacy_nine_arg", lambda f: setops.query_widening(f, [BUILDING, MAY], [ASIA, JUNE], [B2]), who("((person_id " + _in(BUILDING) + " AND person_id " + _in(MAY) + ") OR " + _either(ASIA, JUNE) + ")", _not(B2)))
overload("set_union", lambda f: setops.union_ids(setops.holders(f, [BUILDING]), setops.holders(f, [MAY])), who(_either(BUILDING, MAY)))
overload("set_intersect", lambda f: setops.intersect_ids(setops.holders(f, [BUILDING]), setops.holders(f, [B1]), setops.holders(f, [ASIA])), who(_in(BUILDING), _in(B1), _in(ASIA)))
overload("set_subtract", lambda f: setops.subtract_ids(setops.holders(f, [BUILDING]), setops.holders(f, [MAY]), setops.holders(f, [ASIA])), who(_in(BUILDING), _not(MAY), _not(ASIA)))
overload("set_values_union", lambda f: setops.holders(f, [B1, B2, ASIA]), who(_either(B1, B2, ASIA)))
overload("set_months_union", lambda f: setops.holders(f, [MAY, JUNE]), who(_either(MAY, JUNE)))
_bits = lambda f, item: bitmap.to_bitmaps(setops.holders(f, [item]))
overload("bitmap_and", lambda f: bitmap.count_bitmaps(bitmap.and_bitmaps(_bits(f, BUILDING), _bits(f, ASIA))), f"SELECT count(*) AS count FROM ({who(_in(BUILDING), _in(ASIA))})")
overload("bitmap_and_not", lambda f: bitmap.count_bitmaps(bitmap.subtract_bitmaps(_bits(f, BUILDING), _bits(f, ASIA))), f"SELECT count(*) AS count FROM ({who(_in(BUILDING), _not(ASIA))})")
overload("bitmap_or", lambda f: bitmap.count_bitmaps(bitmap.or_bitmaps(_bits(f, BUILDING), _bits(f, ASIA))), f"SELECT count(*) AS count FROM ({who(_either(BUILDING, ASIA))})")
add("bitmap_count_by_key", lambda spark, sf_dir: bitmap.count_bitmaps(bitmap.to_bitmaps(order_facts(spark, sf_dir, once=True), "attr", "value"), "attr", "value"), "SELECT attr, value, CAST(count(DISTINCT person_id) AS BIGINT) AS count FROM facts GROUP BY attr, value")


def searched(name: str, event_type: str, keyword: str, mode: str, limit: int = 20, offset: int = 0) -> None:
    """Tiers as the search documents them, in SQL."""
    key = keyword.lower()
    tier = lambda column, first: f"CASE WHEN starts_with(lower({column}), '{key}') THEN {first} " + (f"WHEN contains(lower({column}), '{key}') THEN {first + 1} " if mode == search.CONTAINS else "") + "END"
    found = f"SELECT value, {tier('value', 0)} AS tier FROM (SELECT DISTINCT value FROM facts WHERE attr = '{event_type}')"
    if event_type == ORDERS.crosswalk_event:
        pairs = ", ".join(f"('{s}', '{t}')" for s, targets in ORDERS_CROSSWALK.items() for t in targets)
        walk = f"(SELECT * FROM (VALUES {pairs}) AS x(source, target) WHERE {tier('source', 2)} IS NOT NULL)"
        found += f" UNION ALL SELECT source, {tier('source', 2)} FROM {walk} UNION ALL SELECT target, {tier('target', 4)} FROM {walk}"
    sql = f"""SELECT value, CAST(row_number() OVER (ORDER BY tier, value) - 1 AS INTEGER) AS position, count(*) OVER () AS total
        FROM (SELECT value, min(tier) AS tier FROM ({found}) WHERE tier IS NOT NULL GROUP BY value)"""
    add(name, lambda spark, sf_dir: orders_engine(spark, sf_dir).search(event_type, keyword, mode, limit, offset), f"SELECT * FROM ({sql}) WHERE position >= {max(0, offset)} AND position < {max(0, offset) + max(1, min(limit, 100))}")


searched("search_prefix", "brand", "brand#1", search.PREFIX)
searched("search_contains", "ptype", "o", search.CONTAINS)
searched("search_medication_merge", "ptype", "m", search.CONTAINS)
searched("search_page_total", "brand", "BRAND", search.CONTAINS, limit=7, offset=5)
searched("search_limit_clamped", "brand", "brand#2", search.PREFIX, limit=0, offset=-3)
add("values_listing", lambda spark, sf_dir: orders_engine(spark, sf_dir).values("nation"), "SELECT DISTINCT value FROM facts WHERE attr = 'nation'")
add("values_unknown_attr", lambda spark, sf_dir: orders_engine(spark, sf_dir).values("shoe").agg(F.count("*").alias("count")), "SELECT CAST(0 AS BIGINT) AS count")


def _names(kind: str) -> Query:
    """The model's names that the data set has values of, in the model's order, and how many."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = orders_engine(spark, sf_dir, once=True)
        names = F.array(*map(F.lit, getattr(engine.model, kind)))
        known = engine.facts.groupBy("attr").agg(F.countDistinct("value").alias("n_values"))
        return known.select((F.array_position(names, F.col("attr")) - 1).cast("int").alias("position"), F.col("attr").alias("name"), "n_values").filter("position >= 0").orderBy("position")

    return run


_LISTING = "SELECT CAST(i AS INTEGER) AS position, name, count(DISTINCT value) AS n_values FROM facts JOIN (VALUES {}) AS x(i, name) ON attr = name GROUP BY i, name"
add("attributes_listing", _names("attributes"), _LISTING.format("(0, 'segment'), (1, 'nation'), (2, 'region')"))
add("event_types_listing", _names("event_types"), _LISTING.format("(0, 'brand'), (1, 'ptype'), (2, 'priority')"))
add("persons_guid_lookup", lambda spark, sf_dir: orders_engine(spark, sf_dir).persons.filter(F.col("person_guid").endswith("7")), "SELECT c_custkey AS person_id, c_name AS person_guid FROM customer WHERE ends_with(c_name, '7')")
add("persons_guid_lookup_all", lambda spark, sf_dir: orders_engine(spark, sf_dir).persons, "SELECT c_custkey AS person_id, c_name AS person_guid FROM customer")
add("clickstream_any_of", lambda spark, sf_dir: clicks_engine(spark, sf_dir).cohort(QueryRequest.of(event_any=[("event_type", "purch*", 202401, 202401), ("event_type", "view", 202402, 202403)], event_exclude=[("event_type", "err*", 202402, 202412)])), "WITH e AS (SELECT user_id, event_type, year(ts) * 100 + month(ts) AS m FROM events) SELECT DISTINCT user_id AS person_id FROM e WHERE (starts_with(event_type, 'purch') AND m = 202401 OR event_type = 'view' AND m BETWEEN 202402 AND 202403) AND user_id NOT IN (SELECT user_id FROM e WHERE starts_with(event_type, 'err') AND m BETWEEN 202402 AND 202412)")
add("clickstream_no_attributes", lambda spark, sf_dir: profile.cohort_count(clicks_engine(spark, sf_dir).cohort(QueryRequest.of(attr_all=[("gender", "Male")], event_all=[("event_type", "click")]))), "SELECT CAST(0 AS BIGINT) AS count")
add("corpus_labels", lambda spark, sf_dir: corpus_engine(spark, sf_dir).cohort(QueryRequest.of(attr_all=[("lang", "en"), ("quality", "1")], attr_exclude=[("toxic", "1")])), "WITH l AS (SELECT * FROM labels) SELECT DISTINCT doc_id AS person_id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM l WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM l WHERE toxic = 1)")


def _written(spark: SparkSession, sf_dir: str, use: Callable[[str], DataFrame]) -> DataFrame:
    """What ``use`` gives for the path of the orders' saved index."""
    path = new_place(spark, "index")
    orders_engine(spark, sf_dir, dealt=True).save(path, dealt=True)
    return use(path)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of an index that was saved, loaded, and saved over itself."""

    def use(path: str) -> DataFrame:
        CohortEngine.load(spark, ORDERS, path).save(path)
        return CohortEngine.load(spark, ORDERS, path).facts.select("person_id", "attr", "value", "yyyymm")

    return _written(spark, sf_dir, use)


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds a code of the index and one that came with facts appended to it."""
    clicks = facts_of(table(spark, sf_dir, "events"), F.col("user_id"), "priority", F.concat(F.lit("saw-"), F.col("event_type")), yyyymm(F.col("ts")))

    def use(path: str) -> DataFrame:
        append_to_index(clicks.distinct(), path)
        return CohortEngine.load(spark, ORDERS, path).cohort(QueryRequest.of(attr_all=[BUILDING], event_all=[("priority", "saw-purchase")]))

    return _written(spark, sf_dir, use)


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, lambda path: CohortEngine.load(spark, ORDERS, path).words)


def _crosswalk_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a header behind an empty line, of nations and their regions, read back."""
    pairs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = pairs.agg(F.array_sort(F.collect_list(F.concat(F.lit(' "'), "n_name", F.lit('"\t,'), "r_name", F.lit(" ")))).alias("lines"))
    path = new_place(spark, "walk")
    lines.select(F.concat(F.lit("\nRXNORM_Code,target\r\n"), F.array_join("lines", "\n")).alias("value")).coalesce(1).write.text(path)
    return read_crosswalk(spark, path).select("source", "target")


def _indexed(use: Callable[[CohortEngine], DataFrame], **options) -> Query:
    """What ``use`` gives for the engine of an index."""
    return lambda spark, sf_dir: _written(spark, sf_dir, lambda path: use(CohortEngine.load(spark, ORDERS, path, crosswalk=crosswalk_of(spark, ORDERS_CROSSWALK), **options)))


def _append_twice(spark: SparkSession, path: str, sf_dir: str) -> None:
    """Facts that the index has already and some that it hasn't, in two goes."""
    clicks = facts_of(table(spark, sf_dir, "events"), F.col("user_id"), "priority", F.concat(F.lit("saw-"), F.col("event_type")), yyyymm(F.col("ts")))
    append_to_index(clicks, path)
    append_to_index(clicks.unionByName(order_facts(spark, sf_dir).filter("attr = 'priority'")), path)


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of an index after two appends and a compaction; each is there once."""

    def use(path: str) -> DataFrame:
        _append_twice(spark, path, sf_dir)
        compact_index(spark, path)
        return CohortEngine.load(spark, ORDERS, path).facts.filter("attr IN ('priority', 'segment')").select("person_id", "attr", "value", "yyyymm")

    return _written(spark, sf_dir, use)


def _appended_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    def use(path: str) -> DataFrame:
        _append_twice(spark, path, sf_dir)
        return CohortEngine.load(spark, ORDERS, path).words

    return _written(spark, sf_dir, use)


_SAW = "SELECT user_id AS person_id, 'priority' AS attr, 'saw-' || event_type AS value, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS yyyymm FROM events"
_PROFILES = f"SELECT 'attribute' AS kind, {_COUNTS.format(who=PROFILED_SQL, which=_ATTRS)} UNION ALL SELECT 'event', {_COUNTS.format(who=PROFILED_SQL, which=_EVENTS)}"
add("cohort_flagship_bitmap", _indexed(lambda e: e.cohort(QueryRequest.of(**FLAGSHIP)), planner=BITMAP), FLAGSHIP_SQL)
add("cohort_count_bitmap", _indexed(lambda e: e.query(QueryRequest.of(**FLAGSHIP)).count, planner=BITMAP), f"SELECT count(*) AS count FROM ({FLAGSHIP_SQL})")
add("profile_bitmap", _indexed(lambda e: e.query(QueryRequest.of(**PROFILED), profile=True).profile, planner=BITMAP), _PROFILES)
add("index_stats_bitmap", _indexed(lambda e: e.stats()), SQL["index_stats"])
add("cohort_by_cost", _indexed(lambda e: e.cohort(QueryRequest.of(**PROFILED))), PROFILED_SQL)
add("append_compact_query", _compacted, f"SELECT DISTINCT person_id, attr, value, yyyymm FROM (SELECT * FROM facts WHERE attr IN ('priority', 'segment') UNION ALL {_SAW})")
add("vocabulary_after_append", _appended_words, f"SELECT attr, value, count(DISTINCT person_id) AS n_persons FROM (SELECT * FROM facts UNION ALL {_SAW}) GROUP BY attr, value")
def _by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over facts dealt by person; the table goes with the session or the driver."""
    name = f"dealt_{uuid.uuid4().hex}"
    engine = orders_engine(spark, sf_dir, once=True, planner=ONE_PASS)
    deal_by_person(engine.facts, name)
    atexit.register(lambda: spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped() or spark.sql(f"DROP TABLE IF EXISTS {name}"))
    return dealt_engine(spark, ORDERS, name, engine.persons, planner=ONE_PASS).cohort(QueryRequest.of(**FLAGSHIP))


def _in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort by name, set algebra over the table function, and a view of the facts, in one text of SQL."""
    views = CohortSql(orders_engine(spark, sf_dir), prefix="orders_")
    views.define("asians", QueryRequest.of(attr_all=[ASIA]))
    return views.sql("""
        SELECT f.value AS nation, count(DISTINCT f.person_id) AS n_persons FROM orders_facts AS f
        WHERE f.attr = 'nation' AND f.person_id IN (
          SELECT person_id FROM orders_asians INTERSECT SELECT person_id FROM orders_holders('brand', 'Brand#1*', 199701, 199706)
          EXCEPT SELECT person_id FROM orders_holders('segment', 'BUILDING'))
        GROUP BY f.value""")


def _written_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's patients, written as lines of JSON by the executors and read again."""
    path = new_place(spark, "patients")
    orders_engine(spark, sf_dir).write_patients(QueryRequest.of(**FLAGSHIP), path)
    return spark.read.schema("person_id long, person_guid string").json(path)


_PATIENTS = f"SELECT c_custkey AS person_id, c_name AS person_guid FROM customer WHERE c_custkey IN ({FLAGSHIP_SQL})"
add("cohort_by_person", _by_person, FLAGSHIP_SQL)
add("cohort_in_sql", _in_sql, f"""SELECT value AS nation, count(DISTINCT person_id) AS n_persons FROM facts WHERE attr = 'nation' AND person_id IN (
    {who(_in(ASIA), f"IN {held('brand', 'Brand#1%', months=(199701, 199706))}", _not(BUILDING))}) GROUP BY value""")
add("patients_page", lambda spark, sf_dir: orders_engine(spark, sf_dir).patients_page(QueryRequest.of(attr_all=[BUILDING]), after=40, limit=25), f"SELECT c_custkey AS person_id, c_name AS person_guid FROM customer WHERE c_custkey {IN_BUILDING} AND c_custkey > 40 ORDER BY c_custkey LIMIT 25")
add("patients_written", _written_patients, _PATIENTS)
for _name, _search in {"search_prefix": ("brand", "brand#1", search.PREFIX), "search_contains": ("ptype", "o", search.CONTAINS), "search_medication_merge": ("ptype", "m", search.CONTAINS), "search_page_total": ("brand", "BRAND", search.CONTAINS, 7, 5)}.items():
    add(f"{_name}_by_grams", _indexed(lambda e, of=_search: e.search(*of)), SQL[_name])
add("index_round_trip", _round_trip, "SELECT DISTINCT person_id, attr, value, yyyymm FROM facts")
add("append_then_query", _appended, who(_in(BUILDING), "IN (SELECT user_id FROM events WHERE event_type = 'purchase')"))
add("index_vocabulary", _vocabulary, "SELECT attr, value, count(DISTINCT person_id) AS n_persons FROM facts GROUP BY attr, value")
add("crosswalk_file", _crosswalk_file, "SELECT n_name AS source, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
add("guids_of_cohort", lambda spark, sf_dir: (e := orders_engine(spark, sf_dir)).person_guids(e.cohort(QueryRequest.of(attr_all=[BUILDING]))), f"SELECT c_custkey AS person_id, c_name AS person_guid FROM customer WHERE c_custkey {IN_BUILDING}")
add("persons_of_guids", lambda spark, sf_dir: orders_engine(spark, sf_dir).person_ids(table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("person_guid"))), "SELECT c_custkey AS person_id, c_name AS person_guid FROM customer WHERE c_mktsegment = 'BUILDING'")
add("code_normaliser", lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", normalised_code(F.col("p_type")).alias("code")), "SELECT p_partkey, regexp_replace(p_type, '[xX]', '*', 'g') AS code FROM part")
