"""The index: planners over its blocks, costs, appends, compaction, leases."""

import random
import re

import pytest
from test_cohort import FACT_ROWS, MODEL, WALK, model, some_request

from mustra.engine import CohortEngine
from mustra.operators import bitmap, setops
from mustra.plans import planner
from mustra.plans.planner import BITMAP, JOINS, ONE_PASS
from mustra.plans.resolve import LENIENT, STRICT
from mustra.queries import QUERIES
from mustra.request import QueryRequest
from mustra.sources.crosswalk import crosswalk_of
from mustra.sources.facts import FACTS, IndexConflictError, _add_snapshot, _current, append_to_index, compact_index, lease, open_index, remove_orphans, save_index

PERSONS = "person_id long, person_guid string"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("index") / "index")
    facts = spark.createDataFrame(FACT_ROWS, FACTS)
    save_index(facts.unionByName(facts.limit(9)), spark.createDataFrame([(i, f"g{i}") for i in range(1, 41)], PERSONS), place)
    return place


@pytest.fixture
def engine(spark, path):
    return CohortEngine.load(spark, MODEL, path, crosswalk=crosswalk_of(spark, WALK))


def ids(engine, request, semantics, how):
    engine.semantics, engine.planner = semantics, how
    out = [r.person_id for r in engine.cohort(request).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_all_planners_give_the_models_ids(engine):
    rng = random.Random(21)
    for i in range(16):
        request, semantics = some_request(rng), (LENIENT, STRICT)[i % 2]
        want = model(request, semantics)
        assert ids(engine, request, semantics, BITMAP) == want, request
        assert ids(engine, request, semantics, planner.AUTO) == want, request
        engine.planner = BITMAP
        assert engine.query(request).count.first()["count"] == len(want)


def test_bitmap_plans_read_no_facts(engine):
    engine.semantics, engine.planner = LENIENT, BITMAP
    request = QueryRequest.of(attr_all=[("sex", "F")], event_any=[("dx", "a*", 202012, 202101)], event_exclude=[("rx", "r1")])
    result = engine.query(request, count_only=False, profile=True)
    for frame in (result.count, result.profile, engine.stats()):
        read = frame._jdf.queryExecution().executedPlan().toString()
        assert "bitmap:binary" in read and "person_id:bigint" not in read and "Python" not in read and "Cartesian" not in read
    assert re.search(r"PartitionFilters: \[\(*attr", result.count._jdf.queryExecution().executedPlan().toString())


def test_profiles_and_statistics_agree_with_those_of_facts(engine):
    rng = random.Random(5)
    plain = CohortEngine(MODEL, engine.facts, engine.persons, crosswalk=engine.crosswalk)
    seen = 0
    for _ in range(5):
        request = some_request(rng)
        out = {}
        for how, of in ((BITMAP, engine), (ONE_PASS, plain), (JOINS, plain)):
            of.semantics, of.planner = LENIENT, how
            out[how] = of.query(request, count_only=False, profile=True).to_dict()
        assert out[BITMAP] == out[ONE_PASS] == out[JOINS]
        seen += out[BITMAP]["count"] > 0
    assert seen and [tuple(r) for r in engine.stats().collect()] == [tuple(r) for r in plain.stats().collect()]


def test_ids_of_any_size_come_back(spark):
    every = [-100_000, -32_769, -32_768, -32_767, -2, -1, 0, 1, 7, 8, 32_766, 32_767, 32_768, 65_535, 65_536, 10**15]
    bits = bitmap.to_bitmaps(spark.createDataFrame([(i,) for i in every], "person_id long"))
    assert sorted(r.person_id for r in bitmap.ids_of(bits).collect()) == every
    some = bitmap.to_bitmaps(spark.createDataFrame([(i,) for i in every[::2] + [5]], "person_id long"))
    assert sorted(r.person_id for r in bitmap.ids_of(bitmap.subtract_bitmaps(bits, some)).collect()) == every[1::2]
    assert bitmap.count_bitmaps(bitmap.and_bitmaps(bits, some)).first()["count"] == len(every[::2])


def test_blocks_are_built_without_sorting_facts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(rng.randrange(-70_000, 70_000), "dx", rng.choice("ab"), None) for _ in range(3000)] + [(i, "dx", "c", None) for i in range(2100)]
    facts = spark.createDataFrame(rows, FACTS)
    place = F.col("person_id") + 1
    plain = facts.groupBy("value", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    made = bitmap.to_bitmaps(facts, "value")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))
    before_the_first_shuffle = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].rsplit("Exchange", 1)[1]
    assert "HashAggregate" in before_the_first_shuffle and "Sort" not in before_the_first_shuffle
    dealt = bitmap.blocks_of_parts(bitmap.to_parts(facts, "value", scattered=True), "value")
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_the_smallest_clause_comes_first_and_is_broadcast(spark, tmp_path):
    rows = [(i, "sex", "FM"[i % 2], None) for i in range(4000)] + [(i, "dx", "rare" if i % 100 == 0 else "often", 202001) for i in range(4000)]
    save_index(spark.createDataFrame(rows, FACTS), spark.createDataFrame([(1, "g")], PERSONS), str(tmp_path / "i"))
    engine = CohortEngine.load(spark, MODEL, str(tmp_path / "i"))
    request = QueryRequest.of(attr_all=[("sex", "F")], event_all=[("dx", "rare")], event_any=[("dx", "often*"), ("dx", "rare")], attr_exclude=[("sex", "M")])
    resolved = engine.resolve(request)
    assert planner.estimates(planner.positive_clauses(resolved), engine.words) == [2000, 40]
    assert planner.choose(resolved, engine.words, None) == (JOINS, [2000, 40, 4000])
    plan = planner.plan(resolved, engine.facts, words=engine.words)
    assert sorted(r.person_id for r in plan.collect()) == list(range(0, 4000, 100))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in text and text.rindex("rare") > text.rindex("value#") - 4000
    many = QueryRequest.of(attr_all=[("sex", "F")], event_all=[("dx", "often")], attr_any=[("sex", "F")])
    assert planner.choose(engine.resolve(many), engine.words, None)[0] == ONE_PASS
    before, planner.BITMAP_FROM = planner.BITMAP_FROM, 1000
    try:
        assert planner.choose(engine.resolve(many), engine.words, engine.blocks)[0] == BITMAP
        assert {r.person_id for r in engine.cohort(many).collect()} == {i for i in range(0, 4000, 2) if i % 100}
    finally:
        planner.BITMAP_FROM = before


def facts_in(spark, path):
    return sorted(map(tuple, open_index(spark, path).facts.select("person_id", "attr", "value", "yyyymm").collect()), key=repr)


def counts_in(spark, path):
    return {(r.attr, r.value): r.n_persons for r in open_index(spark, path).words.collect()}


def counted(rows):
    return {(a, v): len({p for p, b, w, _ in rows if (a, v) == (b, w)}) for _, a, v, _ in rows}


def test_appends_and_compaction(spark, tmp_path):
    path, rows = str(tmp_path / "index"), set(FACT_ROWS)
    save_index(spark.createDataFrame(FACT_ROWS, FACTS), spark.createDataFrame([(i, f"g{i}") for i in range(1, 41)], PERSONS), path)
    first = open_index(spark, path)
    known = next(r for r in FACT_ROWS if r[1] == "dx")
    for more in ([known, (1, "dx", "new", 202105), (2, "dx", "new", None)], [(1, "dx", "new", 202106), (50_000, "rx", "r1", 202101), known], [(1, "sex", "F", None)]):
        append_to_index(spark.createDataFrame(more, FACTS), path)
        rows |= set(more)
        assert counts_in(spark, path) == counted(rows) and {x for x in facts_in(spark, path)} == rows
    assert len(facts_in(spark, path)) > len(rows)
    engine = CohortEngine.load(spark, MODEL, path)
    request = QueryRequest.of(event_all=[("dx", "new", 202106, 202106)], attr_any=[("sex", "F"), ("sex", "M")])
    assert ids(engine, request, LENIENT, BITMAP) == ids(engine, request, LENIENT, ONE_PASS) == {1}
    months = len({(p, a, v, m) for p, a, v, m in rows if m}) + len({(p, a, v) for p, a, v, _ in rows})
    assert engine.stats().first().fact_count == months
    assert compact_index(spark, path) == ["dx", "rx", "sex"]
    assert facts_in(spark, path) == sorted(rows, key=repr) and counts_in(spark, path) == counted(rows)
    engine = CohortEngine.load(spark, MODEL, path)
    assert ids(engine, request, LENIENT, BITMAP) == {1} and engine.stats().first().fact_count == months
    # state wasn't touched: its facts are where the save put them, and who opened the save can still read it
    assert any(p.attrs == ["state"] for p in _current(spark, path)[0].parts) and first.facts.count() == len(FACT_ROWS)
    assert compact_index(spark, path) == []


def test_an_index_saved_again_shuffles_parts_of_bitmaps_not_facts(spark, tmp_path, stages):
    path = str(tmp_path / "index")
    every = spark.range(40_000)
    facts = every.selectExpr("id AS person_id", "'dx' AS attr", "'a' || id % 3 AS value", "CAST(202001 + id % 2 AS int) AS yyyymm").union(every.selectExpr("id - 9", "'sex'", "'F'", "CAST(NULL AS int)"))
    save_index(facts.union(facts), spark.createDataFrame([(1, "g")], PERSONS), path)
    shuffled = [b for _, b in stages(lambda: CohortEngine.load(spark, MODEL, path).save(path))]
    assert 0 < max(shuffled) < 100_000, shuffled
    found = open_index(spark, path)
    assert found.facts.select(*facts.columns).exceptAll(facts).isEmpty() and facts.exceptAll(found.facts.select(*facts.columns)).isEmpty()
    assert counts_in(spark, path) == {("dx", "a0"): 13_334, ("dx", "a1"): 13_333, ("dx", "a2"): 13_333, ("sex", "F"): 40_000}
    assert all(sorted(f.name for f in d.iterdir()) == ["blocks", "facts", "grams", "persons", "vocabulary"] for d in (tmp_path / "index").glob("data-*"))
    for name in found.facts.inputFiles():
        values = [r.value for r in spark.read.parquet(name).select("value").collect()]
        assert values == sorted(values)


def test_an_append_shuffles_parts_of_bitmaps_not_facts(spark, tmp_path, stages):
    path = str(tmp_path / "index")
    save_index(spark.createDataFrame([(7, "rx", "r1", 202001)], FACTS), spark.createDataFrame([(1, "g")], PERSONS), path)
    more = spark.range(40_000).selectExpr("id AS person_id", "'rx' AS attr", "'r' || id % 2 AS value", "202001 AS yyyymm")
    shuffled = [b for _, b in stages(lambda: append_to_index(more.union(more), path))]
    assert 0 < max(shuffled) < 100_000, shuffled
    assert counts_in(spark, path) == {("rx", "r0"): 20_000, ("rx", "r1"): 20_000} and open_index(spark, path).facts.count() == 40_001


def test_saving_orders_shuffles_rows_not_their_facts(spark, sf_dir, tmp_path):
    from mustra.queries import _written

    store, java = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    every = lambda: {s.stageId(): s.shuffleWriteRecords() for s in java.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(java.double, 0), None))}
    before = every()
    facts = _written(spark, sf_dir, lambda path: open_index(spark, path).facts)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    shuffled, rows = max(n for k, n in every().items() if k not in before), spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert 0 < shuffled <= rows < facts.count()


def test_dealt_rows_make_the_same_facts(spark, tmp_path):
    from pyspark.sql import functions as F

    from mustra.sources.datasets import order_facts

    rng, path = random.Random(8), str(tmp_path)
    some = lambda *xs: rng.choice((*xs, None))
    tables = {
        "customer": ([(i, f"c{i}", some(0, 1), some("A", "B")) for i in range(-3, 90)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "N", 0), (1, None, 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "orders": ([(i, some(7, 7, 7, -3, 40_000, rng.randrange(90)), f"199{rng.randrange(5, 7)}-0{rng.randrange(1, 9)}-03 00:00:00" if i % 9 else None, some("1-HIGH", "5-LOW")) for i in range(300)], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string"),
        "part": ([(i, some("b1", "b2"), some("t1", "t2")) for i in range(20)], "p_partkey long, p_brand string, p_type string"),
        "lineitem": ([(some(rng.randrange(310)), some(rng.randrange(22))) for _ in range(1500)], "l_orderkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables.items():
        frame = spark.createDataFrame(rows, schema)
        (frame.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")) if name == "orders" else frame).write.parquet(f"{path}/{name}.parquet")
    plain, dealt = order_facts(spark, path, once=True), order_facts(spark, path, dealt=True)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, dealt.collect()))
    save_index(dealt, spark.createDataFrame([(1, "g")], PERSONS), f"{path}/index", scattered=False)
    assert facts_in(spark, f"{path}/index") == sorted(map(tuple, plain.distinct().collect()), key=repr)


def test_old_folders_go_unless_leased_and_orphans_too(spark, tmp_path):
    path = str(tmp_path / "index")
    facts, persons = spark.createDataFrame(FACT_ROWS[:20], FACTS), spark.createDataFrame([(1, "g")], PERSONS)
    save_index(facts, persons, path)
    held = open_index(spark, path)
    assert lease(spark, path, 3600) == 1
    for _ in range(3):
        save_index(facts, persons, path)
    assert held.facts.count() == len(set(FACT_ROWS[:20])) and len(list((tmp_path / "index").glob("data-*"))) == 3
    (tmp_path / "index" / "data-lost").mkdir()
    assert remove_orphans(spark, path) == [] and remove_orphans(spark, path, -60) == ["data-lost"]
    assert open_index(spark, path).facts.count() == len(set(FACT_ROWS[:20]))


def test_of_two_writers_one_is_told(spark, tmp_path):
    path = str(tmp_path / "index")
    save_index(spark.createDataFrame(FACT_ROWS[:9], FACTS), spark.createDataFrame([(1, "g")], PERSONS), path)
    before = _current(spark, path)
    append_to_index(spark.createDataFrame(FACT_ROWS[9:12], FACTS), path)
    with pytest.raises(IndexConflictError):
        _add_snapshot(spark, path, before, "data-x", [("data-x", None)], sealed=True)


def test_line_items_are_read_once_or_twice(spark, sf_dir, stages):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name, most in (("profile_full", 2), ("event_all_of_two", 2), ("index_stats", 1), ("bitmap_count_by_key", 1), ("legacy_all_of", 1), ("legacy_nine_arg", 2)):
        found = stages(lambda n=name: QUERIES[n](spark, sf_dir).collect())
        assert 1 <= sum(read // rows for read, _ in found) <= most, name


def test_overloads_equal_set_algebra(spark):
    facts = spark.createDataFrame(FACT_ROWS, FACTS)
    rng = random.Random(6)
    items = sorted({(a, v) for _, a, v, _ in FACT_ROWS}) + sorted({(a, v, m) for _, a, v, m in FACT_ROWS if m})
    holds = lambda x: {p for p, a, v, m in FACT_ROWS if (a, v) == tuple(x[:2]) and (len(x) < 3 or m == x[2])}
    union = lambda xs: set().union(*map(holds, xs))
    both = lambda xs: set.intersection(*map(holds, xs)) if xs else None
    got = lambda frame: {r.person_id for r in frame.collect()}
    for _ in range(4):
        a, b, c, d = ([rng.choice(items) for _ in range(rng.randrange(4))] for _ in range(4))
        assert got(setops.query_all(facts, a, b, minus=d)) == ((both(a + b) or set()) - union(d))
        sets = ([union(c)] if c else []) + [holds(x) for x in a + b]
        assert got(setops.query_any(facts, c, a, b, d)) == (set.intersection(*sets) - union(d) if sets else set())
        assert got(setops.query_any_bucket(facts, c, a, d)) == set.intersection(union(c), *map(holds, a)) - union(d)
        wide = both(a) | union(c) if a and both(a) else set() if a else union(c)
        assert got(setops.query_widening(facts, a, c, d)) == wide - union(d)


def test_searches_read_only_the_grams_of_the_keyword(engine, spark):
    plain = CohortEngine(MODEL, engine.facts, engine.persons, crosswalk=engine.crosswalk)
    for attr, keyword, mode in (("dx", "a", "prefix"), ("dx", "AB", "contains"), ("dx", "abc", "prefix"), ("dx", "bc", "contains"), ("dx", "b*c", "prefix"), ("rx", "o", "contains"), ("rx", "r", "prefix"), ("dx", "nothing", "contains"), ("dx", "", "prefix"), ("sex", "f", "prefix")):
        assert [tuple(r) for r in engine.search(attr, keyword, mode).orderBy("position").collect()] == [tuple(r) for r in plain.search(attr, keyword, mode).orderBy("position").collect()], (attr, keyword, mode)
    assert re.search(r"PushedFilters: \[[^]]*gram", engine.search("dx", "abc", "contains")._jdf.queryExecution().executedPlan().toString())


def test_a_value_of_any_length_has_its_grams(spark):
    from mustra.operators import search

    words = spark.createDataFrame([("a", "", 1), ("a", "X", 1), ("a", "xy", 1), ("a", "\U0001f600bcd", 1), ("a", "x" * 5000, 1)], "attr string, value string, n_persons long")
    index = search.grams(words).cache()
    for keyword, mode, want in (("x", "prefix", {"X", "xy", "x" * 5000}), ("y", "contains", {"xy"}), ("y", "prefix", set()), ("\U0001f600b", "prefix", {"\U0001f600bcd"}), ("xxxx", "contains", {"x" * 5000}), ("bcd", "contains", {"\U0001f600bcd"})):
        assert {r.value for r in search.candidates(index, "a", keyword, mode).collect()} == want


def test_facts_dealt_by_person_need_no_shuffle(spark, engine, tmp_path):
    from mustra.operators import profile
    from mustra.sources.bucketed import deal_by_person, dealt_engine

    deal_by_person(engine.facts, "dealt_facts", 3)
    try:
        request = QueryRequest.of(attr_all=[("sex", "F")], event_all=[("dx", "a*")], attr_exclude=[("state", "CA")])
        want = model(request, LENIENT)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for how in (ONE_PASS, JOINS):
            dealt = dealt_engine(spark, MODEL, "dealt_facts", engine.persons, planner=how)
            found = dealt.cohort(request)
            assert {r.person_id for r in found.collect()} == want
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        held = profile.profile_both(dealt.facts, found, MODEL, dealt.resolve(request).included)
        assert held._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(person_id") == 0
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    finally:
        spark.sql("DROP TABLE dealt_facts")


def test_large_results_go_by_pages_or_files(engine, spark, tmp_path):
    from mustra.engine import ResultTooLargeError

    engine.semantics, engine.planner = LENIENT, planner.AUTO
    request = QueryRequest.of(attr_any=[("sex", "F"), ("sex", "M")])
    with pytest.raises(ResultTooLargeError):
        engine.query(request, count_only=False).to_dict(most=39)
    assert len(engine.query(request, count_only=False).to_dict(most=40)["patients"]) == 40
    pages, after = [], None
    while rows := engine.patients_page(request, after, 7).collect():
        pages += [r.person_id for r in rows]
        after = pages[-1]
    assert pages == list(range(1, 41))
    engine.write_patients(request, str(tmp_path / "out"))
    assert sorted(r.person_guid for r in spark.read.json(str(tmp_path / "out")).collect()) == sorted(f"g{i}" for i in range(1, 41))


def test_a_planner_that_is_wrong_gets_its_errors_back(engine):
    engine.semantics, engine.planner = LENIENT, planner.AUTO
    seen = []

    def learns(messages, e):
        seen.append([m["content"] for m in messages])
        return [{"attributes": {"allOf": [{"attr": "shoe", "value": "9"}]}}, "no request at all", 'Here: {"events": {"allOf": [{"attr": "dx", "value": "abX"}]}}'][len(seen) - 1]

    out = engine.ask([{"role": "user", "content": "who has ab?"}], learns)
    assert [len(s) for s in seen] == [1, 3, 5] and "unknown attribute 'shoe'" in seen[1][2] and "no JSON object" in seen[2][4]
    assert out["proposedQuery"] == {"events": {"allOf": [{"attr": "dx", "value": "ab*"}]}} and out["queryResults"]["count"] == len(model(QueryRequest.of(event_all=[("dx", "ab*")]), LENIENT))
    stubborn = engine.ask([], lambda m, e: {"attributes": []}, lambda context: "never", rounds=2)
    assert stubborn["proposedQuery"] is None and "object of lists" in stubborn["content"]


def test_months_between(spark):
    from pyspark.sql import functions as F

    from mustra.functions.columns import month_list

    spans = spark.createDataFrame([(199811, 199902), (200001, 200001), (199905, 199904)], "a int, b int")
    assert [r.m for r in spans.select(month_list(F.col("a"), F.col("b")).alias("m")).collect()] == [[199811, 199812, 199901, 199902], [200001], []]


def test_a_missing_folder_is_no_index_and_other_errors_are_errors(spark, tmp_path):
    from mustra.sources.facts import IndexFormatError

    with pytest.raises(IndexFormatError):
        open_index(spark, str(tmp_path / "none"))
    (tmp_path / "bad" / "meta").mkdir(parents=True)
    (tmp_path / "bad" / "meta" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="not a Parquet file") as e:
        save_index(spark.createDataFrame(FACT_ROWS[:3], FACTS), spark.createDataFrame([(1, "g")], PERSONS), str(tmp_path / "bad"))
    assert not isinstance(e.value, IndexFormatError)
