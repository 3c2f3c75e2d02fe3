"""Random small requests against a model of the semantics over Python sets."""

import random

import pytest

from mustra.engine import CohortEngine
from mustra.model import CohortModel
from mustra.operators import setops
from mustra.plans.planner import JOINS, ONE_PASS
from mustra.plans.resolve import LENIENT, STRICT
from mustra.queries import QUERIES
from mustra.request import QueryRequest
from mustra.sources.crosswalk import crosswalk_of, read_crosswalk
from mustra.sources.facts import FACTS, IndexFormatError, append_to_index, load_index

MODEL = CohortModel(("sex", "state"), ("dx", "rx"), "rx")
FACT_COLUMNS = ("person_id", "attr", "value", "yyyymm")
WALK = {"old": ["r1", "r2"], "gone": ["zz"]}


def world():
    rng = random.Random(5)
    facts = set()
    for p in range(1, 41):
        facts.add((p, "sex", rng.choice("FM"), None))
        for _ in range(rng.randrange(3)):
            facts.add((p, "state", rng.choice(["CA", "NY", "TX"]), None))
        for _ in range(rng.randrange(6)):
            facts.add((p, rng.choice(["dx", "rx"]), rng.choice(["a", "ab", "abc", "b*c", "r1", "r2"]), rng.choice([202011, 202012, 202101, 202102])))
    return sorted(facts, key=str)


FACT_ROWS = world()


def model(request, semantics):
    known = {(a, v) for _, a, v, _ in FACT_ROWS}

    def ids(test):
        return {f[0] for f in FACT_ROWS if test(f)}

    def attr(f):
        return (lambda x: (x[1], x[2]) == (f.attr, f.value)) if (f.attr, f.value) in known else None

    def event(f):
        if f.value.endswith("*"):
            codes = {v for a, v in known if a == f.attr and len(f.value) > 1 and v.startswith(f.value[:-1])}
        else:
            mapped = WALK.get(f.value) if f.attr == "rx" and "*" not in f.value else None
            codes = {v for v in mapped or [f.value] if (f.attr, v) in known}
        both = f.start is not None and f.end is not None
        if not codes or both and f.start > f.end:
            return None
        return lambda x: x[1] == f.attr and x[2] in codes and (not both or x[3] is not None and f.start <= x[3] <= f.end)

    a, e = request.attributes, request.events
    lists = [(a.all_of, attr), (e.all_of, event), (a.any_of, attr), (e.any_of, event), (a.exclude, attr), (e.exclude, event)]
    a_all, e_all, a_any, e_any, a_no, e_no = ([t for f in fs if (t := make(f))] for fs, make in lists)
    if any(fs and not ts for (fs, _), ts in zip(lists[:4], (a_all, e_all, a_any, e_any), strict=True)):
        return set()
    if semantics == STRICT and (len(a_all) < len(a.all_of) or len(e_all) < len(e.all_of)):
        return set()
    sets = [ids(t) for t in a_all + e_all]
    if a_any:
        sets.append(set().union(*map(ids, a_any)))
    if e_any:
        found = set().union(*map(ids, e_any))
        if found or semantics == STRICT:
            sets.append(found)
    if not sets:
        return set()
    return set.intersection(*sets) - set().union(*map(ids, a_no + e_no))


def some_request(rng):
    attr = lambda: rng.choice([("sex", "F"), ("sex", "M"), ("state", "CA"), ("state", "NY"), ("state", "ZZ"), ("shoe", "9")])

    def event():
        span = rng.choice([(), (202012, 202101), (202101, 202101), (202101, 202012), (199001, 199012), (202011, None)])
        return (rng.choice(["dx", "rx"]), rng.choice(["a", "ab*", "a*", "*", "b*c", "nope", "old", "gone", "r1"]), *span)

    few = lambda make, most: [make() for _ in range(rng.choice([0] * 2 + list(range(1, most + 1))))]
    return QueryRequest.of(attr_all=few(attr, 2), attr_any=few(attr, 2), attr_exclude=few(attr, 1), event_all=few(event, 2), event_any=few(event, 2), event_exclude=few(event, 1))


@pytest.fixture(scope="module")
def engine(spark):
    facts = spark.createDataFrame(FACT_ROWS, FACTS).cache()
    persons = spark.createDataFrame([(i, f"g{i}") for i in range(1, 41)], "person_id long, person_guid string")
    return CohortEngine(MODEL, facts, persons, crosswalk=crosswalk_of(spark, WALK))


def got(engine, request, semantics, planner):
    engine.semantics, engine.planner = semantics, planner
    ids = [r.person_id for r in engine.cohort(request).collect()]
    assert len(ids) == len(set(ids))
    return set(ids)


def test_random_requests(engine):
    rng = random.Random(8)
    for i in range(28):
        request = some_request(rng)
        semantics, planner = (LENIENT, STRICT)[i % 2], (ONE_PASS, JOINS)[i // 2 % 2]
        assert got(engine, request, semantics, planner) == model(request, semantics), (request, semantics, planner)


def test_planners_agree_and_algebra_holds(engine):
    rng = random.Random(3)
    for _ in range(4):
        request = some_request(rng)
        assert got(engine, request, LENIENT, ONE_PASS) == got(engine, request, LENIENT, JOINS)
    base = QueryRequest.of(attr_all=[("sex", "F")])
    more = QueryRequest.of(attr_all=[("sex", "F")], event_all=[("dx", "a*")])
    less = QueryRequest.of(attr_all=[("sex", "F")], event_exclude=[("dx", "a*")])
    one, two, three = (got(engine, r, STRICT, ONE_PASS) for r in (base, more, less))
    assert two <= one and three <= one and two | three == one and not two & three


def test_result_envelope(engine):
    engine.semantics, engine.planner = LENIENT, "auto"
    out = engine.query(QueryRequest.of(attr_all=[("sex", "F")], event_all=[("dx", "a*", 202012, 202101)]), count_only=False, profile=True).to_dict()
    assert out["count"] == len(out["patients"]) > 0
    assert [a["attribute"] for a in out["cohortProfile"]["attributes"]] == ["sex", "state"]
    assert out["cohortProfile"]["attributes"][0]["values"] == [{"key": "F", "count": out["count"]}]
    counts = [c["count"] for c in out["cohortProfile"]["events"][0]["codes"]]
    assert counts == sorted(counts, reverse=True) and max(counts) <= out["count"]
    none = engine.query(QueryRequest.of(attr_all=[("sex", "X")]), count_only=False, profile=True).to_dict()
    assert none == {"count": 0, "patients": []}


def test_ask_uses_the_callers_planner(engine):
    out = engine.ask([{"role": "user", "content": "women"}], lambda messages, e: QueryRequest.of(attr_all=[("sex", "F")]))
    assert out["proposedQuery"] == {"attributes": {"allOf": [{"attr": "sex", "value": "F"}]}} and out["queryResults"]["count"] > 0
    assert engine.ask([], lambda messages, e: None)["queryResults"] is None


def test_search_pages(engine):
    rows = engine.search("rx", "R", "contains", limit=500).orderBy("position").collect()
    assert [r.value for r in rows] == ["r1", "r2"] and rows[0].total == 2
    assert [r.value for r in engine.search("rx", "o", "contains").orderBy("position").collect()] == ["old", "gone"]
    assert engine.search("rx", "").count() == engine.search("sex", "f").count() == engine.search("nope", "a").count() == 0


def test_index_round_trip(engine, spark, tmp_path):
    path = str(tmp_path / "index")
    engine.save(path)
    loaded = CohortEngine.load(spark, MODEL, path, crosswalk=engine.crosswalk)
    rng = random.Random(13)
    for _ in range(4):
        request = some_request(rng)
        assert got(loaded, request, LENIENT, ONE_PASS) == model(request, LENIENT)
    assert [tuple(r) for r in loaded.stats().collect()] == [tuple(r) for r in engine.stats().collect()]
    plan = loaded.cohort(QueryRequest.of(event_all=[("dx", "ab*", 202012, 202101)]))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(value,ab)" in plan and "CartesianProduct" not in plan and "PartitionFilters: [isnotnull(attr" in plan
    spark.createDataFrame([(9,)], "version int").write.mode("overwrite").parquet(path + "/meta")
    with pytest.raises(IndexFormatError):
        load_index(spark, path)


def test_an_index_is_saved_over_itself(engine, spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(IndexFormatError):
        load_index(spark, path)
    engine.save(path)
    before = sorted(map(tuple, load_index(spark, path)[0].select(*FACT_COLUMNS).collect()), key=repr)
    loaded = CohortEngine.load(spark, MODEL, path)
    for _ in range(3):
        CohortEngine.load(spark, MODEL, path).save(path)
        assert sorted(map(tuple, load_index(spark, path)[0].select(*FACT_COLUMNS).collect()), key=repr) == before
        assert len(list((tmp_path / "index").glob("data-*"))) == 2
    CohortEngine.load(spark, MODEL, path).save(str(tmp_path / "other"))
    (tmp_path / "other" / "meta").rename(tmp_path / "other" / "half")
    with pytest.raises(IndexFormatError):
        load_index(spark, str(tmp_path / "other"))
    assert loaded.model is MODEL


def test_appended_codes_are_found(engine, spark, tmp_path):
    path = str(tmp_path / "index")
    engine.save(path)
    person = engine.facts.filter("attr = 'sex' AND value = 'F'").first().person_id
    append_to_index(spark.createDataFrame([(person, "dx", "brandnew", 202101)], "person_id long, attr string, value string, yyyymm int"), path)
    loaded = CohortEngine.load(spark, MODEL, path)
    both = QueryRequest.of(attr_all=[("sex", "F")], event_all=[("dx", "brandnew")])
    assert got(loaded, both, LENIENT, ONE_PASS) == {person}
    assert "brandnew" in {r.value for r in loaded.values("dx").collect()} and loaded.search("dx", "brand").count() == 1


def test_guids_both_ways_and_allowed_values(engine, spark):
    every = engine.persons.collect()
    some = spark.createDataFrame([(every[0].person_guid,), ("nobody",)], "person_guid string")
    assert [r.person_id for r in engine.person_ids(some).collect()] == [every[0].person_id]
    assert [r.person_guid for r in engine.person_guids(spark.createDataFrame([(every[1].person_id,), (-5,)], "person_id long")).collect()] == [every[1].person_guid]
    assert engine.allowed_values()["sex"] == ["F", "M"] and list(engine.allowed_values(1)["sex"]) == ["F"]


def test_ask_words_its_answer_from_the_context(engine):
    seen = []
    messages = [{"role": "user", "content": "women"}, {"role": "tool", "content": "no"}]
    out = engine.ask(messages, lambda m, e: QueryRequest.of(attr_all=[("sex", "F")]), lambda context: seen.extend(context) or "so many")
    assert out["content"] == "so many" and [c["role"] for c in seen] == ["user", "assistant"]
    assert seen[0]["text"] == "women" and seen[1]["text"].startswith("proposedQuery:\n{") and "\n\nqueryResults:\n{" in seen[1]["text"]


def test_crosswalk_header_is_found_in_any_case_and_behind_empty_lines(spark, tmp_path):
    path = tmp_path / "walk.csv"
    path.write_bytes("\n\r\nRXNORM_CODE,x\n\u00a01\u2003,\td1\n".encode())
    assert [(r.source, r.target) for r in read_crosswalk(spark, str(path)).collect()] == [("1", "d1")]


def test_crosswalk_file(spark, tmp_path):
    path = tmp_path / "walk.csv"
    path.write_bytes(b'rxnorm_code,multum\r\n "1" , "d1"\r2,d2\n\n1,d1\n1,d0\na,b,c\nlonely\n,x\n')
    rows = read_crosswalk(spark, str(path)).orderBy("ord").collect()
    assert [(r.source, r.target) for r in rows] == [("1", "d1"), ("2", "d2"), ("1", "d0"), ("a", "b,c")]


def test_set_overloads_on_nothing(engine):
    facts = engine.facts
    assert setops.query_all(facts, []).count() == setops.query_any(facts).count() == setops.query_any_bucket(facts, []).count() == setops.query_widening(facts).count() == 0
    assert setops.query_any(facts, [("sex", "Q")], [("sex", "F")]).count() == 0
    # the older query gives nobody if all_of matches nobody, whatever any_of holds
    assert setops.query_widening(facts, [("sex", "Q")], [("sex", "F")]).count() == 0
    assert setops.query_widening(facts, [], [("sex", "F")]).count() > 0


def test_every_fact_comes_from_one_reading(spark, sf_dir):
    one = QUERIES["bitmap_count_by_key"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    stats = QUERIES["index_stats"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("l_partkey") > 0 and all(sum("Relation" in line and "l_orderkey" in line for line in plan.split("\n")) == 1 for plan in (one, stats))
