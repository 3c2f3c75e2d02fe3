import pytest

from mustra.model import CLINICAL
from mustra.request import QueryRequest, RequestError, first_json_object, json_schema, normalise_code

FULL = """{"attributes": {"allOf": [{"attr": "gender", "value": "Male"}], "anyOf": [{"attr": "state", "value": "CA"}], "exclude": [{"attr": "race", "value": "Other"}]},
 "events": {"allOf": [{"attr": "conditionCode", "value": "E11*", "startYYYYMM": 202201, "endYYYYMM": 202212}], "anyOf": [{"attr": "medicationCode", "value": "860975"}], "exclude": [{"attr": "procedureCode", "value": "99213"}]}}"""


def test_reads_and_writes_all_lists():
    import json

    request = QueryRequest.from_json(FULL)
    assert request.events.all_of[0].months == (202201, 202212)
    assert request.to_dict() == json.loads(FULL)
    request.validate(CLINICAL)


def test_missing_parts_are_empty():
    assert QueryRequest.from_json("{}") == QueryRequest()
    assert QueryRequest.from_dict({"events": {"anyOf": None}}) == QueryRequest()


@pytest.mark.parametrize("text", ['{"attributes": {"allOf": [{"attr": "gender", "value": "Male"},]}}', "[]", '{"attributes": []}', '{"events": {"allOf": {}}}', '{"events": {"allOf": [{"attr": "x"}]}}', '{"events": {"allOf": [{"attr": "x", "value": "y", "startYYYYMM": "202201"}]}}'])
def test_rejects_other_forms(text):
    with pytest.raises(RequestError):
        QueryRequest.from_json(text)


@pytest.mark.parametrize("lists", [{"attr_all": [("shoe", "9")]}, {"event_any": [("gender", "Male")]}, {"event_all": [("conditionCode", "E11", 202201, None)]}, {"event_all": [("conditionCode", "E11", 202213, 202214)]}])
def test_validation(lists):
    with pytest.raises(RequestError):
        QueryRequest.of(**lists).validate(CLINICAL)


def test_one_end_is_no_range():
    assert QueryRequest.of(event_all=[("conditionCode", "E11", 202201, None)]).events.all_of[0].months is None


def test_helpers():
    assert normalise_code("E11x.X") == "E11*.*"
    assert QueryRequest.of(event_all=[("conditionCode", "E11x")]).normalised().events.all_of[0].value == "E11*"
    assert first_json_object('say {no} {"a": {"b": "}"}} then') == {"a": {"b": "}"}}
    assert first_json_object("none") is None
    assert json_schema(CLINICAL)["properties"]["events"]["properties"]["anyOf"]["items"]["properties"]["attr"]["enum"] == list(CLINICAL.event_types)
