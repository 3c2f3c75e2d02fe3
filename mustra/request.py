"""Cohort requests: the tree that users submit, its JSON form and its checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from mustra.model import CohortModel


class RequestError(ValueError):
    """A request that is not of the declared form."""


@dataclass(frozen=True)
class AttrFilter:
    attr: str
    value: str


@dataclass(frozen=True)
class EventFilter:
    attr: str
    value: str
    start: int | None = None
    end: int | None = None

    @property
    def months(self) -> tuple[int, int] | None:
        """Both ends of the range; one end alone is ignored."""
        return None if self.start is None or self.end is None else (self.start, self.end)


@dataclass(frozen=True)
class Clauses:
    all_of: tuple = ()
    any_of: tuple = ()
    exclude: tuple = ()

    def __iter__(self):
        return iter((*self.all_of, *self.any_of, *self.exclude))


@dataclass(frozen=True)
class QueryRequest:
    attributes: Clauses = field(default_factory=Clauses)
    events: Clauses = field(default_factory=Clauses)

    @classmethod
    def of(cls, **lists: Iterable) -> QueryRequest:
        """Lists by name: attr_all, attr_any, attr_exclude, event_all, event_any, event_exclude."""
        take = lambda kind, make: Clauses(*(tuple(make(*x) for x in lists.pop(f"{kind}_{part}", ())) for part in ("all", "any", "exclude")))
        out = cls(take("attr", AttrFilter), take("event", EventFilter))
        if lists:
            raise TypeError(f"unknown lists: {sorted(lists)}")
        return out

    @classmethod
    def from_json(cls, text: str) -> QueryRequest:
        try:
            return cls.from_dict(json.loads(text))
        except json.JSONDecodeError as e:
            raise RequestError(f"not JSON: {e}") from e

    @classmethod
    def from_dict(cls, tree: Mapping) -> QueryRequest:
        if not isinstance(tree, Mapping):
            raise RequestError("a request is an object")
        return cls(_clauses(tree.get("attributes"), _attr_filter), _clauses(tree.get("events"), _event_filter))

    def to_dict(self) -> dict:
        def attr(f: AttrFilter) -> dict:
            return {"attr": f.attr, "value": f.value}

        def event(f: EventFilter) -> dict:
            months = {"startYYYYMM": f.start, "endYYYYMM": f.end}
            return attr(f) | {k: v for k, v in months.items() if v is not None}

        out = {}
        for name, clauses, write in (("attributes", self.attributes, attr), ("events", self.events, event)):
            lists = {"allOf": clauses.all_of, "anyOf": clauses.any_of, "exclude": clauses.exclude}
            if any(lists.values()):
                out[name] = {k: [write(f) for f in v] for k, v in lists.items() if v}
        return out

    def validate(self, model: CohortModel) -> None:
        """Raises RequestError where names aren't the model's, or a month range is half or ill-formed."""
        for f in self.attributes:
            if f.attr not in model.attributes:
                raise RequestError(f"unknown attribute {f.attr!r}")
        for f in self.events:
            if f.attr not in model.event_types:
                raise RequestError(f"unknown event type {f.attr!r}")
            if (f.start is None) != (f.end is None):
                raise RequestError("a month range needs both ends")
            for month in (f.start, f.end):
                if month is not None and not 1 <= month % 100 <= 12:
                    raise RequestError(f"{month} is no month")

    def normalised(self) -> QueryRequest:
        """With ``x`` in event codes read as the wildcard."""
        one = lambda fs: tuple(replace(f, value=normalise_code(f.value)) for f in fs)
        e = self.events
        return replace(self, events=Clauses(one(e.all_of), one(e.any_of), one(e.exclude)))


def _clauses(tree, make) -> Clauses:
    if tree is None:
        return Clauses()
    if not isinstance(tree, Mapping):
        raise RequestError("filters are an object of lists")
    lists = [[] if tree.get(k) is None else tree[k] for k in ("allOf", "anyOf", "exclude")]
    if not all(isinstance(x, list) for x in lists):
        raise RequestError("allOf, anyOf and exclude are lists")
    return Clauses(*(tuple(map(make, x)) for x in lists))


def _text(item: Mapping, key: str) -> str:
    if not isinstance(item, Mapping) or not isinstance(item.get(key), str):
        raise RequestError(f"a filter needs a string {key!r}")
    return item[key]


def _month(item: Mapping, key: str) -> int | None:
    value = item.get(key)
    if value is not None and (not isinstance(value, int) or isinstance(value, bool)):
        raise RequestError(f"{key} is an integer")
    return value


def _attr_filter(item: Mapping) -> AttrFilter:
    return AttrFilter(_text(item, "attr"), _text(item, "value"))


def _event_filter(item: Mapping) -> EventFilter:
    return EventFilter(_text(item, "attr"), _text(item, "value"), _month(item, "startYYYYMM"), _month(item, "endYYYYMM"))


def normalise_code(code: str) -> str:
    return re.sub("[xX]", "*", code)


def first_json_object(text: str) -> dict | None:
    """The first JSON object inside free text, None if there is none."""
    for hit in re.finditer(r"\{", text):
        try:
            return json.JSONDecoder().raw_decode(text, hit.start())[0]
        except json.JSONDecodeError:
            continue
    return None


def json_schema(model: CohortModel) -> dict:
    """JSON schema of a request over ``model``, for tools that write requests."""
    attr = {"type": "object", "required": ["attr", "value"], "properties": {"attr": {"type": "string", "enum": list(model.attributes)}, "value": {"type": "string"}}}
    month = {"type": "integer", "description": "month as YYYYMM; both ends or none"}
    event = {"type": "object", "required": ["attr", "value"], "properties": {"attr": {"type": "string", "enum": list(model.event_types)}, "value": {"type": "string", "description": "a code; a trailing * stands for any rest"}, "startYYYYMM": month, "endYYYYMM": month}}
    lists = lambda item: {"type": "object", "properties": {k: {"type": "array", "items": item} for k in ("allOf", "anyOf", "exclude")}}
    return {"type": "object", "properties": {"attributes": lists(attr), "events": lists(event)}}


#: What a model calls the roles of messages; others aren't shown to it.
MODEL_ROLES = {"user": "user", "agent": "assistant", "system": "system"}


def model_context(messages: Iterable[Mapping]) -> list[dict]:
    """Messages as role and text for a model: content first, then the proposed query and its results as JSON, under their names."""
    out = []
    for message in messages:
        if message.get("role") in MODEL_ROLES:
            shown = [f"{key}:\n{json.dumps(message[key], indent=2, sort_keys=True, ensure_ascii=False)}" for key in ("proposedQuery", "queryResults") if message.get(key) is not None]
            out.append({"role": MODEL_ROLES[message["role"]], "text": "\n\n".join(filter(None, [message.get("content"), *shown]))})
    return out
