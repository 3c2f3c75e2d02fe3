"""The engine's face: one data set, its requests and listings."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mustra.model import CohortModel
from mustra.operators import bitmap
from mustra.operators import profile as profiles
from mustra.operators import search as searches
from mustra.plans.planner import AUTO, BITMAP, ONE_PASS, bitmaps, choose, one_pass, plan
from mustra.plans.resolve import LENIENT, ResolvedQuery, resolve
from mustra.request import QueryRequest, RequestError, first_json_object, model_context
from mustra.sources.facts import open_index, save_index


#: Patients that one answer may list, and a page of them.
MOST_PATIENTS, PAGE_PATIENTS = 1_000_000, 10_000
#: How often a planner may try.
ROUNDS = 3


class ResultTooLargeError(ValueError):
    """More patients than an answer may list."""


@dataclass(frozen=True)
class CohortResult:
    """Lazy tables: ``ids`` (person_id), ``count`` (one row); on request ``patients`` and ``profile``."""

    ids: DataFrame
    count: DataFrame
    patients: DataFrame | None
    profile: DataFrame | None

    def to_dict(self, most: int = MOST_PATIENTS) -> dict:
        """The result as the service gives it, an error if there are more patients than ``most``; they come a partition at a time."""
        out: dict = {"count": self.count.first()["count"]}
        if self.patients is not None:
            if out["count"] > most:
                raise ResultTooLargeError(f"{out['count']} patients, more than {most}: write them or take pages")
            out["patients"] = [r.person_guid for r in self.patients.toLocalIterator()]
        if self.profile is not None and out["count"]:
            groups = {"attribute": {}, "event": {}}
            for r in self.profile.collect():
                groups[r.kind].setdefault(r.name, []).append({"key": r.key, "count": r["count"]})
            out["cohortProfile"] = {
                "attributes": [{"attribute": k, "values": v} for k, v in groups["attribute"].items()],
                "events": [{"eventType": k, "codes": v} for k, v in groups["event"].items()],
            }
        return out


class CohortEngine:
    """Cohort queries over one table of facts.

    ``words``: a table of the vocabulary (attr, value, n_persons); without it names are looked up in the facts.
    ``crosswalk``: (source, target, ord) for the model's crosswalk event. ``blocks``: an index's bitmaps, which counts, profiles and
    statistics then come from; ``grams``: its substrings of values, which searches then begin with.
    """

    def __init__(self, model: CohortModel, facts: DataFrame, persons: DataFrame, words: DataFrame | None = None, crosswalk: DataFrame | None = None, semantics: str = LENIENT, planner: str = AUTO, blocks: DataFrame | None = None, grams: DataFrame | None = None):
        self.model, self.facts, self.persons, self.words, self.crosswalk, self.semantics, self.planner, self.blocks, self.grams = model, facts, persons, words, crosswalk, semantics, planner, blocks, grams

    @classmethod
    def load(cls, spark: SparkSession, model: CohortModel, path: str, **options) -> CohortEngine:
        index = open_index(spark, path)
        return cls(model, index.facts, index.persons, index.words, blocks=index.blocks, grams=index.grams, **options)

    def save(self, path: str, dealt: bool = False) -> None:
        """Writes the index; ``path`` may be the one that this engine was loaded from. ``dealt``: the facts' rows were, by month and part."""
        save_index(self.facts, self.persons, path, scattered=self.blocks is None and not dealt)

    def person_ids(self, guids: DataFrame) -> DataFrame:
        """person_id, person_guid of the persons that ``guids`` (person_guid) names; unknown ones are left out."""
        return self.persons.join(guids.select("person_guid"), "person_guid", "left_semi").select("person_id", "person_guid")

    def person_guids(self, ids: DataFrame) -> DataFrame:
        """person_id, person_guid of the persons that ``ids`` (person_id) names; unknown ones are left out."""
        return self.persons.join(ids.select("person_id"), "person_id", "left_semi").select("person_id", "person_guid")

    def allowed_values(self, most: int = 200) -> dict[str, list[str]]:
        """Each attribute's values in order, at most ``most`` of them, for the instructions of a model that writes requests."""
        known = self.facts if self.words is None else self.words
        each = known.filter(F.col("attr").isin(*self.attributes())).select("attr", "value").distinct()
        place = F.row_number().over(Window.partitionBy("attr").orderBy("value"))
        rows = each.withColumn("place", place).filter(F.col("place") <= most).orderBy("attr", "value").collect()
        return {a: [r.value for r in rows if r.attr == a] for a in self.attributes()}

    def health(self) -> dict:
        return {"status": "ok"}

    def attributes(self) -> tuple[str, ...]:
        return self.model.attributes

    def event_types(self) -> tuple[str, ...]:
        return self.model.event_types

    def values(self, attr: str) -> DataFrame:
        """The values of an attribute or event type in order; none for an unknown one."""
        known = self.facts if self.words is None else self.words
        return known.filter(F.col("attr") == attr).select("value").distinct().orderBy("value")

    def resolve(self, request: QueryRequest) -> ResolvedQuery:
        return resolve(request, self.facts if self.words is None else self.words, self.model, self.crosswalk, self.semantics)

    def cohort(self, request: QueryRequest) -> DataFrame:
        return plan(self.resolve(request), self.facts, self.planner, self.words, self.blocks)

    def cohort_bitmaps(self, request: QueryRequest) -> DataFrame:
        """The cohort as a bitmap set (bucket, bitmap); of a loaded index only."""
        if self.blocks is None:
            raise ValueError("only an index has bitmaps")
        return bitmaps(self.resolve(request), self.blocks)

    def query(self, request: QueryRequest, count_only: bool = True, profile: bool = False) -> CohortResult:
        resolved = self.resolve(request)
        planner, bounds = choose(resolved, self.words, self.blocks) if self.planner == AUTO else (self.planner, None)
        patients = found = None
        if planner == BITMAP and self.blocks is not None:
            held = bitmaps(resolved, self.blocks)
            ids, count = bitmap.ids_of(held), bitmap.count_bitmaps(held)
            if profile:
                found = profiles.profile_of_blocks(self.blocks, held, self.model, resolved.included)
        else:
            ids = plan(resolved, self.facts, planner, bounds=bounds)
            count = profiles.cohort_count(ids)
            if profile and planner == ONE_PASS:
                found = profiles.profile_of_held(one_pass(resolved, self.facts, profiles.profiled(self.model, resolved.included)), self.model)
            elif profile:
                found = profiles.profile_both(self.facts, ids, self.model, resolved.included)
        if not count_only:
            patients = self.persons.join(ids, "person_id", "left_semi").orderBy("person_id").select("person_id", "person_guid")
        return CohortResult(ids, count, patients, None if found is None else profiles.ordered(found, self.model))

    def patients(self, request: QueryRequest) -> DataFrame:
        """person_id, person_guid of the cohort, in no order."""
        return self.persons.join(self.cohort(request), "person_id", "left_semi").select("person_id", "person_guid")

    def patients_page(self, request: QueryRequest, after: int | None = None, limit: int = PAGE_PATIENTS) -> DataFrame:
        """The cohort's next ``limit`` persons behind the id ``after``, in order; the last id is where the next page begins. Each task
        keeps no more than a page, and persons up to ``after`` aren't read where files say what ids they hold."""
        found = self.patients(request)
        if after is not None:
            found = found.filter(F.col("person_id") > after)
        return found.orderBy("person_id").limit(limit)

    def write_patients(self, request: QueryRequest, path: str) -> None:
        """The cohort as lines of JSON, written by the tasks that find it, in files by ranges of ids."""
        self.patients(request).repartitionByRange("person_id").sortWithinPartitions("person_id").write.json(path)

    def search(self, event_type: str, keyword: str, mode: str = searches.PREFIX, limit: int = searches.PAGE, offset: int = 0) -> DataFrame:
        """value, position, total."""
        values = self.values(event_type) if self.grams is None or not keyword else searches.candidates(self.grams, event_type, keyword, mode)
        if not keyword or event_type not in self.model.event_types:
            values = values.filter(F.lit(False))
        crosswalk = self.crosswalk if event_type == self.model.crosswalk_event and keyword else None
        return searches.page(searches.ranked(values, keyword, mode, crosswalk), limit, offset)

    def stats(self) -> DataFrame:
        if self.blocks is not None:
            return profiles.index_stats_of_blocks(self.blocks, self.persons)
        return profiles.index_stats(self.facts, self.persons)

    def request_of(self, proposed: QueryRequest | dict | str) -> QueryRequest:
        """What a model proposes, be it a request, its tree or text with a JSON object in it, with codes normalised; RequestError if
        it isn't of the declared form or names what the data set doesn't have."""
        if isinstance(proposed, str):
            proposed = first_json_object(proposed)
            if proposed is None:
                raise RequestError("no JSON object")
        request = (proposed if isinstance(proposed, QueryRequest) else QueryRequest.from_dict(proposed)).normalised()
        request.validate(self.model)
        return request

    def ask(self, messages: Sequence[dict], planner: Callable[[Sequence[dict], CohortEngine], QueryRequest | dict | str | None], answer: Callable[[list[dict]], str] | None = None, rounds: int = ROUNDS) -> dict:
        """A message that answers ``messages``: ``planner`` makes the request of them, or None if it has none.

        What it makes is checked; if it isn't a request of this data set, the planner gets the conversation again with its proposal and the error
        behind it, ``rounds`` times in all. ``answer`` words the content: it gets the conversation with the result behind it, as
        ``model_context`` gives it. Without a request that passes, the content is the last error.
        """
        out: dict = {"role": "agent", "content": "", "proposedQuery": None, "queryResults": None}
        shown, request = list(messages), None
        for _ in range(rounds):
            proposed = planner(shown, self)
            if proposed is None:
                break
            try:
                request = self.request_of(proposed)
                break
            except RequestError as e:
                said = proposed if isinstance(proposed, str) else json.dumps(proposed.to_dict() if isinstance(proposed, QueryRequest) else proposed, sort_keys=True)
                shown += [{"role": "agent", "content": said}, {"role": "system", "content": f"This request can't be run: {e}"}]
                out["content"] = str(e)
        if request is not None:
            out |= {"content": "", "proposedQuery": request.to_dict(), "queryResults": self.query(request, count_only=True, profile=True).to_dict()}
        if answer is not None and (request is not None or not out["content"]):
            out["content"] = answer(model_context([*messages, out]))
        return out
