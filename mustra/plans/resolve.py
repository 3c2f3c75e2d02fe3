"""Resolving a request's names against a data set: the only place where lists lose or change items.

Only names on which the outcome depends are looked up, in one job over the vocabulary (or the facts, if there is none), so
nothing of the vocabulary's size comes to the driver. Most requests need no lookup: a name that nobody holds matches nobody
anyway, so it matters only where an unknown item would be dropped beside known ones (lenient allOf lists of several
items), or where a list of unknown items differs from one without a hit (lenient events.anyOf beside other clauses).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mustra.model import CohortModel
from mustra.request import AttrFilter, EventFilter, QueryRequest

STRICT, LENIENT = "strict", "lenient"


@dataclass(frozen=True)
class Term:
    """A predicate on facts: some values, or a prefix, of one attr, in a month range if given."""

    attr: str
    values: tuple[str, ...] = ()
    prefix: str | None = None
    months: tuple[int, int] | None = None

    def timeless(self) -> Term:
        return Term(self.attr, self.values, self.prefix)

    def predicate(self) -> Column:
        value = F.col("value")
        if self.prefix is not None:
            code = value.startswith(self.prefix)
        else:
            code = value == self.values[0] if len(self.values) == 1 else value.isin(*self.values)
        out = (F.col("attr") == self.attr) & code
        return out & F.col("yyyymm").between(*self.months) if self.months else out


def any_term(terms: Iterable[Term]) -> Column:
    return reduce(or_, (t.predicate() for t in terms))


@dataclass(frozen=True)
class ResolvedQuery:
    """What is left of a request: ``void`` if it can't match anyone."""

    all_of: tuple[Term, ...] = ()
    attr_any: tuple[Term, ...] = ()
    event_any: tuple[Term, ...] = ()
    exclude: tuple[Term, ...] = ()
    included: tuple[Term, ...] = ()
    void: bool = False
    lenient: bool = True
    #: Whether anybody at all matches events.anyOf, where that came with looking up its names in the facts.
    hit: bool | None = None

    @property
    def positive(self) -> bool:
        return bool(self.all_of or self.attr_any or self.event_any)


def _in_doubt(request: QueryRequest, semantics: str) -> set[AttrFilter | EventFilter]:
    """The filters whose outcome depends on whether their names exist."""
    a, e = request.attributes, request.events
    if semantics == STRICT:
        return set()
    out = {f for fs in (a.all_of, e.all_of) if len(fs) > 1 for f in fs}
    return out | set(e.any_of) if a.all_of or e.all_of or a.any_of else out


class Lookup:
    """Which of the named values and prefixes exist, and the named codes' crosswalk targets."""

    def __init__(self, request: QueryRequest, known: DataFrame, crosswalk: DataFrame | None, model: CohortModel, semantics: str):
        self.model, self.targets, self.monthly = model, {}, "yyyymm" in known.columns
        mappable = sorted({f.value for f in request.events if f.attr == model.crosswalk_event and "*" not in f.value})
        if crosswalk is not None and mappable:
            for r in crosswalk.filter(F.col("source").isin(mappable)).orderBy("ord").collect():
                self.targets.setdefault(r.source, []).append(r.target)
        doubtful = _in_doubt(request, semantics)
        self.doubtful = {n for f in doubtful for n in self.names(f)}
        # where names are looked up in facts, whether anybody has them in their months comes with it
        dated = {Term(n.attr, n.values, n.prefix, f.months) for f in doubtful & set(request.events.any_of) for n in self.names(f) if f.months} if self.monthly else set()
        self.found = self._find(known, self.doubtful | dated)

    def codes(self, f: AttrFilter | EventFilter) -> list[str]:
        """The values that an exact filter stands for."""
        if isinstance(f, EventFilter) and f.attr == self.model.crosswalk_event and "*" not in f.value:
            return self.targets.get(f.value) or [f.value]
        return [f.value]

    def names(self, f: AttrFilter | EventFilter) -> list[Term]:
        """A term for each value, or the prefix, that a filter names."""
        if isinstance(f, EventFilter) and f.value.endswith("*"):
            return [Term(f.attr, prefix=f.value[:-1])] if len(f.value) > 1 else []
        return [Term(f.attr, (v,)) for v in dict.fromkeys(self.codes(f))]

    def known(self, f: AttrFilter | EventFilter) -> list[Term]:
        return [t for t in self.names(f) if t not in self.doubtful or t in self.found]

    def hit(self, request: QueryRequest) -> bool | None:
        """Whether anybody matches events.anyOf; None if that wasn't looked up."""
        named = [(n, f.months) for f in request.events.any_of for n in self.names(f)]
        if not self.monthly or any(n not in self.doubtful for n, _ in named):
            return None
        return any(n in self.found if months is None else Term(n.attr, n.values, n.prefix, months) in self.found for n, months in named)

    @staticmethod
    def _find(facts: DataFrame, named: set[Term]) -> set[Term]:
        terms = sorted(named, key=repr)
        if not terms:
            return set()
        hits = facts.filter(any_term(terms)).agg(*(F.bool_or(t.predicate()).alias(f"n{i}") for i, t in enumerate(terms))).first()
        return {t for t, hit in zip(terms, hits, strict=True) if hit}


def event_term(f: EventFilter, lookup: Lookup) -> Term | None:
    """None if no value exists or the range holds no month."""
    known = lookup.known(f)
    if not known or f.months and f.months[0] > f.months[1]:
        return None
    return Term(f.attr, tuple(v for t in known for v in t.values), known[0].prefix, f.months)


def attr_term(f: AttrFilter, lookup: Lookup) -> Term | None:
    return next(iter(lookup.known(f)), None)


def resolve(request: QueryRequest, known: DataFrame, model: CohortModel, crosswalk: DataFrame | None = None, semantics: str = LENIENT) -> ResolvedQuery:
    """``known``: the vocabulary, or the facts where there is none.

    Lenient: an unknown item is dropped beside known ones. Strict: an unknown item of an allOf list matches nobody.

    Both: a list of which nothing is known matches nobody; unknown exclusions don't count; without a positive
    item nobody matches.
    """
    if semantics not in (STRICT, LENIENT):
        raise ValueError(f"semantics is {STRICT} or {LENIENT}")
    lookup = Lookup(request, known, crosswalk, model, semantics)
    lenient, a, e = semantics == LENIENT, request.attributes, request.events
    lists = {"attr_all": (a.all_of, attr_term), "event_all": (e.all_of, event_term), "attr_any": (a.any_of, attr_term), "event_any": (e.any_of, event_term), "attr_not": (a.exclude, attr_term), "event_not": (e.exclude, event_term)}
    terms = {k: tuple(t for f in fs if (t := make(f, lookup))) for k, (fs, make) in lists.items()}
    lost = any(lists[k][0] and not terms[k] for k in ("attr_all", "event_all", "attr_any", "event_any"))
    if not lenient:  # what no lookup says is said by the facts themselves
        lost |= any(len(lists[k][0]) > len(terms[k]) for k in ("attr_all", "event_all"))
    included = tuple(dict.fromkeys(t.timeless() for t in terms["event_all"] + terms["event_any"]))
    out = ResolvedQuery(terms["attr_all"] + terms["event_all"], terms["attr_any"], terms["event_any"], terms["attr_not"] + terms["event_not"], included, lenient=lenient, hit=lookup.hit(request) if terms["event_any"] else None)
    return ResolvedQuery(void=True, lenient=lenient) if lost or not out.positive else out
