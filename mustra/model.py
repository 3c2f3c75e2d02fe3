"""What a cohort data set is about: names of attributes and event types."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CohortModel:
    """Names in the order in which they are listed and profiled.

    ``crosswalk_event``: the event type whose exact codes the crosswalk rewrites.
    """

    attributes: tuple[str, ...]
    event_types: tuple[str, ...]
    crosswalk_event: str | None = None


#: The model of the service's own vocabulary.
CLINICAL = CohortModel(
    attributes=("gender", "race", "ethnicity", "yearOfBirth", "state", "metro", "urban"),
    event_types=("conditionCode", "medicationCode", "procedureCode"),
    crosswalk_event="medicationCode",
)
