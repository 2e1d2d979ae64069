"""Account-lifecycle analytics on an activity log, as Spark DataFrame operators."""

from cohortry.functions.eligibility import (
    SET_A,
    SET_B,
    SET_C,
    SET_D,
    SET_E,
    SET_F,
    SET_G,
    PlanFilter,
)
from cohortry.functions.period import Period
from cohortry.functions.vocabulary import MILESTONES, VOCABULARY, EventClass, folded, listed

__all__ = [
    "MILESTONES", "SET_A", "SET_B", "SET_C", "SET_D", "SET_E", "SET_F", "SET_G", "VOCABULARY",
    "EventClass", "Period", "PlanFilter", "folded", "listed",
]
