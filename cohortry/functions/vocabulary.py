"""Event vocabulary: which spellings of ``action`` and ``page`` mean what.

The log holds free-text labels. An :class:`EventClass` names the spellings of one meaning, on the
``action`` channel, the ``page`` channel or both, and turns them into a filter column. Labels are
matched without regard to case: the column is lower-cased and compared with lower-cased labels.
``dictionary`` finds the raw spellings of a log once and lists those. ``listed()`` gives up folding for logs known to be normalised: every spelling is listed in its usual
case variants, the raw column stays bare and the list reaches the Parquet reader, and labels in any
other casing are not found.

Conditions are built as SQL text and parsed once where they are used: a profile combines dozens of
them, and every Column operation would be a round trip to the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_variants(spellings: tuple[str, ...]) -> list[str]:
    """Each spelling as given, lower, upper, capitalised and titled; no duplicates."""
    forms = (str, str.lower, str.upper, str.capitalize, str.title)
    return list(dict.fromkeys(form(s) for s in spellings for form in forms))


def in_list(expression: str, labels: list[str]) -> str:
    """SQL text ``expression IN (labels)``."""
    literals = (label.replace("\\", "\\\\").replace("'", "\\'") for label in labels)
    return f"{expression} IN ({', '.join(f"'{x}'" for x in literals)})"


@dataclass(frozen=True)
class EventClass:
    """``exact`` lists raw labels as they are, without variants (see ``dictionary``)."""

    actions: tuple[str, ...] = ()
    pages: tuple[str, ...] = ()
    fold_case: bool = True
    exact: bool = False

    def __or__(self, other: EventClass) -> EventClass:
        return EventClass(
            tuple(dict.fromkeys(self.actions + other.actions)),
            tuple(dict.fromkeys(self.pages + other.pages)),
            self.fold_case or other.fold_case,
            self.exact and other.exact,
        )

    def _listed(self, column: str, spellings: tuple[str, ...], lowered: bool) -> str:
        if self.fold_case:
            value = column if lowered else f"lower({column})"
            return in_list(value, list(dict.fromkeys(s.lower() for s in spellings)))
        return in_list(column, list(spellings) if self.exact else case_variants(spellings))

    def sql(self, lowered: bool = False) -> str:
        """The test as SQL text: either channel carries a spelling; a NULL page never does.

        ``lowered`` says that both columns are in lower case already.
        """
        channels = {"action": self.actions, "page": self.pages}
        tests = [self._listed(column, labels, lowered) for column, labels in channels.items() if labels]
        return f"({' OR '.join(tests) or 'false'})"

    def hit(self) -> Column:
        return F.expr(self.sql())


# The labels that occur in the activity log.
FRESH = EventClass(("fresh install", "fresh installs", "fresh_install"))
REINSTALL_WIDE = EventClass(("reinstall", "re-installs", "re installs", "re_install"))
UNINSTALL_ONLY = EventClass(("uninstall",))

VOCABULARY: Mapping[str, EventClass] = {
    "install_any": EventClass(
        ("fresh_install", "Fresh installs", "reinstall", "Re-installs", "reopen", "store re-opened")
    ),
    "fresh": FRESH,
    "fresh_strict": EventClass(("fresh_install", "Fresh Installs")),
    "reinstall": EventClass(("reinstall", "Re-installs")),
    "reinstall_wide": REINSTALL_WIDE,
    "reopen": EventClass(("reopen", "store re-opened")),
    "install_after_churn": EventClass(
        ("install", "fresh_install", "Fresh Installs", "reinstall", "Re-installs")
    ),
    "install_bench": EventClass(
        ("fresh_install", "reinstall", "fresh installs", "re-installs", "install")
    ),
    "lifecycle": FRESH | REINSTALL_WIDE | UNINSTALL_ONLY,
    "churn": EventClass(("uninstall", "Paid uninstalled", "Store closed"), ("uninstall",)),
    "churn_action": EventClass(("uninstall", "Paid uninstalled", "Store closed")),
    "uninstall": EventClass(("uninstall", "Paid uninstalled"), ("uninstall",)),
    "uninstall_action": EventClass(("uninstall", "Paid uninstalled")),
    "uninstall_action_wide": EventClass(("uninstall", "Paid uninstalled", "UNINSTALLED")),
    "uninstall_raw": EventClass(("uninstall", "UNINSTALLED")),
    "uninstall_only": UNINSTALL_ONLY,
    "uninstall_bench": EventClass(("uninstall", "app_uninstall")),
    "uninstall_page": EventClass((), ("uninstall", "UNINSTALL_APP")),
    "closed": EventClass(("Store closed",)),
    "free_plan": EventClass(("Free Plan",)),
    "free_user": EventClass(("Free User",)),
    "free_or_downgraded": EventClass(("Free User", "Plan Downgraded")),
    "charge_approved": EventClass(("Charge Approved",)),
    "upgraded": EventClass(("Plan Upgraded",)),
    "pricing_plan": EventClass(
        ("pricing_plan_type-2", "pricing_plan_type-3", "pricing_plan_type-4")
    ),
    "trial": EventClass(("During trial",)),
    "paid_uninstall": EventClass(("Paid uninstalled",)),
    "onb_step1": EventClass(("SPLD-onboarding-step-1", "PC-onboarding-step-1")),
    "onb_step2": EventClass(("SPLD-onboarding-step-2", "PC-onboarding-step-2")),
    "onb_step3": EventClass(("SPLD-onboarding-step-3", "PC-onboarding-step-3")),
    "onb_done": EventClass(("Onboarding—completed", "Onboarding completed")),
    "app_enabled": EventClass(("App Enabled", "App enabled-odd")),
    "fresh_page": EventClass((), ("Fresh Installs page",)),
    "reinstall_page": EventClass((), ("re-installs",)),
}

# The eight product milestones, output name -> label.
MILESTONES: Mapping[str, EventClass] = {
    "app_enabled": EventClass(("App enabled-odd",)),
    "calendar_placement": EventClass(("Calendar Placement (Default)",)),
    "delivery_method_enabled": EventClass(("Delivery Method Enabled",)),
    "date_picker_enabled": EventClass(("Date-picker — Enabled",)),
    "time_picker_enabled": EventClass(("Time-picker — Enabled",)),
    "google_maps_api_key_added": EventClass(("Google Maps API Key Added",)),
    "checkout_widget_enabled": EventClass(("Checkout Widget Enabled",)),
    "scheduled_order_placed": EventClass(("Scheduled Order Placed",)),
}


def union(*classes: EventClass) -> EventClass:
    """All spellings of several classes: one list to test, and to push to the reader."""
    return reduce(or_, classes)


def folded(vocab: Mapping[str, EventClass] = VOCABULARY) -> dict[str, EventClass]:
    """The same vocabulary, matched on the lower-cased column, as is the default."""
    return {name: replace(cls, fold_case=True, exact=False) for name, cls in vocab.items()}


def listed(vocab: Mapping[str, EventClass] = VOCABULARY) -> dict[str, EventClass]:
    """The same vocabulary for logs whose labels come in the usual case variants only."""
    return {name: replace(cls, fold_case=False) for name, cls in vocab.items()}
