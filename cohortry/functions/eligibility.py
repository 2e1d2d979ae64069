"""Account exclusion sets: which shops a report leaves out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.vocabulary import in_list


@dataclass(frozen=True)
class PlanFilter:
    """Exclusion rule on the account dimension.

    A NULL ``shop_plan`` passes only with ``keep_null_plan``, a NULL ``plan_display_name`` only with
    ``keep_null_display`` (or when the rule does not look at it). A NULL e-mail never passes a
    suffix rule. Labels are compared without regard to case unless ``fold_case`` is off.
    """

    plans: tuple[str, ...]
    display_plans: tuple[str, ...] = ()
    substring: str | None = None
    keep_null_plan: bool = False
    keep_null_display: bool = False
    email_suffixes: tuple[str, ...] = ()
    fold_case: bool = True

    def also(
        self,
        plans: Iterable[str] = (),
        display_plans: Iterable[str] = (),
        email_suffixes: Iterable[str] = (),
    ) -> PlanFilter:
        """The same rule with more excluded labels."""
        return replace(
            self,
            plans=self.plans + tuple(plans),
            display_plans=self.display_plans + tuple(display_plans),
            email_suffixes=self.email_suffixes + tuple(email_suffixes),
        )

    def keeping_null_plan(self) -> PlanFilter:
        return replace(self, keep_null_plan=True)

    def _folded(self, column: str) -> str:
        return f"lower({column})" if self.fold_case else column

    def _label(self, text: str) -> str:
        return text.lower() if self.fold_case else text

    def _outside(self, column: str, labels: tuple[str, ...]) -> str:
        wanted = list(dict.fromkeys(self._label(x) for x in labels))
        return "NOT " + in_list(self._folded(column), wanted)

    def _lacks_substring(self, column: str) -> str:
        return f"NOT contains({self._folded(column)}, '{self._label(self.substring)}')"

    def _rule(self, column: str, labels: tuple[str, ...], keep_null: bool) -> str:
        tests = [self._outside(column, labels)] if labels else []
        tests += [self._lacks_substring(column)] if self.substring else []
        rule = " AND ".join(tests) or "true"
        return f"({column} IS NULL OR ({rule}))" if keep_null else f"({rule})"

    def excluded_plan(self) -> Column:
        """The account is in an excluded plan; NULL for an unknown plan."""
        return ~F.expr(self._outside("shop_plan", self.plans))

    def accepts(self) -> Column:
        """True for accounts the rule keeps; NULL or false drops the row in a filter."""
        rules = [
            self._rule("shop_plan", self.plans, self.keep_null_plan),
            self._rule("plan_display_name", self.display_plans, self.keep_null_display),
        ]
        rules += [
            f"NOT endswith({self._folded('email')}, '{self._label(s)}')" for s in self.email_suffixes
        ]
        return F.expr(" AND ".join(rules))


# Plan labels that mark test, staff, partner, paused or closed shops.
SET_A = PlanFilter(
    plans=(
        "Development", "Staff", "Developer Preview", "Trial", "Shopify Plus Partner Sandbox",
        "affiliate", "partner_test", "plus_partner_sandbox", "Pause and Build", "Staff Business",
        "fraudulent", "Canceled", "Frozen", "Fraudulent", "cancelled", "frozen",
    ),
    substring="Development",
)
SET_B = PlanFilter(
    plans=(
        "Development", "Staff", "Developer Preview", "Trial", "Shopify Plus Partner Sandbox",
        "affiliate", "partner_test", "plus_partner_sandbox", "Pause and Build",
        "fraudulent", "Canceled", "Frozen", "Fraudulent", "cancelled", "frozen",
    ),
)
_INTERNAL_PLANS = (
    "Development", "Staff", "Developer Preview", "Trial", "Shopify Plus Partner Sandbox",
    "affiliate", "staff", "partner_test", "trial", "plus_partner_sandbox", "Staff Business",
)
SET_C = PlanFilter(
    plans=(
        "Development", "Staff", "Developer Preview", "Trial", "Shopify Plus Partner Sandbox",
        "affiliate", "partner_test", "plus_partner_sandbox", "Staff Business",
    ),
    display_plans=_INTERNAL_PLANS,
    substring="Development",
    keep_null_display=True,
)
# Set D also drops the operator's own e-mail domains; name them with ``also(email_suffixes=…)``.
SET_D = replace(SET_C, plans=_INTERNAL_PLANS + ("cancelled", "frozen"))
SET_E = PlanFilter(
    plans=_INTERNAL_PLANS[:-1] + ("Basic App Development",),
    display_plans=_INTERNAL_PLANS[:-1] + ("Basic App Development",),
)
SET_F = PlanFilter(
    plans=_INTERNAL_PLANS + ("Pause and Build", "Basic App Development"),
    display_plans=_INTERNAL_PLANS + ("Pause and Build", "Basic App Development"),
)
SET_G = PlanFilter(plans=_INTERNAL_PLANS, display_plans=_INTERNAL_PLANS)
