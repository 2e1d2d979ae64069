"""Every operator next to its plain SQL, for any log and period."""

from __future__ import annotations

from cohortry.functions.eligibility import SET_A, SET_B, SET_C, SET_D, SET_E, SET_F, SET_G
from cohortry.functions.period import Period
from cohortry.operators import accounts as acc_ops
from cohortry.operators import churn, events, installs, month_state, subscriptions
from cohortry.plans import reports
from verification import naive

A, B, C, E, F_, G = SET_A, SET_B, SET_C, SET_E, SET_F, SET_G
D = SET_D.also(email_suffixes=["@internal.example"])


def pairs(log, p: Period) -> dict:
    a, c = log.activity, log.accounts
    window = Period(p.lo, p.lo + (p.hi - p.lo) / 2, p.zone)
    whole = p.whole_months()
    found = {
        "classify": (events.classify_events(a).drop(*a.columns[1:]), naive.classify_events()),
        "slice": (events.in_period(a, p).select("event_id", "store_name", "created_at"),
                  naive.period_slice(p)),
        "per_month": (events.events_per_month(a, p.zone), naive.events_per_month(p)),
        "cohort": (acc_ops.cohort_accounts(c, A, p), naive.account_cohort(p, A)),
        "surviving": (installs.surviving_installs(a, c, p), naive.surviving_installs(p, A)),
        "surviving_re": (installs.surviving_reinstalls(a, c, p), naive.surviving_reinstalls(p, A)),
        "reopened": (installs.reopened_stores(a, c, p), naive.reopened_stores(p, A)),
        "status": (installs.install_status(a, c, p), naive.install_status(p, A)),
        "status_month": (installs.status_by_month(a, c, p), naive.status_by_month(p, A)),
        "status_outer": (installs.status_by_month(a, c, p, how="outer"),
                         naive.status_by_month(p, A, "outer")),
        "fresh_month": (installs.fresh_count_by_month(a, c, p), naive.fresh_count_by_month(p, A)),
        "to_date": (installs.installs_to_date(a, c, p, window),
                    naive.installs_to_date(p, window, A)),
        "new_only": (installs.new_not_reinstalled(a, c, p), naive.new_not_reinstalled(p, A)),
        "multiplicity": (installs.install_multiplicity(a, c, p),
                         naive.install_multiplicity(p, A)),
        "free_plan": (installs.free_plan_stores(a, c, p), naive.free_plan_stores(p, A)),
        "paid": (installs.paid_stores(a, c, p), naive.paid_stores(p, A)),
        "onboarding_new": (installs.onboarding_of_new(a, c, p), naive.onboarding_of_new(p, A)),
        "month_end": (month_state.installed_at_month_end(a, p), naive.installed_at_month_end(p)),
        "month_end_older": (month_state.installed_at_month_end(a, p.so_far(), c, p),
                            naive.installed_at_month_end(p.so_far(), p)),
        "completed": (month_state.onboarding_by_month(a, c, p, "completed"),
                      naive.onboarding_by_month(p, B, "completed")),
        "pending_older": (month_state.onboarding_by_month(a, c, whole, "pending", before=p),
                          naive.onboarding_by_month(whole, B, "pending", p)),
        "converted": (month_state.converted_after_install(a, c, p),
                      naive.converted_after_install(p, B)),
        "converted_older": (month_state.converted_after_install(a, c, p, scope="before"),
                            naive.converted_after_install(p, B, "before")),
        "stayed_free": (month_state.free_without_upgrade(a, c, p), naive.free_without_upgrade(p, B)),
        "stayed_free_older": (month_state.free_without_upgrade(a, c, p, scope="before"),
                              naive.free_without_upgrade(p, B, "before")),
        "active": (subscriptions.active_accounts(a, c, p), naive.active_accounts(p, B)),
        "first_paid": (subscriptions.first_paid(a, c, p), naive.first_paid(p, B)),
        "first_paid_month": (reports.first_paid_by_month(a, c, p), naive.first_paid_by_month(p, B)),
        "churned": (churn.churned_events(a, c, p, rule=D), naive.churned_events(p, D)),
        "buckets": (churn.churn_buckets(a, c, p, rule=D), naive.churn_buckets(p, D)),
        "churned_new": (churn.churned_new_installs(a, c, p), naive.churned_new_installs(p, C)),
        "last_uninstall": (churn.last_uninstall(a, c, p).drop("cohort"),
                           naive.last_uninstall(p, F_)),
        "creation_month": (churn.creation_month_events(a, c, p),
                           naive.creation_month_events(p, E)),
        "plan_at_churn": (reports.plan_at_churn(a, c, p), naive.plan_at_churn(p, C)),
        "plan_simple": (reports.plan_at_churn(a, c, p, base="last_uninstall"),
                        naive.plan_at_churn(p, F_, "last_uninstall")),
        "milestones": (reports.milestones_of_churned(a, c, p), naive.milestones_of_churned(p, C)),
        "milestones_created": (reports.milestones_of_churned(a, c, p, base="creation_month"),
                               naive.milestones_of_churned(p, E, "creation_month")),
        "stop_step": (reports.onboarding_stop_step(a, c, p), naive.onboarding_stop_step(p, C)),
        "stop_simple": (reports.onboarding_stop_step(a, c, p, base="last_uninstall"),
                        naive.onboarding_stop_step(p, G, "last_uninstall")),
        "unfinished": (reports.unfinished_churn(a, c, p), naive.churned_unfinished(p, C, G)),
        "unfinished_simple": (reports.unfinished_churn(a, c, p, base="last_uninstall"),
                              naive.churned_unfinished(p, C, G, "last_uninstall")),
    }
    for name, rule in {"a": A, "b": B, "c": C, "d": D, "e": E, "f": F_, "g": G}.items():
        found[f"eligible_{name}"] = (
            acc_ops.eligible_accounts(c, rule).select("store_client_id", "store_name"),
            naive.eligible_accounts(rule),
        )
    return found
