"""The operators once more, as plain SQL for DuckDB.

Each statement is written the long way (events against events, EXISTS and joins back on the latest
time, lower-cased labels, local time computed on the column), so that it checks the per-key profiles
of the library independently. The relations ``activity``, ``account`` and ``snapshot`` are expected
to exist; only the label lists are shared with the library.
"""

from __future__ import annotations

from cohortry.functions.eligibility import PlanFilter
from cohortry.functions.period import Period, _fixed_offset
from cohortry.functions.vocabulary import MILESTONES, VOCABULARY, EventClass


def _quoted(labels) -> str:
    seen = dict.fromkeys(x.lower() for x in labels)
    return ", ".join("'" + x.replace("'", "''") + "'" for x in seen)


def is_(cls: str | EventClass, row: str) -> str:
    """Row alias carries a spelling of an event class."""
    cls = VOCABULARY[cls] if isinstance(cls, str) else cls
    tests = []
    if cls.actions:
        tests.append(f"lower({row}.action) IN ({_quoted(cls.actions)})")
    if cls.pages:
        tests.append(f"lower({row}.page) IN ({_quoted(cls.pages)})")
    return f"coalesce({' OR '.join(tests)}, false)"


def local(column: str, p: Period) -> str:
    minutes = int(_fixed_offset(p.zone).total_seconds() // 60)
    return f"({column} + INTERVAL '{minutes}' MINUTE)"


def month(column: str, p: Period) -> str:
    return f"CAST(date_trunc('month', {local(column, p)}) AS DATE)"


def label(column: str) -> str:
    return f"strftime({column}, '%Y-%m')"


def during(column: str, p: Period) -> str:
    tests = ["true"]
    if p.lo is not None:
        tests.append(f"{local(column, p)} >= TIMESTAMP '{p.lo}'")
    if p.hi is not None:
        tests.append(f"{local(column, p)} < TIMESTAMP '{p.hi}'")
    return "(" + " AND ".join(tests) + ")"


def ahead_of(column: str, p: Period) -> str:
    return f"({local(column, p)} < TIMESTAMP '{p.lo}')"


def of_cohort(cohort: str, p: Period, row: str = "c") -> str:
    return during(f"{row}.created_on", p) if cohort == "new" else ahead_of(f"{row}.created_on", p)


def accepted(rule: PlanFilter, row: str = "c") -> str:
    plan = [f"lower({row}.shop_plan) NOT IN ({_quoted(rule.plans)})"]
    display = []
    if rule.display_plans:
        display.append(f"lower({row}.plan_display_name) NOT IN ({_quoted(rule.display_plans)})")
    if rule.substring:
        plan.append(f"{row}.shop_plan NOT ILIKE '%{rule.substring}%'")
        display.append(f"{row}.plan_display_name NOT ILIKE '%{rule.substring}%'")
    plan_sql = "(" + " AND ".join(plan) + ")"
    if rule.keep_null_plan:
        plan_sql = f"({row}.shop_plan IS NULL OR {plan_sql})"
    rules = [plan_sql]
    if display:
        text = "(" + " AND ".join(display) + ")"
        rules.append(
            f"({row}.plan_display_name IS NULL OR {text})" if rule.keep_null_display else text
        )
    rules += [f"{row}.email NOT ILIKE '%{s}'" for s in rule.email_suffixes]
    return "(" + " AND ".join(rules) + ")"


# ---- rows ----------------------------------------------------------------------------------------


def classify_events(only=None) -> str:
    flags = ", ".join(f"{is_(n, 'a')} AS is_{n}" for n in (only or VOCABULARY))
    return f"SELECT a.event_id, {flags} FROM activity a"


def install_types(p: Period) -> str:
    return f"""
SELECT a.event_id, CASE
    WHEN {is_('fresh', 'a')} AND {is_('fresh_page', 'a')} THEN 'fresh'
    WHEN {is_('reinstall_wide', 'a')} AND {is_('reinstall_page', 'a')} THEN 'reinstall' END AS install_type
FROM activity a
WHERE {during('a.created_at', p)} AND ({is_('fresh', 'a')} OR {is_('reinstall_wide', 'a')})"""


def period_slice(p: Period) -> str:
    return f"""
SELECT a.event_id, a.store_name, a.created_at FROM activity a WHERE {during('a.created_at', p)}"""


def events_per_month(p: Period) -> str:
    return f"""
SELECT {month('a.created_at', p)} AS month, count(*) AS events,
       count(DISTINCT a.store_name) AS active_stores
FROM activity a GROUP BY 1"""


def month_spine(p: Period) -> str:
    """Every month from the first to the last event, with its re-installs."""
    return f"""
WITH edge AS (
    SELECT min({month('created_at', p)}) AS lo, max({month('created_at', p)}) AS hi FROM activity
), spine AS (
    SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM edge
)
SELECT s.month, (SELECT count(*) FROM activity a
                 WHERE {is_('reinstall_wide', 'a')} AND {month('a.created_at', p)} = s.month) AS reinstalls
FROM spine s"""


def eligible_accounts(rule: PlanFilter) -> str:
    return f"SELECT c.store_client_id, c.store_name FROM account c WHERE {accepted(rule)}"


def account_cohort(p: Period, rule: PlanFilter) -> str:
    return f"""
SELECT c.store_client_id, c.store_name, CASE
    WHEN {of_cohort('previous', p)} THEN 'previous' WHEN {of_cohort('new', p)} THEN 'new' END AS cohort
FROM account c WHERE {accepted(rule)}"""


def key_violations() -> str:
    """NULL and repeated keys of the relation ``clashing``."""
    return " UNION ALL ".join(
        f"SELECT '{key}' AS key, CAST({key} AS VARCHAR) AS value, count(*) AS rows FROM clashing "
        f"GROUP BY {key} HAVING count(*) > 1 OR {key} IS NULL" for key in ("store_name", "store_client_id"))


# ---- installs ------------------------------------------------------------------------------------


def _kept_events(p: Period, installs: str, cohort: str, rule: PlanFilter) -> str:
    """Install events of a cohort that no churn event of the period is later than."""
    return f"""
SELECT c.store_client_id, i.store_name, i.event_id, i.created_at
FROM activity i, account c
WHERE c.store_name = i.store_name AND {accepted(rule)} AND {of_cohort(cohort, p)}
  AND {is_(installs, 'i')} AND {during('i.created_at', p)}
  AND NOT EXISTS (SELECT 1 FROM activity x
                  WHERE x.store_name = i.store_name AND x.created_at > i.created_at
                    AND {is_('churn', 'x')} AND {during('x.created_at', p)})"""


def surviving_installs(p, rule, cohort="new", installs="install_any") -> str:
    return f"""
SELECT store_client_id, store_name, max(created_at) AS created_at
FROM ({_kept_events(p, installs, cohort, rule)}) GROUP BY ALL"""


def surviving_reinstalls(p, rule) -> str:
    return surviving_installs(p, rule, "previous", "reinstall")


def reopened_stores(p, rule) -> str:
    return f"""
WITH final_moment AS (
    SELECT store_name, max(created_at) AS t FROM activity WHERE {during('created_at', p)} GROUP BY 1
), shut AS (
    SELECT DISTINCT z.store_name FROM activity z JOIN final_moment f
    ON f.store_name = z.store_name AND f.t = z.created_at WHERE {is_('churn_action', 'z')}
)
SELECT c.store_client_id, r.store_name, max(r.created_at) AS created_at
FROM activity r JOIN account c ON c.store_name = r.store_name
WHERE {is_('reopen', 'r')} AND {during('r.created_at', p)} AND {of_cohort('previous', p)}
  AND {accepted(rule)} AND r.store_name NOT IN (SELECT store_name FROM shut)
GROUP BY ALL"""


def install_status(p, rule) -> str:
    return f"""
SELECT *, 'fresh' AS status FROM ({surviving_installs(p, rule)})
UNION ALL SELECT *, 'reinstall' FROM ({surviving_reinstalls(p, rule)})
UNION ALL SELECT *, 'reopen' FROM ({reopened_stores(p, rule)})"""


def status_by_month(p, rule, how="inner") -> str:
    def per_month(body: str, name: str) -> str:
        return (f"(SELECT {month('created_at', p)} AS month, count(*) AS {name} "
                f"FROM ({body}) GROUP BY 1)")

    join = "FULL JOIN" if how == "outer" else "JOIN"
    return f"""
SELECT month, coalesce(fresh_count, 0) AS fresh_count,
       coalesce(re_installs_count, 0) AS re_installs_count, coalesce(re_open_count, 0) AS re_open_count
FROM {per_month(surviving_installs(p, rule), 'fresh_count')}
{join} {per_month(surviving_reinstalls(p, rule), 're_installs_count')} USING (month)
{join} {per_month(reopened_stores(p, rule), 're_open_count')} USING (month)"""


def fresh_count_by_month(p, rule) -> str:
    return f"""
SELECT {month('created_at', p)} AS month, count(DISTINCT store_client_id) AS fresh_count
FROM ({_kept_events(p, 'install_any', 'new', rule)}) GROUP BY 1"""


def installs_to_date(p, window, rule, cohort="new", installs="install_any") -> str:
    return f"""
SELECT DISTINCT store_client_id, store_name FROM ({_kept_events(p, installs, cohort, rule)})
WHERE {during('created_at', window)}"""


def new_not_reinstalled(p, rule) -> str:
    return f"""
SELECT store_client_id, store_name FROM ({_kept_events(p, 'install_any', 'new', rule)})
EXCEPT
SELECT store_client_id, store_name FROM ({_kept_events(p, 'reinstall', 'new', rule)})"""


def install_multiplicity(p, rule) -> str:
    return f"""
SELECT store_client_id, store_name, count(*) AS install_count,
       CASE count(*) WHEN 1 THEN 'single' ELSE 'multiple' END AS install_type
FROM ({_kept_events(p, 'install_any', 'new', rule)}) GROUP BY 1, 2"""


def multiplicity_totals(p, rule) -> str:
    return f"""
SELECT count(*) FILTER (WHERE install_count = 1) AS single, count(*) FILTER (WHERE install_count > 1) AS multiple
FROM ({install_multiplicity(p, rule)})"""


def free_plan_stores(p, rule) -> str:
    return f"""
SELECT s.store_client_id, s.store_name FROM ({surviving_installs(p, rule)}) s
WHERE EXISTS (SELECT 1 FROM activity f
    WHERE f.store_name = s.store_name AND {is_('free_plan', 'f')} AND {during('f.created_at', p)}
      AND NOT EXISTS (SELECT 1 FROM activity g
          WHERE g.store_name = f.store_name AND g.created_at >= f.created_at
            AND {is_('charge_approved', 'g')} AND {during('g.created_at', p)}))"""


def paid_stores(p, rule) -> str:
    return f"""
SELECT s.store_client_id, s.store_name, s.created_at AS fresh_install_date,
       max(g.created_at) AS latest_charge_approved
FROM ({surviving_installs(p, rule)}) s JOIN activity g ON g.store_name = s.store_name
WHERE {is_('charge_approved', 'g')} AND {during('g.created_at', p)}
GROUP BY ALL HAVING max(g.created_at) > s.created_at"""


def onboarding_of_new(p, rule) -> str:
    return f"""
SELECT s.*, EXISTS (SELECT 1 FROM activity d WHERE d.store_name = s.store_name AND {is_('onb_done', 'd')}
                    AND {during('d.created_at', p)}) AS onboarded
FROM ({surviving_installs(p, rule)}) s"""


def onboarding_of_new_totals(p, rule) -> str:
    return f"""
SELECT count(*) AS fresh_installs, count(*) FILTER (WHERE NOT onboarded) AS onboarding_pending,
       count(*) FILTER (WHERE onboarded) AS onboarding_completed FROM ({onboarding_of_new(p, rule)})"""


def conversion_summary(p, rule) -> str:
    return f"""
SELECT (SELECT count(*) FROM ({free_plan_stores(p, rule)})) AS free_plan_users,
       (SELECT count(*) FROM ({paid_stores(p, rule)})) AS charge_approved,
       (SELECT count(*) FROM ({surviving_installs(p, rule)})) AS total_fresh_installs"""


# ---- month state ---------------------------------------------------------------------------------


def installed_at_month_end(p, before=None) -> str:
    """Without ``before`` on the log's own ids; with it on the ids of the accounts, found by name."""
    source = "activity e" if before is None else f"""(
        SELECT a.* REPLACE (c.store_client_id AS store_client_id) FROM activity a
        JOIN account c ON c.store_name = a.store_name WHERE {ahead_of('c.created_on', before)}) e"""
    return f"""
WITH steps AS (
    SELECT e.store_client_id, {month('e.created_at', p)} AS month, e.created_at,
           {is_('uninstall_only', 'e')} AS removal
    FROM {source} WHERE {is_('lifecycle', 'e')} AND {during('e.created_at', p)}
)
SELECT DISTINCT s.store_client_id, s.month, s.created_at FROM steps s
WHERE NOT s.removal AND s.created_at = (SELECT max(t.created_at) FROM steps t
    WHERE t.store_client_id = s.store_client_id AND t.month = s.month)"""


def onboarding_by_month(p, rule, state, before=None) -> str:
    name = {"completed": "completed_same_month", "pending": "pending_in_month"}[state]
    sign = "" if state == "completed" else "NOT"
    banned = f"lower(c.shop_plan) IN ({_quoted(rule.plans)})"
    own = "d.store_client_id = b.store_client_id"
    if before is not None:
        own = "d.store_name = (SELECT k.store_name FROM account k WHERE k.store_client_id = b.store_client_id)"
    return f"""
WITH base AS ({installed_at_month_end(p, before)}), judged AS (
    SELECT b.*, EXISTS (SELECT 1 FROM activity d WHERE {own}
                        AND {is_('onb_done', 'd')} AND {month('d.created_at', p)} = b.month) AS done
    FROM base b WHERE NOT EXISTS (SELECT 1 FROM account c WHERE c.store_client_id = b.store_client_id AND {banned})
)
SELECT month, count(DISTINCT store_client_id) FILTER (WHERE {sign} done) AS {name} FROM judged GROUP BY 1"""


def converted_after_install(p, rule, scope="period") -> str:
    scoped = during("e.created_at", p) if scope == "period" else ahead_of("c.created_on", p)
    again = f"({is_('reinstall_wide', 'z')} AND {is_('reinstall_page', 'z')})"
    return f"""
WITH newest AS (
    SELECT e.store_client_id, max(e.created_at) AS t FROM activity e
    JOIN account c ON c.store_client_id = e.store_client_id
    WHERE {is_('lifecycle', 'e')} AND {scoped} AND {accepted(rule.keeping_null_plan())} GROUP BY 1
), landed AS (
    SELECT z.store_client_id, z.created_at, {is_('fresh', 'z')} AND {is_('fresh_page', 'z')} AS f, {again} AS r
    FROM activity z JOIN newest n ON n.store_client_id = z.store_client_id AND n.t = z.created_at
    WHERE {is_('fresh', 'z')} OR {again}
)
SELECT l.store_client_id, l.created_at, bool_or(l.f) AS is_fresh, bool_or(l.r) AS is_reinstall
FROM landed l JOIN activity u ON u.store_client_id = l.store_client_id
WHERE {is_('upgraded', 'u')} AND u.created_at >= l.created_at GROUP BY 1, 2"""


def paid_installs(p, rule, scope="period") -> str:
    return f"SELECT count(*) AS paid_install_count FROM ({converted_after_install(p, rule, scope)})"


def free_without_upgrade(p, rule, scope="period") -> str:
    scoped = during("e.created_at", p) if scope == "period" else ahead_of("c.created_on", p)
    return f"""
WITH steps AS (
    SELECT e.store_client_id, {month('e.created_at', p)} AS month, e.created_at,
           {is_('fresh', 'e')} AS f, {is_('reinstall_wide', 'e')} AS r
    FROM activity e JOIN account c ON c.store_client_id = e.store_client_id
    WHERE {is_('lifecycle', 'e')} AND {scoped} AND {accepted(rule.keeping_null_plan())}
), newest AS (
    SELECT store_client_id, month, max(created_at) AS t FROM steps GROUP BY 1, 2
), landed AS (
    SELECT s.* FROM steps s JOIN newest n
    ON n.store_client_id = s.store_client_id AND n.month = s.month AND n.t = s.created_at
    WHERE s.f OR s.r
)
SELECT l.store_client_id, l.month, l.created_at, bool_or(l.f) AS is_fresh, bool_or(l.r) AS is_reinstall
FROM landed l JOIN activity v ON v.store_client_id = l.store_client_id
WHERE {is_('free_or_downgraded', 'v')} AND v.created_at >= l.created_at
  AND NOT EXISTS (SELECT 1 FROM activity u WHERE u.store_client_id = l.store_client_id
      AND {is_('upgraded', 'u')} AND u.created_at >= v.created_at AND {month('u.created_at', p)} = l.month)
GROUP BY 1, 2, 3"""


def free_installs(p, rule, by_type=False, scope="period") -> str:
    body = free_without_upgrade(p, rule, scope)
    if by_type:
        return f"""
SELECT {label('month')} AS month,
       count(DISTINCT store_client_id) FILTER (WHERE is_fresh) AS fresh_install_with_trial,
       count(DISTINCT store_client_id) FILTER (WHERE is_reinstall) AS reinstall_with_trial
FROM ({body}) GROUP BY 1"""
    return f"SELECT count(DISTINCT store_client_id) AS free_install_count FROM ({body})"


# ---- subscriptions -------------------------------------------------------------------------------


def active_accounts(p, rule) -> str:
    return f"""
SELECT c.store_client_id, c.store_name, c.charge_approve, c.status FROM account c
WHERE {accepted(rule)} AND {ahead_of('c.created_on', p)}
  AND EXISTS (SELECT 1 FROM activity i WHERE i.store_name = c.store_name AND {is_('install_any', 'i')})
  AND NOT EXISTS (SELECT 1 FROM activity x WHERE x.store_name = c.store_name AND {is_('churn', 'x')})"""


def active_by_plan(p, rule) -> str:
    return f"""
SELECT count(*) FILTER (WHERE status = '1' AND charge_approve IN ('0', '2')) AS free_plan_active_merchants,
       count(*) FILTER (WHERE status = '1' AND charge_approve = '1') AS paid_plan_active_merchants
FROM ({active_accounts(p, rule)})"""


def first_paid(p, rule) -> str:
    return f"""
SELECT c.store_client_id, c.store_name, min(a.created_at) AS first_paid_at
FROM account c JOIN activity a ON a.store_name = c.store_name
WHERE {is_('pricing_plan', 'a')} AND {accepted(rule)} AND {ahead_of('c.created_on', p)}
  AND NOT EXISTS (SELECT 1 FROM activity x WHERE x.store_name = c.store_name AND {is_('uninstall_page', 'x')}
                  AND {local('x.created_at', p)} < TIMESTAMP '{p.hi}')
GROUP BY 1, 2 HAVING {during('min(a.created_at)', p)}"""


def first_paid_by_month(p, rule) -> str:
    return f"""
SELECT {label('s.month')} AS month, count(f.store_name) AS total_stores
FROM (SELECT CAST(unnest(generate_series(DATE '{p.lo.date().replace(day=1)}', DATE '{p.last_day}',
                                         INTERVAL 1 MONTH)) AS DATE) AS month) s
LEFT JOIN ({first_paid(p, rule)}) f ON {month('f.first_paid_at', p)} = s.month GROUP BY 1"""


def latest_snapshot(year_month: str) -> str:
    return f"""
SELECT active_users, free_users, paid_users, app_status, {label('last_month_date')} AS month
FROM snapshot WHERE {label('last_month_date')} = '{year_month}' ORDER BY id DESC LIMIT 1"""


# ---- churn ---------------------------------------------------------------------------------------


def churned_events(p, rule) -> str:
    return f"""
SELECT c.store_client_id, e.store_name, e.event_id, e.action, e.page, e.created_at,
       CASE WHEN {of_cohort('previous', p)} THEN 'previous'
            WHEN {of_cohort('new', p)} THEN 'new' END AS cohort
FROM activity e JOIN account c ON c.store_name = e.store_name
WHERE {is_('churn', 'e')} AND {during('e.created_at', p)} AND {accepted(rule)}
  AND NOT EXISTS (SELECT 1 FROM activity i WHERE i.store_name = e.store_name AND i.created_at > e.created_at
                  AND {is_('install_after_churn', 'i')} AND {during('i.created_at', p)})"""


def churn_buckets(p, rule) -> str:
    again = f"""store_name IN (SELECT i.store_name FROM activity i
        WHERE {is_('reinstall', 'i')} AND {during('i.created_at', p)})"""
    return f"""
WITH gone AS ({churned_events(p, rule)}), marked AS (
    SELECT g.*, {is_('uninstall_action', 'g')} AND cohort IS NOT DISTINCT FROM 'new' AS b1,
           {is_('uninstall_action_wide', 'g')} AND cohort IS NOT DISTINCT FROM 'previous' AS b2,
           {is_('closed', 'g')} AND NOT EXISTS (SELECT 1 FROM activity o WHERE o.store_name = g.store_name
               AND {is_('reopen', 'o')} AND o.created_at > g.created_at) AS b4
    FROM gone g
)
SELECT store_client_id, store_name, bool_or(b1) AS same_month, bool_or(b2) AS previous_month,
       bool_or(b2 AND {again}) AS reinstall_unistall, bool_or(b4) AS store_closed
FROM marked GROUP BY 1, 2 HAVING bool_or(b1 OR b2 OR b4)"""


def churn_bucket_totals(p, rule) -> str:
    names = ("same_month", "previous_month", "reinstall_unistall", "store_closed")
    counts = ", ".join(f"count(*) FILTER (WHERE {n}) AS {n}" for n in names)
    return f"SELECT {counts} FROM ({churn_buckets(p, rule)})"


def churned_new_installs(p, rule) -> str:
    return f"""
WITH gone AS (
    SELECT e.store_name, max(e.created_at) AS t FROM activity e
    WHERE {is_('uninstall', 'e')} AND {during('e.created_at', p)} GROUP BY 1
)
SELECT g.store_name, g.t AS uninstall_at, {month('g.t', p)} AS month
FROM gone g JOIN account c ON c.store_name = g.store_name
WHERE {accepted(rule)}
  AND EXISTS (SELECT 1 FROM activity i WHERE i.store_name = g.store_name AND {is_('fresh_strict', 'i')}
              AND {during('i.created_at', p)} AND {month('i.created_at', p)} = {month('g.t', p)})
  AND NOT EXISTS (SELECT 1 FROM activity i WHERE i.store_name = g.store_name AND i.created_at > g.t
                  AND {is_('install_after_churn', 'i')} AND {during('i.created_at', p)})"""


def last_uninstall(p, rule, uninstalls="uninstall_raw", cohort=None) -> str:
    made = "true" if cohort is None else of_cohort(cohort, p)
    return f"""
SELECT c.store_client_id, max(e.created_at) AS uninstall_at, {month('max(e.created_at)', p)} AS month
FROM activity e JOIN account c ON c.store_client_id = e.store_client_id
WHERE {is_(uninstalls, 'e')} AND {during('e.created_at', p)} AND {accepted(rule)} AND {made}
GROUP BY 1"""


def _ever(cls: str, row: str, key: str, more: str = "true") -> str:
    return f"EXISTS (SELECT 1 FROM activity h WHERE h.{key} = {row}.{key} AND {is_(cls, 'h')} AND {more})"


def plan_at_churn(p, rule, base="new_installs") -> str:
    """Six counts per month."""
    if base == "new_installs":
        key, stores = "store_name", churned_new_installs(p, rule)
    else:
        key, stores = "store_client_id", last_uninstall(p, rule)
    new, old = of_cohort("new", p), of_cohort("previous", p)
    return f"""
WITH facts AS (
    SELECT b.month, {new} AS n, {old} AS o,
           {_ever('trial', 'b', key)} AS trial, {_ever('free_user', 'b', key)} AS free,
           {_ever('uninstall_only', 'b', key)} AS un, {_ever('paid_uninstall', 'b', key)} AS paid
    FROM ({stores}) b JOIN account c ON c.{key} = b.{key}
)
SELECT {label('month')} AS month,
       count(*) FILTER (WHERE n AND trial AND un AND NOT paid) AS during_trial_monthly,
       count(*) FILTER (WHERE o AND trial AND un AND NOT paid) AS during_trial_overall,
       count(*) FILTER (WHERE n AND un AND free) AS free_plan_monthly,
       count(*) FILTER (WHERE o AND un AND free) AS free_plan_overall,
       count(*) FILTER (WHERE n AND paid) AS paid_plan_monthly,
       count(*) FILTER (WHERE o AND paid AND NOT trial) AS paid_plan_overall
FROM facts GROUP BY 1"""


def creation_month_events(p, rule) -> str:
    return f"""
SELECT e.*, {month('e.created_at', p)} AS month
FROM activity e JOIN account c ON c.store_client_id = e.store_client_id
WHERE {during('e.created_at', p)} AND {accepted(rule)}
  AND {month('c.created_on', p)} = {month('e.created_at', p)}"""


def milestones_of_churned(p, rule, base="new_installs") -> str:
    if base == "new_installs":
        key = "store_name"
        rows = f"""SELECT a.*, {month('a.created_at', p)} AS month FROM activity a
            WHERE {during('a.created_at', p)}
              AND a.store_name IN (SELECT store_name FROM ({churned_new_installs(p, rule)}))"""
    else:
        key, rows = "store_client_id", creation_month_events(p, rule)
    reached = ", ".join(
        f"count(DISTINCT k) FILTER (WHERE gone AND {name}) AS {name}" for name in MILESTONES
    )
    flags = ", ".join(f"bool_or({is_(cls, 'r')}) AS {name}" for name, cls in MILESTONES.items())
    return f"""
WITH per_month AS (
    SELECT r.{key} AS k, r.month, {flags},
           coalesce(max(r.created_at) FILTER (WHERE {is_('uninstall_bench', 'r')})
                    > max(r.created_at) FILTER (WHERE {is_('install_bench', 'r')}), false) AS gone
    FROM ({rows}) r GROUP BY 1, 2
)
SELECT {label('month')} AS month, {reached} FROM per_month GROUP BY 1"""


def onboarding_stop_step(p, rule, base="new_installs") -> str:
    if base == "new_installs":
        key, uninstall, stores = "store_name", "uninstall_action", churned_new_installs(p, rule)
    else:
        key, uninstall = "store_client_id", "uninstall_only"
        stores = last_uninstall(p, rule, uninstall)
    within = during("h.created_at", p)
    return f"""
WITH facts AS (
    SELECT (SELECT max(e.created_at) FROM activity e WHERE e.{key} = b.{key}
            AND {is_(uninstall, 'e')} AND {during('e.created_at', p)}) AS t,
           {_ever('onb_step1', 'b', key, within)} AS s1, {_ever('onb_step2', 'b', key, within)} AS s2,
           {_ever('onb_step3', 'b', key, within)} AS s3, {_ever('onb_done', 'b', key, within)} AS s4
    FROM ({stores}) b JOIN account c ON c.{key} = b.{key} WHERE {of_cohort('new', p)}
)
SELECT {label(month('t', p))} AS month,
       count(*) FILTER (WHERE NOT s1 AND NOT s2 AND NOT s3) AS onboarding_step_1,
       count(*) FILTER (WHERE s1 AND NOT s2 AND NOT s3 AND NOT s4) AS onboarding_step_2,
       count(*) FILTER (WHERE s2 AND NOT s3 AND NOT s4) AS onboarding_step_3,
       count(*) FILTER (WHERE s3 AND NOT s4) AS onboarding_step_4,
       count(*) FILTER (WHERE s4) AS onboarding_completed
FROM facts WHERE t IS NOT NULL GROUP BY 1"""


def churned_unfinished(p, rule, final_rule, base="new_installs") -> str:
    if base == "new_installs":
        key, stores = "store_name", churned_new_installs(p, rule)
    else:
        key, stores = "store_client_id", last_uninstall(p, final_rule, "uninstall_only")
    finished = VOCABULARY["onb_step3"] | VOCABULARY["onb_done"]
    return f"""
WITH facts AS (
    SELECT b.month, {_ever(finished, 'b', key)} AS finished, {_ever('app_enabled', 'b', key)} AS enabled
    FROM ({stores}) b JOIN account c ON c.{key} = b.{key}
    WHERE {of_cohort('new', p)} AND {accepted(final_rule)}
)
SELECT {label('month')} AS month, count(*) FILTER (WHERE NOT finished) AS without_onboarding,
       count(*) FILTER (WHERE NOT enabled) AS without_app_enabled FROM facts GROUP BY 1"""
