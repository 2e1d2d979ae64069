"""Per-key profiles against events-against-events SQL on random logs."""

import pytest

from cohortry.functions.period import Period
from tests.compare import assert_same
from tests.logs import Log, random_log
from tests.operator_pairs import pairs

PERIODS = {
    "month": Period.month("2026-02"),
    "part_of_three_months": Period.days("2026-01-20", "2026-03-10"),
    "western_month": Period.month("2026-02", zone="-08:00"),
}


@pytest.mark.parametrize("seed, period", list(enumerate(PERIODS)))
def test_operators_agree(spark, tmp_path, seed, period):
    log = Log(spark, tmp_path, *random_log(seed))
    empty, failures = [], []
    for name, (frame, sql) in pairs(log, PERIODS[period]).items():
        try:
            if assert_same(frame, log.duck, sql) == 0:
                empty.append(name)
        except AssertionError as difference:
            failures.append(f"{name}: {difference}")
    assert not failures, "\n".join(failures)
    assert not empty, f"no rows to compare: {empty}"
