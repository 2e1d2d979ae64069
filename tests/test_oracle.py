"""Every registered query against its independent SQL."""

import pytest

from tests.compare import assert_same
from verification.cases import cases

CASES = cases()


@pytest.mark.parametrize("name", sorted(CASES))
def test_matches_sql(spark, duck_for, name):
    case = CASES[name]
    rows = assert_same(case.run(spark, "/root/testdata/sf0.01"), duck_for("0.01"), case.sql)
    assert rows > 0
