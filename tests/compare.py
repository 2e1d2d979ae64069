"""Order-insensitive comparison of result rows by column name."""

from __future__ import annotations

from collections import Counter


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def spark_rows(frame) -> tuple[list[str], Counter]:
    return sorted(frame.columns), _rows(frame.columns, frame.collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), _rows(columns, cursor.fetchall())


def assert_same(frame, con, sql: str) -> int:
    """Both sides agree on columns and rows; returns the number of rows."""
    columns, got = spark_rows(frame)
    wanted_columns, wanted = duck_rows(con, sql)
    assert columns == wanted_columns
    missing, extra = wanted - got, got - wanted
    assert not missing and not extra, f"missing {list(missing)[:5]} extra {list(extra)[:5]}"
    return sum(got.values())
