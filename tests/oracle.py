"""Holding a query's rows against those of its SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def _plain(v) -> str:
    if v is None:
        return "null"
    assert not (isinstance(v, float) and v != v), "NaN, which no comparison of values can hold equal"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


def rows_of(frame) -> Counter:
    """Of an Arrow table, which tells null from NaN."""
    cols = sorted(frame.column_names)
    return Counter(tuple(_plain(v) for v in r) for r in zip(*(frame.column(c).to_pylist() for c in cols), strict=True))


def of_sql(sql: str, folder: str):
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.sql(sql).to_arrow_table()


def same(frame, other) -> None:
    assert sorted(frame.column_names) == sorted(other.column_names)
    x, y = rows_of(frame), rows_of(other)
    assert x == y, (list((x - y).items())[:3], list((y - x).items())[:3])
