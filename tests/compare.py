"""Runs a query and its SQL side by side."""

from pathlib import Path

import duckdb


def rounded(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def same(frame, sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(frame.columns) == names
    order = [want.columns.index(n) for n in names]
    expected = sorted((tuple(rounded(r[i]) for i in order) for r in want.fetchall()), key=str)
    found = sorted((tuple(rounded(v) for v in r) for r in frame.select(*names).collect()), key=str)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a == b
    return len(found)
