"""Spark rows against DuckDB rows of the same tables."""

from pathlib import Path

import duckdb


def rows_of_sql(sf_dir: str, sql: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def _key(row):
    return tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in row)


def check_same(df, sf_dir: str, sql: str, tolerance: float = 2e-6):
    names, want = rows_of_sql(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    have = sorted((tuple(r[n] for n in order) for r in df.collect()), key=_key)
    want = sorted((tuple(r[names.index(n)] for n in order) for r in want), key=_key)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and y is not None and abs(x - y) <= tolerance * max(1, abs(y)), (a, b)
