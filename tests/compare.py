"""A query's rows against its SQL on the same tables, as sets with counts; floats to six decimals."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, list):
        return tuple(map(_plain, value))
    return float(value) if hasattr(value, "as_tuple") else value


def rows_of(table) -> Counter:
    names = sorted(table.column_names)
    return Counter(zip(*[[_plain(v) for v in table.column(n).to_pylist()] for n in names], strict=True)) if names else Counter()


def same(spark, module, name: str, folder: str) -> None:
    got = module.QUERIES[name](spark, folder).toArrow()
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(module.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    a, b = rows_of(got), rows_of(want)
    assert a == b, f"only here: {list((a - b).items())[:3]}; only in SQL: {list((b - a).items())[:3]}"
