"""Compares a query's rows with DuckDB's."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def database(where: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(where).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def shown(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(df) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(df.columns)
    return names, sorted(tuple(shown(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(shown(r[i]) for i in order) for r in found.fetchall())
