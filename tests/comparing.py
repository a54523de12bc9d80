"""A query's rows against those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str | bytes):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(f"{float(v):.7g}")


def table(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, found.fetchall())
