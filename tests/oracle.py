"""Holds a registered query against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return int(v) if isinstance(v, bool) else v


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_cell(r[i]) for i in order]) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> tuple[list[str], list[str]]:
    mine = query(spark, sf_dir)
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(mine.columns), (names, mine.columns)
    return rows_of(mine.columns, [tuple(r) for r in mine.collect()]), rows_of(names, cur.fetchall())
