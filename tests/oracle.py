"""Compare a query with its SQL on the driver's tables, as sorted rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(values: list[tuple]) -> list[tuple]:
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(norm(v) for v in r) for r in values)


def differences(spark, sf_dir: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = rows([tuple(r[n] for n in names) for r in df.collect()])
    con = views(sf_dir)
    theirs = con.sql(sql)
    if sorted(theirs.columns) != names:
        return f"columns {names} and {sorted(theirs.columns)}"
    theirs = rows(con.sql(f"select {', '.join(names)} from ({sql})").fetchall())
    if ours == theirs:
        return ""
    extra = [r for r in ours if r not in set(theirs)][:2], [r for r in theirs if r not in set(ours)][:2]
    return f"{len(ours)} and {len(theirs)} rows; {extra}"
