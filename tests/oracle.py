"""Runs a query on Spark and its SQL on DuckDB and compares their rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd


def rows(frame) -> Counter:
    columns = sorted(frame.columns)
    clean = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return Counter(tuple(clean(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def sql_rows(sf: str, sql: str):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con.sql(sql).df()


def same(spark, sf: str, query, sql: str) -> None:
    got, want = query(spark, sf).toPandas(), sql_rows(sf, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
