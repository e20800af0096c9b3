"""Compare registered queries with their SQL in DuckDB: row count, column names and exact cells."""

from __future__ import annotations

import pathlib
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = pathlib.Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for k in df.columns:
        if df[k].dtype == object:
            df[k] = df[k].map(lambda v: v if v is None or isinstance(v, (str, int, float, bool)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def kind(dtype) -> str:
    s = str(dtype)
    return {"str": "object", "string": "object"}.get(s, s)


def compare(spark, con, name, run, sql, sf_dir) -> tuple[str, float, int]:
    t = time.time()
    got = normal(run(spark, sf_dir).toPandas())
    took = time.time() - t
    want = normal(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} vs {list(want.columns)}", took, len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", took, len(got)
    bad = []
    for k in got.columns:
        a, b = got[k], want[k]
        if kind(a.dtype) != kind(b.dtype):
            bad.append(f"{k}: type {a.dtype} vs {b.dtype}")
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            bad.append(f"{k}: {int((~same).sum())} cells, e.g. {a[i]!r} vs {b[i]!r}")
    return "; ".join(bad), took, len(got)
