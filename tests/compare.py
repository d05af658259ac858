"""Run a query and its SQL on the same tables and compare rows exactly."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def sql_result(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).fetch_df()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            df[c] = df[c].astype(object).where(df[c].notna(), None)
    return df.sort_values(list(df.columns), na_position="first", ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        if str(got[c].dtype) != str(want[c].dtype):
            return f"column {c}: type {got[c].dtype}, expected {want[c].dtype}"
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"column {c} row {i}: {got[c][i]!r}, expected {want[c][i]!r}; {(~same).sum()} rows"
    return None
