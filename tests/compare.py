"""Runs registered queries next to their DuckDB twins."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.map(lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str:
    a, b = canonical(spark_frame), canonical(duck_frame)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    off = (a != b).any(axis=1)
    return "" if not off.any() else f"{int(off.sum())} rows differ:\n{a[off].head(4)}\n{b[off].head(4)}"
