"""Compare a query with its SQL over the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, (float, np.floating)) and math.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return float(x)
    return [plain(y) for y in x] if isinstance(x, (list, tuple, np.ndarray)) else str(x)


def canonical(df):
    cols = sorted(df.columns)
    return cols, sorted(([plain(x) for x in r] for r in df[cols].itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])
