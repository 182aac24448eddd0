"""Compares a query with its SQL on the same tables, as sets of rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def value(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(value(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        x = float(x)
        return int(x) if x == int(x) else round(x, 9)
    return str(x) if isinstance(x, pd.Timestamp) else x


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr(tuple(map(value, r))) for r in df.itertuples(index=False))
