"""Rows of Spark and of DuckDB in one form."""

import glob
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x if isinstance(x, (bool, str, bytes)) or not hasattr(x, "__float__") else float(f"{float(x):.9g}")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None)), key=repr)
