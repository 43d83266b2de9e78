"""Side-by-side check of registered queries against their DuckDB oracle (the same comparison the
correctness gate makes: row count, column names, order-insensitive values)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import time

import numpy as np
import pandas as pd

from ..session import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (np.floating, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def duckdb_con(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, query, sql, sf_dir, con=None) -> dict:
    con = con or duckdb_con(sf_dir)
    t0 = time.time()
    got = query(spark, sf_dir).toPandas()
    t1 = time.time()
    res = {"query": name, "spark_rows": len(got), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    exp = con.execute(sql).fetchdf()
    res["oracle_rows"] = len(exp)
    res["columns_match"] = sorted(got.columns) == sorted(exp.columns)
    if not res["columns_match"]:
        res["status"] = f"columns differ: {sorted(got.columns)} vs {sorted(exp.columns)}"
        return res
    a, b = _rows(got), _rows(exp)
    res["status"] = "match" if a == b else "MISMATCH"
    if a != b:
        sa, sb = set(a), set(b)
        res["only_spark"] = [repr(x)[:300] for x in list(sa - sb)[:2]]
        res["only_oracle"] = [repr(x)[:300] for x in list(sb - sa)[:2]]
    return res
