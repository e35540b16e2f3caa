"""Spark-vs-DuckDB comparison used by the tests and by ``scripts/check_oracle.py``.

Mirrors the driver's check: row count, column names (sorted), and an
order-insensitive comparison of the values (doubles rounded to 6 decimals).
"""

from __future__ import annotations

import math

import duckdb

from gradeflow.sources.fixtures import TABLES

ALL_TABLES = TABLES + ("documents", "pages", "benchmark", "labels", "conversations")


def duck(sql: str, sf_dir: str):
    import os
    con = duckdb.connect()
    for t in ALL_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con.execute(sql).df()


def _norm(v):
    if v is None:
        return (0, "")
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return (0, "")
    except Exception:  # pragma: no cover
        pass
    if isinstance(v, bool):
        return (1, str(v))
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        if v == 0:
            v = 0.0
        return (2, repr(v))
    if isinstance(v, int):
        return (2, repr(float(v)))
    if isinstance(v, (list, tuple)):
        return (3, str([_norm(x) for x in v]))
    return (4, str(v))


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out)


def compare(spark_pdf, duck_pdf, tol: float = 0.0):
    sc, sr = rows_of(spark_pdf)
    dc, dr = rows_of(duck_pdf)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count differs: spark={len(sr)} duck={len(dr)}"
    bad = 0
    first = None
    for a, b in zip(sr, dr):
        if a == b:
            continue
        ok = True
        for x, y in zip(a, b):
            if x == y:
                continue
            if x[0] == 2 and y[0] == 2 and abs(float(x[1]) - float(y[1])) <= tol * max(1.0, abs(float(x[1]))):
                continue
            ok = False
        if not ok:
            bad += 1
            first = first or (a, b)
    if bad:
        return False, f"{bad} rows differ, first: spark={first[0]} duck={first[1]}"
    exact = sr == dr
    return True, "exact" if exact else "within rounding"
