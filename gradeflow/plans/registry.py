"""Query registry: every operator of SURVEY section 2 as a named query.

Each entry pairs a Spark builder ``fn(fx: Fixture) -> DataFrame`` with an
optional DuckDB SQL oracle over the same Parquet tables.  Double columns are
rounded to 6 decimals on both sides (sum order differs between engines).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.sources.fixtures import TABLES, Fixture, with_views

REGISTRY: dict[str, tuple[Callable[[Fixture], DataFrame], str | None]] = {}

# Shared SQL building blocks (DuckDB side) beyond the FIXTURES views.
EXTRA_SQL: dict[str, str] = {}
EXTRA_DEPS: dict[str, list[str]] = {}


def sql_view(name: str, deps: list[str], body: str) -> None:
    EXTRA_SQL[name] = body
    EXTRA_DEPS[name] = deps


def oracle(body: str, *views: str) -> str:
    if body.lstrip().upper().startswith("WITH"):  # the views are a WITH themselves
        body = f"SELECT * FROM ({body}) _body"
    return with_views(body, *views, extra=EXTRA_SQL, extra_deps=EXTRA_DEPS)


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType)


GRID = 1048576.0  # 2**20
UNROUNDED = 4398046511104.0  # 2**42


def r6(c):
    """Round to the binary grid 2**-20 (about 1e-6) with exact IEEE steps.

    The same expression runs on the DuckDB side.  A decimal grid would put
    exact ties on values such as 89.17 / 32 = 2.7865625, where a last-bit
    difference from summation order flips the rounded digit; values with a
    decimal fraction never land exactly on a binary half-step.  NaN, infinities
    and values that the grid's integers can't hold pass as they are."""
    x = c.cast("double")
    rounded = F.floor(x * F.lit(GRID) + F.lit(0.5)) / F.lit(GRID)
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(UNROUNDED)), x).otherwise(rounded)


def round_doubles(df: DataFrame) -> DataFrame:
    """Normalise output types: doubles rounded (``r6``), small ints to BIGINT."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(r6(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, _INTEGRAL):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


_FLOATS = ("DOUBLE", "FLOAT", "REAL", "DECIMAL")
_INTS = ("HUGEINT", "INTEGER", "SMALLINT", "TINYINT", "UBIGINT", "UINTEGER", "USMALLINT", "UTINYINT",
         "INT128", "UHUGEINT")


def finalize_sql(sql: str, sf_dir: str) -> str:
    """Wrap an oracle query so its output types match the Spark side:
    doubles rounded with the same expression as ``r6``, integers as BIGINT.
    Column types come from DuckDB's binder (``DESCRIBE``, nothing is run) over
    the tables in ``sf_dir``."""
    import duckdb
    con = duckdb.connect()
    for t in (*TABLES, "documents", "pages", "benchmark", "labels", "conversations"):
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    desc = con.execute(f"DESCRIBE {sql}").fetchall()
    repl = []
    for name, typ, *_ in desc:
        q = '"' + name.replace('"', '""') + '"'
        base = typ.split("(")[0].upper()
        if base in _FLOATS:
            x = f"CAST({q} AS DOUBLE)"
            repl.append(f"CASE WHEN isnan({x}) OR abs({x}) >= {UNROUNDED!r} THEN {x} "
                        f"ELSE floor({x} * {GRID!r} + 0.5) / {GRID!r} END AS {q}")
        elif base in _INTS:
            repl.append(f"CAST({q} AS BIGINT) AS {q}")
    if not repl:
        return sql
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{sql}\n) AS _oracle"


def build(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn, _ = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(Fixture(spark, sf_dir)))

    run.__name__ = name
    return run


def load_all() -> None:
    """Import every module that registers queries."""
    from gradeflow.plans import queries  # noqa: F401
