"""Registry of named queries: a Spark plan builder and, where SQL can express
it, the DuckDB oracle text.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame that reads
the whole input tables.  Double columns are rounded to 6 decimals at the very
end (``finish``) so the two engines hash the same values; the oracle text does
the same with :func:`rounded`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.fixtures import with_fixtures
from ..sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register ``fn(t: Tables) -> DataFrame`` under ``key``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        _QUERIES[key] = run
        if sql is not None:
            _ORACLE[key] = with_fixtures(sql)
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (and doubles inside arrays) for hashing."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        d = overrides.get(f.name, digits)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), d).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(
                f.dataType.elementType, (T.DoubleType, T.FloatType)):
            out.append(F.transform(F.col(f.name), lambda x: F.round(x.cast("double"), d))
                       .alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def rounded(sql: str, cols: list[str], digits: int = 6,
            overrides: dict[str, int] | None = None) -> str:
    """Oracle-side counterpart of :func:`finish` for the named double columns."""
    overrides = overrides or {}
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, {overrides.get(c, digits)}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql.strip()}\n) rq"


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


def _load_all():
    # importing the query modules fills the registry
    from . import (q_features, q_governance, q_io, q_joins, q_ml, q_scoring,  # noqa: F401
                   q_stats, q_streams)
