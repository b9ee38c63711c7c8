"""Null-safe Column helpers shared by every operator.

All helpers return Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> null for double columns (pandas treats both as missing)."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def clip(c, lo=None, hi=None) -> Column:
    """pandas-style clip: null stays null (Spark least/greatest skip nulls)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def safe_div(num, den) -> Column:
    """Division that yields null instead of raising under ANSI mode."""
    return F.try_divide(col(num), col(den))


def seconds_between(start, end) -> Column:
    """Whole seconds from ``start`` to ``end``; time-zone independent for
    timestamp_ntz columns."""
    return F.timestamp_diff("SECOND", col(start), col(end))


def whole_days_between(start, end) -> Column:
    """Number of whole 24-hour periods (PostgreSQL ``EXTRACT(DAY FROM a-b)``,
    pandas ``.days``), not calendar-day boundaries."""
    return F.floor(seconds_between(start, end) / F.lit(SECONDS_PER_DAY)).cast("long")


def ts_lit(ts: str) -> Column:
    """A timestamp_ntz literal (matches the driver's parquet timestamps)."""
    return F.lit(ts).cast("timestamp_ntz")


def round6(c) -> Column:
    return F.round(col(c), 6)


def word_count(c) -> Column:
    """Python ``len(s.split())``: the number of non-whitespace runs (one
    regex pass); blank or null text has zero words."""
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"\S+"))
