"""Distributed running sums over a sorted value, per group.

KS statistics, exact AUC, exact quantiles and dense label codes all need a
cumulative count over values sorted within a group.  A window over the whole
group would put every row of a feature (or of the whole table) into one task,
so this kernel works in value ranges:

1. distinct ``(group, value)`` rows with summed weights (map-side partial
   aggregation; a hot value becomes one row);
2. those rows are range-partitioned by (group, value) with Spark's own sampled
   range partitioner and written, with the number of their range, to the
   shared folder: as many ranges as the data and the session's partition sizes
   call for, nothing about them on the driver, and a lost executor re-reads
   the written ranges instead of drawing new ones;
3. per (group, range) totals give each range its offset: a window over at most
   groups x ranges rows;
4. a window inside each (group, range) adds the local running sum.

Every task holds one value range, never a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table

_BKT = "_rl_range"


def ranged(distinct: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """``distinct`` (one row per group and value) with the number of the value
    range each row is in, from a table in the shared folder."""
    cut = distinct.repartitionByRange(*group_cols, value_col) \
        .withColumn(_BKT, F.spark_partition_id())
    return scratch_table(cut, "ranges")


def running_sums(df: DataFrame, group_cols: list[str], value_col: str,
                 weight_cols: list[str]) -> DataFrame:
    """Return distinct ``(group..., value)`` rows with, for each weight ``w``:
    ``w`` (sum at this value), ``cum_w`` (sum over values <= this one),
    ``tot_w`` (group total).  Null values are dropped."""
    d = (df.filter(F.col(value_col).isNotNull())
           .groupBy(*group_cols, value_col)
           .agg(*[F.sum(w).alias(w) for w in weight_cols]))
    d = ranged(d, group_cols, value_col)
    part_tot = d.groupBy(*group_cols, _BKT).agg(*[F.sum(w).alias(f"_pt_{w}") for w in weight_cols])
    wg = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    wo = wg.orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, range): small, joined as the optimizer sees fit
    offsets = part_tot.select(
        *group_cols, _BKT,
        *[F.coalesce(F.sum(f"_pt_{w}").over(wo), F.lit(0)).alias(f"_off_{w}") for w in weight_cols],
        *[F.sum(f"_pt_{w}").over(wg).alias(f"tot_{w}") for w in weight_cols])
    wl = (Window.partitionBy(*group_cols, _BKT).orderBy(value_col)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = d.select("*", *[F.sum(w).over(wl).alias(f"_loc_{w}") for w in weight_cols])
    return local.join(offsets, [*group_cols, _BKT]).select(
        *group_cols, value_col, *weight_cols,
        *[(F.col(f"_off_{w}") + F.col(f"_loc_{w}")).alias(f"cum_{w}") for w in weight_cols],
        *[F.col(f"tot_{w}") for w in weight_cols])


def rank_values(value: str, weight: str, probs: list[float], prefix: str = "_q") -> list:
    """Aggregates over :func:`running_sums` rows that give, for every
    probability, the values at the floor and the ceiling of rank p (N - 1) of
    the sample weighted by ``weight``."""
    out = []
    for i, p in enumerate(probs):
        k = F.lit(float(p)) * (F.col(f"tot_{weight}") - 1)
        for name, r in (("lo", F.floor(k)), ("hi", F.ceil(k))):
            out.append(F.min(F.when((F.col(weight) > 0) & (F.col(f"cum_{weight}") > r),
                                    F.col(value))).alias(f"{prefix}{name}{i}"))
    return out


def rank_quantile(i: int, p: float, total, prefix: str = "_q"):
    """The linear-interpolated quantile from the columns of :func:`rank_values`."""
    k = F.lit(float(p)) * (total - 1)
    lo, hi = F.col(f"{prefix}lo{i}"), F.col(f"{prefix}hi{i}")
    return lo + (k - F.floor(k)) * (hi - lo)


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    group_cols: list[str] | None = None,
                    weight_col: str | None = None) -> DataFrame:
    """numpy/pandas default (linear interpolation) quantiles, exact, without
    gathering a group's values in one task: one aggregate over the running
    sums.  ``weight_col`` gives a count per row (value-count input).  Returns
    ``(group..., prob, quantile)``, one row per requested probability."""
    g = list(group_cols or [])
    w = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    base = (df.select(*g, F.col(value_col).cast("double").alias("_v"), w.alias("_w"))
            .filter(F.col("_v").isNotNull() & (F.col("_w") > 0)))
    rs = running_sums(base, g, "_v", ["_w"])
    per = rs.groupBy(*g).agg(F.max("tot__w").alias("_n"), *rank_values("_v", "_w", probs))
    rows = F.array(*[F.struct(F.lit(float(p)).alias("prob"),
                              rank_quantile(i, p, F.col("_n")).alias("quantile"))
                     for i, p in enumerate(probs)])
    return (per.filter(F.col("_n") > 0).select(*g, F.explode(rows).alias("_r"))
            .select(*g, "_r.prob", "_r.quantile"))


def code_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """One dictionary ``(column, value, code)`` for several categorical
    columns at once: 0-based codes by sorted distinct value (label encoding),
    from one unpivot, one distinct and one running count per column."""
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "_col", "_k").filter(F.col("_k").isNotNull()).distinct()
            .withColumn("_one", F.lit(1).cast("long")))
    rs = running_sums(long, ["_col"], "_k", ["_one"])
    return rs.select(F.col("_col").alias("column"), F.col("_k").alias("value"),
                     (F.col("cum__one") - 1).cast("int").alias("code"))


def apply_codes(df: DataFrame, dictionary: DataFrame, cols: list[str],
                suffix: str = "_encoded") -> DataFrame:
    """Each column's codes from a fitted dictionary; a value the dictionary
    does not hold gets -1, null stays null.  A slice of the dictionary has one
    row per distinct value: the optimizer broadcasts small ones and AQE splits
    the hot values of large ones."""
    out = df
    for c in cols:
        d = dictionary.filter(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"))
        out = out.join(d, F.col(c).cast("string") == F.col("_value"), "left").withColumn(
            f"{c}{suffix}", F.when(F.col(c).isNotNull(), F.coalesce("_code", F.lit(-1)))
        ).drop("_value", "_code")
    return out


def dense_codes(df: DataFrame, col: str, code_col: str | None = None) -> DataFrame:
    """0-based code of each value of one column by sorted distinct value."""
    out = apply_codes(df, code_dictionary(df, [col]), [col], "_rl_code")
    return out.withColumnRenamed(f"{col}_rl_code", code_col or f"{col}_encoded")
