"""Window-style operators (W1-W7) and sort / top-k (K1-K3).

Per-key windows are replaced by aggregates with map-side combine wherever the
semantics allow (a hot account or model must not land in one task), and the
trailing-count window is split into time buckets so no task ever holds more
than one account-day (plus the previous day) of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col, ts_lit
from .ordered import dense_codes

HOUR_US = 3600 * 1_000_000
DAY_US = 24 * HOUR_US


# --- W1 ---------------------------------------------------------------------
def account_mean(df: DataFrame, key: str = "conta_id", value: str = "valor",
                 out: str = "avg_transaction_value") -> DataFrame:
    """Per-key mean attached to every row.  Partial aggregation then an equi
    join (AQE splits a skewed key on the big side), instead of a window whose
    partition would be the whole hot key."""
    means = df.groupBy(key).agg(F.avg(value).alias(out))
    return df.join(means, key, "left")


# --- W2 ---------------------------------------------------------------------
def _micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def trailing_counts(df: DataFrame, key: str = "conta_id", ts: str = "data_transacao",
                    row_id: str = "id", hour_col: str = "transactions_last_hour",
                    day_col: str = "transactions_last_day") -> DataFrame:
    """Rows of the same key with time in [t - 1 h, t] and [t - 24 h, t]
    (peers at t included).  Windows run per (key, hour): a row also stands, as
    a bare time, in the hour 1 h and 24 h later, where it tells how many rows
    of that older hour the frame still reaches.  The whole hours between come
    from a table of counts per (key, hour).  No task holds more than three
    hours of one key."""
    us = _micros(ts)
    own = df.withColumns({"_us": us, "_b": F.floor(us / F.lit(HOUR_US)), "_kind": F.lit(0)})
    bare = own.select(key, "_us", "_b")
    older = [bare.select(key, (F.col("_us") + F.lit(h * HOUR_US)).alias("_us"),
                         (F.col("_b") + F.lit(h)).alias("_b"), F.lit(k).alias("_kind"))
             for k, h in ((1, 1), (2, 24))]
    rows = own
    for o in older:
        rows = rows.unionByName(o, allowMissingColumns=True)
    part = Window.partitionBy(key, "_b")
    until = part.orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    before = part.orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    of = lambda k, w: F.count(F.when(F.col("_kind") == k, 1)).over(w)
    reached = lambda k: of(k, part) - of(k, before)  # noqa: E731  at or after t - h
    counted = rows.withColumns({"_n": of(0, until), "_h1": reached(1), "_h24": reached(2)}) \
        .filter(F.col("_kind") == 0)
    # whole hours between: at most one row per key and hour
    hours = bare.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    span = Window.partitionBy(key).orderBy("_b").rangeBetween(-23, -1)
    mid = hours.select(key, "_b", F.coalesce(F.sum("_c").over(span), F.lit(0)).alias("_mid"))
    out = counted.join(mid, [key, "_b"], "left")
    return out.select(*df.columns, (F.col("_n") + F.col("_h1")).alias(hour_col),
                      (F.col("_n") + F.col("_h24") + F.coalesce("_mid", F.lit(0))).alias(day_col))


# --- W3 ---------------------------------------------------------------------
DECAY_METRICS = ["auc_roc", "precision", "recall", "f1", "ks_statistic"]


def metric_decay(metrics: DataFrame, as_of: str, window_days: int, ts_col: str = "timestamp",
                 metric_cols: list[str] | None = None) -> DataFrame:
    """First vs last metric row inside the window (>= 2 rows needed): one row
    per metric with base > 0, delta % rounded to 2 and a window-wide
    ``degradacao`` flag (any delta < -10)."""
    metric_cols = [m for m in (metric_cols or DECAY_METRICS) if m in metrics.columns]
    cutoff = ts_lit(as_of) - F.make_dt_interval(F.lit(window_days))
    win = metrics.filter(F.col(ts_col).cast("timestamp_ntz") >= cutoff)
    ends = win.agg(
        F.count(F.lit(1)).alias("n_amostras_janela"),
        F.min_by(F.struct(*metric_cols), F.col(ts_col)).alias("first"),
        F.max_by(F.struct(*metric_cols), F.col(ts_col)).alias("last"))
    arr = F.filter(F.array(*[
        F.struct(F.lit(m).alias("metrica"),
                 F.col(f"first.{m}").cast("double").alias("baseline"),
                 F.col(f"last.{m}").cast("double").alias("atual")) for m in metric_cols]),
        lambda s: s["baseline"] > 0)
    arr = F.transform(arr, lambda s: F.struct(
        s["metrica"].alias("metrica"), s["baseline"].alias("baseline"), s["atual"].alias("atual"),
        F.round((s["atual"] - s["baseline"]) / s["baseline"] * 100, 2).alias("delta_percentual")))
    # one-row aggregate -> flag and rows without any join
    return (ends.filter(F.col("n_amostras_janela") >= 2)
            .select("n_amostras_janela", arr.alias("m"))
            .select("n_amostras_janela",
                    F.exists("m", lambda s: s["delta_percentual"] < -10).alias("degradacao"),
                    F.explode("m").alias("m"))
            .select(F.lit(window_days).alias("window_days"), "n_amostras_janela", "m.*",
                    "degradacao"))


# --- F5 -----------------------------------------------------------------------
def window_filter(df: DataFrame, ts_col: str, as_of: str, hours: int = 0,
                  days: int = 0) -> DataFrame:
    """Rows with time >= as_of - window (a literal bound: pushed to the scan,
    prunes date partitions)."""
    cutoff = ts_lit(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))
    return df.filter(F.col(ts_col).cast("timestamp_ntz") >= cutoff)


# --- W4 ---------------------------------------------------------------------
def last_n(df: DataFrame, ts_col: str, n: int = 24) -> DataFrame:
    """Newest ``n`` rows (TakeOrderedAndProject: per-partition top-n then one
    merge of at most n x partitions rows)."""
    return df.orderBy(F.col(ts_col).desc()).limit(n)


def retain(df: DataFrame, ts_col: str, keep: int) -> DataFrame:
    """History retention: keep the newest ``keep`` rows (bounded deque)."""
    return last_n(df, ts_col, keep)


# --- W5 ---------------------------------------------------------------------
def label_codes(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """0-based code by sorted distinct value (LabelEncoder)."""
    return dense_codes(df, c, out)


# --- W6 ---------------------------------------------------------------------
def best_candidate(cands: DataFrame, key: str = "case_key", idx: str = "idx",
                   score: str = "score") -> DataFrame:
    """Per key: highest score > 0, first index on ties; else candidate 0.
    ``max_by`` over struct(score, -idx) is a partial aggregate."""
    ranked = F.struct(F.when(F.col(score) > 0, F.col(score)).otherwise(F.lit(None)).alias("s"),
                      (-F.col(idx)).alias("neg_idx"))
    best = cands.groupBy(key).agg(
        F.max(F.when(F.col(score) > 0, ranked)).alias("_best"))
    return best.select(key, F.coalesce(-F.col("_best.neg_idx"), F.lit(0)).alias("best_idx"))


# --- W7 ---------------------------------------------------------------------
def latest_version(versions: DataFrame, model_col: str = "modelo",
                   ts_col: str = "criado_em", version_col: str = "versao") -> DataFrame:
    """Newest version per model by creation time (ties: highest version)."""
    return versions.groupBy(model_col).agg(
        F.max_by(F.col(version_col), F.struct(F.col(ts_col), F.col(version_col)))
        .alias(version_col),
        F.max(ts_col).alias(ts_col))


# --- K1 ---------------------------------------------------------------------
def top_attributions(df: DataFrame, arr_col: str, k: int = 10, out: str = "top") -> DataFrame:
    """Per row: the k entries of an array<struct<feature, valor>> with the
    largest |valor|, rounded to 6 decimals (ties keep feature order)."""
    ranked = F.array_sort(
        F.col(arr_col),
        lambda a, b: F.when(F.abs(a["valor"]) > F.abs(b["valor"]), -1)
        .when(F.abs(a["valor"]) < F.abs(b["valor"]), 1)
        .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1)
        .otherwise(0))
    return df.withColumn(out, F.transform(
        F.slice(ranked, 1, k),
        lambda s: F.struct(s["feature"].alias("feature"),
                           F.round(F.abs(s["valor"]), 6).alias("valor"))))


# --- K2 ---------------------------------------------------------------------
def importance_ranking(importances: DataFrame, value_col: str = "importance") -> DataFrame:
    """Features by importance descending (a small per-model table)."""
    return importances.orderBy(F.col(value_col).desc(), F.col("feature"))


# --- K3 ---------------------------------------------------------------------
def head_cases(df: DataFrame, key: str, n: int = 200) -> DataFrame:
    """First ``n`` rows made deterministic by key order (top-k feature)."""
    return df.orderBy(key).limit(n)
