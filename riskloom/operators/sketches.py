"""Approximate statistics from mergeable quantile sketches.

A baseline over 100 TB should not be read again because one more day arrived.
Every snapshot leaves one KLL sketch per feature (a few kilobytes, built by
map-side partial aggregation, no sort and no shuffle of rows); the baseline of
any set of snapshots is the merge of their sketches.  Quantile edges, shares
per bin, PSI and the two-sample KS statistic come from the merged sketches,
each with its rank error at the sketch's ``k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats as st

#: accuracy parameter of the sketches
K = 2000


def rank_error(k: int = K, share: bool = False) -> float:
    """Normalised rank error of a KLL sketch at 99 % confidence: of one rank,
    or of a share between two edges (the published fits of the sketch)."""
    return 2.446 / k ** 0.9433 if share else 2.296 / k ** 0.9021


def sketched(long: DataFrame, k: int = K) -> DataFrame:
    """(feature, n, lo, hi, sketch) of (feature, value) rows; nulls and NaN
    are left out, a feature without values has no row."""
    v = F.col("value").cast("double")
    return (long.select("feature", v.alias("value"))
            .filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feature").agg(
                F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
                F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")))


def merged(sketches: DataFrame) -> DataFrame:
    """One sketch per feature from any number of them."""
    return sketches.groupBy("feature").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def store_snapshot(sketches: DataFrame, path: str, snapshot: str) -> None:
    """Keep a snapshot's sketches; storing it again replaces it."""
    sketches.write.mode("overwrite").parquet(f"{path}/snapshot={snapshot}")


def stored_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The baseline of all stored snapshots: a read of their sketches only."""
    return merged(spark.read.parquet(path))


def quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """Adds ``quantiles``: the values at ``probs``; the extremes are exact."""
    q = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
    ends = F.transform(F.arrays_zip(q.alias("q"), F.array(*[F.lit(float(p)) for p in probs])
                                    .alias("p")),
                       lambda x: F.when(x["p"] <= 0, F.col("lo")).when(x["p"] >= 1, F.col("hi"))
                       .otherwise(x["q"]))
    return sketches.withColumn("quantiles", ends)


def quantile_edges(sketches: DataFrame, n_bins: int = 10) -> DataFrame:
    """A3, approximate: (feature, edges), distinct and ascending."""
    q = quantiles(sketches, [i / n_bins for i in range(n_bins + 1)])
    return q.select("feature", F.array_sort(F.array_distinct("quantiles")).alias("edges"))


#: steps of the quantile grid that ranks of arbitrary values are read from
POINTS = 500


def _gridded(sketches: DataFrame) -> DataFrame:
    return quantiles(sketches, [i / POINTS for i in range(POINTS + 1)])


def _below(grid: Column, v: Column) -> Column:
    """Share of the values at or below ``v``: the last step of the quantile
    grid that does not exceed it (off by one step and the rank error)."""
    return F.greatest(F.size(F.filter(grid, lambda q: q <= v)) - 1, F.lit(0)) / F.lit(POINTS)


def shares(sketches: DataFrame, edges: DataFrame) -> DataFrame:
    """A5, approximate: (feature, pos, lo, hi, proporcao) of the bins between
    ``edges`` (the first bin holds what is at or below its upper edge, the last
    what is above its lower one)."""
    j = _gridded(sketches).join(edges, "feature").filter(F.size("edges") >= 2)
    inner = F.slice("edges", F.lit(2), F.size("edges") - 2)
    cum = F.concat(F.array(F.lit(0.0)), F.transform(
        inner, lambda e: _below(F.col("quantiles"), e)), F.array(F.lit(1.0)))
    j = j.select("feature", "edges", cum.alias("cum"))
    return j.select("feature", "edges", "cum", F.explode(
        F.sequence(F.lit(1), F.size("edges") - 1)).alias("i")).select(
        "feature", (F.col("i") - 1).alias("pos"), F.col("edges")[F.col("i") - 1].alias("lo"),
        F.col("edges")[F.col("i")].alias("hi"),
        (F.col("cum")[F.col("i")] - F.col("cum")[F.col("i") - 1]).alias("proporcao"))


def psi(ref: DataFrame, cur: DataFrame, n_bins: int = 10) -> DataFrame:
    """A6, approximate: PSI of two sketches over the reference's edges, shares
    clipped at 1e-6."""
    edges = quantile_edges(ref, n_bins)
    a = shares(ref, edges).select("feature", "pos", F.greatest("proporcao", F.lit(st.EPS)).alias("a"))
    b = shares(cur, edges).select("feature", "pos", F.greatest("proporcao", F.lit(st.EPS)).alias("b"))
    gap = (F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a"))
    return a.join(b, ["feature", "pos"]).groupBy("feature").agg(F.sum(gap).alias("psi"))


def ks_two_sample(ref: DataFrame, cur: DataFrame, k: int = K) -> DataFrame:
    """A8, approximate: the largest gap of the two sketches' ranks over the
    quantile grids of both, and ``erro``: what it can be off by, the rank error
    and the steps of either side."""
    a = _gridded(ref).select("feature", F.col("n").alias("n_ref"), F.col("quantiles").alias("qa"))
    b = _gridded(cur).select("feature", F.col("n").alias("n_cur"), F.col("quantiles").alias("qb"))
    at = F.array_distinct(F.concat("qa", "qb"))
    gaps = F.transform(at, lambda v: F.abs(_below(F.col("qa"), v) - _below(F.col("qb"), v)))
    return a.join(b, "feature").select(
        "feature", "n_ref", "n_cur", F.array_max(gaps).alias("ks_statistic"),
        F.lit(2 * rank_error(k) + 3 / POINTS).alias("erro"))
