"""Statistics (A2-A21, F3-F5, J4, J5) over long-form ``(feature, value)`` frames.

Many features are handled at once: a wide frame is unpivoted once and every
statistic groups by ``feature``.  Ordered statistics (quantiles, KS, AUC) go
through :mod:`riskloom.operators.ordered`, never through a window over a whole
feature.  Bin edges and totals are one row per feature (a size bounded by the
column list) and are broadcast: a join dealt by the feature would put all of a
feature's values into one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import col
from .ordered import exact_quantiles, rank_quantile, rank_values, running_sums

EPS = 1e-6


# --- F3 / F4 ------------------------------------------------------------------
def valid(c) -> Column:
    """Non-null and not NaN."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c)


def drop_missing(df: DataFrame, c: str) -> DataFrame:
    return df.filter(valid(c))


_NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.DoubleType, T.FloatType)


def pick_feature_columns(df: DataFrame, exclude=("id_cliente", "inadimplente", "event_timestamp")):
    """(numeric, categorical) column names from the schema."""
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]
    cat = [f.name for f in df.schema.fields
           if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    return num, cat


def to_long(df: DataFrame, cols: list[str], ids: list[str] | None = None) -> DataFrame:
    """Unpivot numeric columns to ``(ids..., feature, value double)``; null and
    NaN values are dropped (F3)."""
    ids = ids or []
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return (wide.unpivot(ids, cols, "feature", "value").filter(valid("value")))


def to_long_cat(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot categorical columns to ``(feature, category)``; nulls dropped."""
    wide = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "category").filter(F.col("category").isNotNull())


# --- A2 -----------------------------------------------------------------------
def value_shares(long_cat: DataFrame) -> DataFrame:
    """Per feature: share of each category among non-null values."""
    counts = long_cat.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(tot), "feature").select(
        "feature", "category", "n", (F.col("n") / F.col("total")).alias("share"))


# --- value counts ---------------------------------------------------------------
def value_counts(ref_long: DataFrame, cur_long: DataFrame) -> DataFrame:
    """(feature, value, a, b): how often each value occurs in the reference
    (a) and current (b) sample.  One shuffle; every two-sample statistic
    below (bins, PSI, KS, sizes) reads this table, which holds one row per
    distinct value however often it repeats."""
    both = (ref_long.select("feature", "value", F.lit(1).cast("long").alias("a"),
                            F.lit(0).cast("long").alias("b"))
            .unionByName(cur_long.select("feature", "value", F.lit(0).cast("long").alias("a"),
                                         F.lit(1).cast("long").alias("b"))))
    return both.groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def value_profile(ref_long: DataFrame, cur_long: DataFrame) -> DataFrame:
    """The value counts in order: (feature, value, a, b) with running and total
    counts of both samples.  One ordering serves sizes, quantiles, bins, PSI
    and KS."""
    return running_sums(value_counts(ref_long, cur_long), ["feature"], "value", ["a", "b"])


# --- A3 -----------------------------------------------------------------------
def quantile_edges(long_ref: DataFrame, n_bins: int = 10, weight_col: str | None = None) -> DataFrame:
    """Per feature: the n+1 linear-interpolated quantiles, de-duplicated and
    sorted (numpy ``unique(quantile(x, linspace(0, 1, n+1)))``)."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(long_ref, "value", probs, ["feature"], weight_col=weight_col)
    return q.groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("edges"))


# --- A4 -----------------------------------------------------------------------
def bin_of(value, edges) -> Column:
    """numpy.histogram bin of ``value`` in the array column ``edges``:
    [e_i, e_i+1), last bin closed, outside or fewer than two edges -> null."""
    v, e = col(value), col(edges)
    n = F.size(e)
    at = F.aggregate(e, F.lit(0), lambda acc, x: acc + F.when(x <= v, 1).otherwise(0)) - 1
    last = F.try_element_at(e, n)
    return (F.when((n < 2) | (v < F.try_element_at(e, F.lit(1))) | (v > last), F.lit(None))
            .when(v == last, n - 2).otherwise(at)).cast("int")


def histogram(long: DataFrame, edges: DataFrame, clamp: bool = False) -> DataFrame:
    """Counts per (feature, bin) for ``edges`` (one row per feature).
    ``clamp`` first clips values to the edge range (baseline variant);
    otherwise outside values are dropped.  Values are counted before they are
    binned, so the search runs once per distinct value."""
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    j = counts.join(F.broadcast(edges.select("feature", "edges")), "feature")
    v = F.col("value")
    if clamp:
        v = F.least(F.greatest(v, F.try_element_at("edges", F.lit(1))),
                    F.try_element_at("edges", F.size("edges")))
    return (j.select("feature", bin_of(v, "edges").alias("bin"), "n")
            .filter(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.sum("n").alias("n")))


def all_bins(edges: DataFrame) -> DataFrame:
    """Every (feature, bin, lo, hi) of the edges: features x bins rows."""
    two = edges.filter(F.size("edges") >= 2)
    return two.select("feature", F.posexplode(F.arrays_zip(
        F.slice("edges", F.lit(1), F.size("edges") - 1).alias("lo"),
        F.slice("edges", F.lit(2), F.size("edges") - 1).alias("hi"))).alias("bin", "e")).select(
        "feature", "bin", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"))


# --- A5 -----------------------------------------------------------------------
BASELINE_SCHEMA = ("feature string, tipo string, pos int, lo double, hi double, categoria string, "
                   "proporcao double, mean double, std double")


def baseline_stats(ref: DataFrame, numeric: list[str], categorical: list[str],
                   n_bins: int = 10) -> DataFrame:
    """Reference statistics in long form, one row per bin or category:
    (feature, tipo, pos, lo, hi, categoria, proporcao, mean, std).  Numeric:
    quantile bins with their shares, mean, sample std (0 -> 1e-6), needs
    >= n_bins values and >= 2 edges.  Categorical: a row per category and its
    share; ``pos`` is null there, because ranking all categories of a feature
    would be one task."""
    rows = []
    if numeric:
        long = to_long(ref, numeric)
        probs = [i / n_bins for i in range(n_bins + 1)]
        one = long.withColumn("n", F.lit(1).cast("long"))
        # the running sums' distinct values also give the moments
        rs = running_sums(one, ["feature"], "value", ["n"])
        per = rs.groupBy("feature").agg(F.max("tot_n").alias("_n"), *rank_values("value", "n", probs))
        edges = per.select("feature", "_n", F.array_sort(F.array_distinct(F.array(
            *[rank_quantile(i, p, F.col("_n")) for i, p in enumerate(probs)]))).alias("edges"))
        edges = edges.filter(F.col("_n") >= n_bins)
        moments = long.groupBy("feature").agg(F.avg("value").alias("mean"),
                                              F.stddev_samp("value").alias("sd"))
        h = (rs.join(F.broadcast(edges.select("feature", "edges")), "feature")
             .select("feature", bin_of("value", "edges").alias("bin"), "n")
             .groupBy("feature", "bin").agg(F.sum("n").alias("c")))
        bins = all_bins(edges).join(h, ["feature", "bin"], "left").fillna(0, ["c"])
        tot = bins.groupBy("feature").agg(F.sum("c").alias("t"))
        rows.append(bins.join(tot, "feature").join(moments, "feature").select(
            "feature", F.lit("numerica").alias("tipo"), F.col("bin").alias("pos"), "lo", "hi",
            F.lit(None).cast("string").alias("categoria"), (F.col("c") / F.col("t")).alias("proporcao"),
            "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(EPS)).alias("std")))
    if categorical:
        null = F.lit(None).cast("double")
        rows.append(value_shares(to_long_cat(ref, categorical)).select(
            "feature", F.lit("categorica").alias("tipo"), F.lit(None).cast("int").alias("pos"),
            null.alias("lo"), null.alias("hi"), F.col("category").alias("categoria"),
            F.col("share").alias("proporcao"), null.alias("mean"), null.alias("std")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# --- A6 -----------------------------------------------------------------------
def two_sample(profile: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row per feature: sizes, KS statistic and raw PSI from an ordered
    value profile.  PSI uses reference-quantile bins; shares clipped at 1e-6
    but not renormalised; current values outside the reference range dropped.
    0.0 when a side has < n_bins values or < 2 edges; null when no current
    value falls inside the range (the reference returns NaN there)."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    gap = F.abs(F.try_divide(F.col("cum_a"), F.col("tot_a"))
                - F.try_divide(F.col("cum_b"), F.col("tot_b")))
    per = profile.groupBy("feature").agg(
        F.max("tot_a").alias("n_ref"), F.max("tot_b").alias("n_cur"), F.max(gap).alias("d"),
        *rank_values("value", "a", probs))
    edges = F.array_sort(F.array_distinct(F.filter(F.array(
        *[rank_quantile(i, p, F.col("n_ref")) for i, p in enumerate(probs)]),
        lambda x: x.isNotNull())))
    per = per.select("feature", "n_ref", "n_cur", "d", edges.alias("edges"))
    counts = (profile.join(F.broadcast(per.select("feature", "edges")), "feature")
              .select("feature", bin_of("value", "edges").alias("bin"), "a", "b")
              .filter(F.col("bin").isNotNull())
              .groupBy("feature", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    bc = all_bins(per).join(counts, ["feature", "bin"], "left").fillna(0, ["a", "b"])
    tot = bc.groupBy("feature").agg(F.sum("a").alias("t_a"), F.sum("b").alias("t_b"))
    pe = F.greatest(F.try_divide(F.col("a"), F.col("t_a")), F.lit(EPS))
    pa = F.greatest(F.try_divide(F.col("b"), F.col("t_b")), F.lit(EPS))
    psi = bc.join(tot, "feature").groupBy("feature").agg(
        F.sum((pa - pe) * F.log(pa / pe)).alias("psi_v"), F.max("t_b").alias("t_b"))
    small = (F.col("n_ref") < n_bins) | (F.col("n_cur") < n_bins)
    return per.join(psi, "feature", "left").select(
        "feature", F.coalesce("n_ref", F.lit(0)).alias("n_ref"),
        F.coalesce("n_cur", F.lit(0)).alias("n_cur"), "d",
        F.when(small | F.col("psi_v").isNull(), F.lit(0.0))
        .when(F.col("t_b") == 0, F.lit(None).cast("double"))
        .otherwise(F.col("psi_v")).alias("psi"))


def psi_raw(ref_long: DataFrame, cur_long: DataFrame, n_bins: int = 10) -> DataFrame:
    """Raw PSI per feature (see :func:`two_sample`) with both sizes."""
    return two_sample(value_profile(ref_long, cur_long), n_bins).select(
        "feature", "psi", F.col("n_ref").alias("n_ref_total"), F.col("n_cur").alias("n_cur_total"))


# --- A7 -----------------------------------------------------------------------
def psi_of_parts(parts: DataFrame) -> DataFrame:
    """Normalised PSI per feature of long (feature, expected, actual) rows:
    clip both at 1e-6, renormalise, sum (a - e) ln(a / e)."""
    e = F.greatest(F.col("expected").cast("double"), F.lit(EPS))
    a = F.greatest(F.col("actual").cast("double"), F.lit(EPS))
    p = parts.select("feature", e.alias("e"), a.alias("a"))
    tot = p.groupBy("feature").agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    en, an = F.col("e") / F.col("te"), F.col("a") / F.col("ta")
    return p.join(F.broadcast(tot), "feature").groupBy("feature").agg(
        F.sum((an - en) * F.log(an / en)).alias("psi"))


def psi_normalised(baseline: DataFrame, current: DataFrame, min_count: int = 10) -> DataFrame:
    """Current frame against stored baseline rows (A5 output): numeric values
    clamped to the edge range then binned; categorical counts beside their
    baseline shares plus one part of unseen categories (expected 0).  One row
    per feature: (feature, psi)."""
    kinds = dict(current.dtypes)
    parts = []
    num_cols = [c for c in current.columns
                if kinds[c] in ("double", "float", "int", "bigint", "smallint")]
    if num_cols:
        num_b = baseline.filter(F.col("tipo") == "numerica")
        # a feature has at most n_bins rows here
        edges = num_b.groupBy("feature").agg(F.array_sort(F.array_distinct(F.concat(
            F.collect_list("lo"), F.collect_list("hi")))).alias("edges"))
        h = histogram(to_long(current, num_cols), edges, clamp=True)
        n = h.groupBy("feature").agg(F.sum("n").alias("n_feature"))
        num = (num_b.join(h.withColumnRenamed("bin", "pos"), ["feature", "pos"], "left")
               .join(n, "feature").filter(F.col("n_feature") >= min_count)
               .select("feature", F.col("proporcao").alias("expected"),
                       F.coalesce("n", F.lit(0)).alias("actual")))
        parts.append(num)
    cat_cols = [c for c in current.columns if kinds[c] == "string"]
    if cat_cols:
        parts.append(category_vs_baseline(baseline.filter(F.col("tipo") == "categorica"),
                                          to_long_cat(current, cat_cols))
                     .select("feature", "expected", "actual"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return psi_of_parts(out)


# --- J5 -----------------------------------------------------------------------
def category_vs_baseline(cat_baseline: DataFrame, cur_long_cat: DataFrame) -> DataFrame:
    """Long (feature, category, expected, actual): baseline categories with
    their current counts (missing -> 0), and for every baseline feature one
    part (category null) that sums the current categories absent from the
    baseline, whose expected share is 0."""
    exp = cat_baseline.select("feature", F.col("categoria").alias("category"),
                              F.col("proporcao").alias("expected"))
    counts = cur_long_cat.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("actual"))
    both = (exp.join(counts, ["feature", "category"], "full")
            .select("feature", F.when(F.col("expected").isNotNull(), F.col("category")).alias("category"),
                    F.coalesce("expected", F.lit(0.0)).alias("expected"),
                    F.coalesce("actual", F.lit(0)).alias("actual"))
            .join(F.broadcast(exp.select("feature").distinct()), "feature", "left_semi"))
    unseen = exp.select("feature").distinct().select(
        "feature", F.lit(None).cast("string").alias("category"), F.lit(0.0).alias("expected"),
        F.lit(0).cast("long").alias("actual"))
    return both.unionByName(unseen).groupBy("feature", "category").agg(
        F.max("expected").alias("expected"), F.sum("actual").alias("actual"))


# --- J4 -----------------------------------------------------------------------
def category_align(ref_long_cat: DataFrame, cur_long_cat: DataFrame) -> DataFrame:
    """Full outer join of per-category counts of two samples, missing -> 0;
    categories with zero on both sides never appear."""
    r = ref_long_cat.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n_ref"))
    c = cur_long_cat.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n_cur"))
    return r.join(c, ["feature", "category"], "full").fillna(0, ["n_ref", "n_cur"])


# --- A8 -----------------------------------------------------------------------
def ks_of(profile_row: DataFrame, min_count: int = 5) -> DataFrame:
    """KS columns of :func:`two_sample` rows: the statistic is 0 (and later
    p = 1) when a side has < ``min_count`` values."""
    small = (F.col("n_ref") < min_count) | (F.col("n_cur") < min_count)
    return profile_row.withColumns({
        "_small": small, "ks_statistic": F.when(small, F.lit(0.0)).otherwise(F.col("d"))}).drop("d")


def ks_two_sample(ref_long: DataFrame, cur_long: DataFrame, min_count: int = 5) -> DataFrame:
    """Two-sample KS statistic per feature (max |F_ref - F_cur| over all
    values, ties handled by grouping equal values) plus sizes.  p-value: see
    :func:`with_ks_pvalue`."""
    return ks_of(two_sample(value_profile(ref_long, cur_long)), min_count).select(
        "feature", "ks_statistic", "n_ref", "n_cur", "_small")


def ks_pvalue_col(d, n, m, tol: float = 1e-17) -> Column:
    """Asymptotic two-sided p-value (limiting Kolmogorov distribution with
    Stephens' small-sample factor) as a Catalyst expression over the
    one-row-per-feature result.  Below x = 1.18 the theta-function form
    sqrt(2 pi) / x * sum exp(-(2k-1)^2 pi^2 / (8 x^2)) converges in a few
    terms, above it the alternating series does: 20 terms of either leave less
    than the rounding of a double."""
    n, m, d = col(n).cast("double"), col(m).cast("double"), col(d)
    en = F.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * d
    ks = F.sequence(F.lit(1), F.lit(20))
    low = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.exp(
        -((2 * k - 1) * (2 * k - 1)) * (math.pi ** 2) / (8 * x * x)))
    high = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0)
                       * F.exp(-2.0 * k * k * x * x))
    p = F.when(x < 1.18, 1.0 - F.sqrt(F.lit(2 * math.pi)) / x * low).otherwise(high)
    return (F.when((n <= 0) | (m <= 0) | n.isNull() | m.isNull() | (x <= tol), F.lit(1.0))
            .otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))


#: both samples up to this size: exact p-value; beyond it the limit form
EXACT_KS_ROWS = 10_000


def exact_ks_pvalue(d: float, n: int, m: int) -> float:
    """P(D >= d) of two samples of ``n`` and ``m`` values without ties: of all
    orders of the pooled values, equally likely, those whose path of (i, j)
    leaves the band |i / n - j / m| < d.  A random path to (i, j) came over
    (i - 1, j) with probability i / (i + j), so the share that left the band
    follows diagonal by diagonal: sums of shares only, exact for tiny values
    as well."""
    h, both = round(d * n * m), n + m
    if h <= 0:
        return 1.0
    out = np.ones(n + 2)  # out[i + 1]: share of the paths to (i, s - i)
    out[1] = 0.0
    for s in range(1, both + 1):
        lo = max(0, s - m, (s * n - h) // both + 1)
        hi = min(n, s, -((-s * n - h) // both) - 1)
        if lo > hi:
            return 1.0
        i = np.arange(lo, hi + 1)
        out[lo + 1:hi + 2] = (out[lo:hi + 1] * i + out[lo + 1:hi + 2] * (s - i)) / s
        out[lo] = 1.0
    return float(out[n + 1])


@F.pandas_udf(T.DoubleType())
def _exact_ks_udf(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c)
                      else exact_ks_pvalue(a, int(b), int(c)) for a, b, c in zip(d, n, m)],
                     dtype="float64")


def with_ks_pvalue(ks: DataFrame, exact_rows: int = EXACT_KS_ROWS) -> DataFrame:
    """Adds ``ks_p_value`` on the one-row-per-feature result: exact where both
    samples hold at most ``exact_rows`` values (0: never), else the limit."""
    limit = ks_pvalue_col("ks_statistic", "n_ref", "n_cur")
    p = limit
    if exact_rows > 0:
        small = F.greatest("n_ref", "n_cur") <= exact_rows
        size = lambda c: F.when(small & ~F.col("_small"), F.col(c))  # noqa: E731  null: not counted
        p = F.coalesce(_exact_ks_udf("ks_statistic", size("n_ref"), size("n_cur")), limit)
    return ks.withColumn("ks_p_value", F.when(F.col("_small"), F.lit(1.0)).otherwise(p)) \
        .drop("_small")


# --- A9 -----------------------------------------------------------------------
def _gammq(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b = x + 1 - a
    c = 1.0 / 1e-300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1) < 1e-15:
            break
    return min(1.0, math.exp(-x + a * math.log(x) - gln) * h)


def chi2_sf(x: float, dof: int) -> float:
    if dof <= 0:
        return 1.0
    return _gammq(dof / 2.0, x / 2.0)


@F.pandas_udf(T.DoubleType())
def _chi2_p_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, int(b)) for a, b in zip(x, k)])


def chi2_two_sample(ref_long_cat: DataFrame, cur_long_cat: DataFrame,
                    p_limit: float = 0.05) -> DataFrame:
    """2 x k contingency chi-square per feature (J4 counts), Yates correction
    when k = 2; (0, 1, false) when < 2 categories or reference total < 5."""
    al = category_align(ref_long_cat, cur_long_cat)
    tot = al.groupBy("feature").agg(F.sum("n_ref").alias("r0"), F.sum("n_cur").alias("r1"),
                                    F.count(F.lit(1)).alias("k"))
    j = al.join(F.broadcast(tot), "feature")  # one row per feature of the column list
    r0, r1 = F.col("r0").cast("double"), F.col("r1").cast("double")
    colsum = F.col("n_ref") + F.col("n_cur")
    e0 = r0 * colsum / (r0 + r1)
    e1 = r1 * colsum / (r0 + r1)

    def term(o, e):
        o = o.cast("double")
        diff = e - o
        o2 = F.when(F.col("k") == 2, o + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))).otherwise(o)
        return (o2 - e) * (o2 - e) / e
    st = j.groupBy("feature").agg(
        F.sum(term(F.col("n_ref"), e0) + term(F.col("n_cur"), e1)).alias("stat"),
        F.first("k").alias("k"), F.first("r0").alias("r0"))
    gate = (F.col("k") < 2) | (F.col("r0") < 5)
    out = st.select("feature", F.when(gate, F.lit(0.0)).otherwise(F.col("stat")).alias("chi2_statistic"),
                    "k", gate.alias("_gate"))
    out = out.withColumn("chi2_p_value", F.when(F.col("_gate"), F.lit(1.0)).otherwise(
        _chi2_p_udf("chi2_statistic", F.col("k") - 1)))
    return out.select("feature", "chi2_statistic", "chi2_p_value",
                      (F.col("chi2_p_value") < p_limit).alias("drift_detectado"))


# --- A10 / A11 ----------------------------------------------------------------
def binary_metrics(df: DataFrame, y: str = "y", p: str = "y_prob", threshold: float = 0.5,
                   by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1, accuracy at ``threshold`` with zero_division=0,
    plus n: one aggregate of four conditional counts."""
    by = by or []
    pred = (F.col(p) >= threshold)
    pos = F.col(y) == 1
    agg = df.groupBy(*by).agg(
        F.sum(F.when(pred & pos, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(pred & ~pos, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~pred & pos, 1).otherwise(0)).alias("fn"),
        F.sum(F.when(~pred & ~pos, 1).otherwise(0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return agg.select(*by, prec.alias("precision"), rec.alias("recall"),
                      F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
                      ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
                      (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))


def confusion_report(df: DataFrame, y: str = "y", p: str = "y_prob",
                     threshold: float = 0.5) -> DataFrame:
    """Per class: tp/fp/fn counts, precision, recall, f1, support (long form of
    the confusion matrix and the class report)."""
    pred = (F.col(p) >= threshold).cast("int")
    cm = df.groupBy(F.col(y).cast("int").alias("y"), pred.alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    per = cm.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("classe"), "y", "pred", "n")
    rep = per.groupBy("classe").agg(
        F.sum(F.when((F.col("y") == F.col("classe")) & (F.col("pred") == F.col("classe")), F.col("n"))
              .otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") != F.col("classe")) & (F.col("pred") == F.col("classe")), F.col("n"))
              .otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == F.col("classe")) & (F.col("pred") != F.col("classe")), F.col("n"))
              .otherwise(0)).alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return rep.select("classe", "tp", "fp", "fn", prec.alias("precision"), rec.alias("recall"),
                      F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
                      (F.col("tp") + F.col("fn")).alias("support"))


# --- A12 / A13 ----------------------------------------------------------------
def _class_sums(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    s = df.select(*by, F.col(p).cast("double").alias("score"),
                  (F.col(y) == 1).cast("long").alias("pos"),
                  (F.col(y) != 1).cast("long").alias("neg"))
    return running_sums(s, by, "score", ["pos", "neg"])


def auc_exact(df: DataFrame, y: str = "y", p: str = "y_prob",
              by: list[str] | None = None) -> DataFrame:
    """ROC AUC with ties at half weight (Mann-Whitney), from distributed
    running sums of negatives below each score; null with one class only."""
    by = by or []
    rs = _class_sums(df, y, p, by)
    # doubles: the product of two counts leaves the longs long before 10^12 rows
    contrib = F.col("pos").cast("double") * (F.col("cum_neg") - 0.5 * F.col("neg"))
    return rs.groupBy(*by).agg(F.try_divide(
        F.sum(contrib), F.max("tot_pos").cast("double") * F.max("tot_neg")).alias("auc"))


def ks_separation(df: DataFrame, y: str = "y", p: str = "y_prob",
                  by: list[str] | None = None) -> DataFrame:
    """KS statistic between the score distributions of the two classes; null
    with one class only."""
    by = by or []
    rs = _class_sums(df, y, p, by)
    return rs.groupBy(*by).agg(F.max(F.abs(
        F.try_divide(F.col("cum_pos"), F.col("tot_pos"))
        - F.try_divide(F.col("cum_neg"), F.col("tot_neg")))).alias("ks"))


# --- A15 ----------------------------------------------------------------------
def prediction_distribution(preds: DataFrame, as_of: str, hours: int = 24,
                            ts: str = "momento", prob: str = "probabilidade",
                            level: str = "nivel_risco") -> DataFrame:
    """Predictions in the last ``hours``: n, mean, population std, min, max
    (4 decimals) and the share of each risk level; one row per level."""
    from ..functions.core import ts_lit
    w = preds.filter(F.col(ts) >= ts_lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))
    # one pass grouped by level (a handful of rows), totals by a window over
    # those few rows: no join, no second scan
    from pyspark.sql import Window
    lv = w.groupBy(level).agg(F.count(F.lit(1)).alias("n_nivel"), F.sum(prob).alias("s1"),
                              F.sum(F.col(prob) * F.col(prob)).alias("s2"),
                              F.min(prob).alias("mn"), F.max(prob).alias("mx"))
    allw = Window.partitionBy()
    n = F.sum("n_nivel").over(allw)
    mean = F.sum("s1").over(allw) / n
    var = F.greatest(F.sum("s2").over(allw) / n - mean * mean, F.lit(0.0))
    return lv.select(n.alias("n_predicoes"), F.round(mean, 4).alias("probabilidade_media"),
                     F.round(F.sqrt(var), 4).alias("probabilidade_std"),
                     F.round(F.min("mn").over(allw), 4).alias("probabilidade_min"),
                     F.round(F.max("mx").over(allw), 4).alias("probabilidade_max"), level,
                     (F.col("n_nivel") / n).alias("share"))


# --- A16 ----------------------------------------------------------------------
def mean_abs_attribution(long_attr: DataFrame, feature: str = "feature",
                         value: str = "valor") -> DataFrame:
    """Mean |attribution| per feature, ranked descending."""
    return (long_attr.groupBy(feature).agg(F.avg(F.abs(value)).alias("importancia"))
            .orderBy(F.col("importancia").desc(), F.col(feature)))


# --- A17 ----------------------------------------------------------------------
def error_rate(df: DataFrame, by: list[str], errors: Column, predictions: Column | None = None):
    """round(errors / predictions, 4) per group, null when no predictions."""
    pr = predictions if predictions is not None else F.count(F.lit(1))
    agg = df.groupBy(*by).agg(pr.alias("predictions_count"), F.sum(errors).alias("error_count"))
    return agg.withColumn("error_rate", F.when(F.col("predictions_count") > 0, F.round(
        F.col("error_count") / F.col("predictions_count"), 4)))


# --- A20 / A21 ----------------------------------------------------------------
def fraud_summary(df: DataFrame, flag: str = "is_fraud") -> DataFrame:
    return df.agg(F.sum(flag).cast("long").alias("count_fraud"),
                  F.count(F.lit(1)).alias("count_total"))


def any_drift(reports: DataFrame, flag: str = "drift_detected", force: bool = False) -> DataFrame:
    return reports.agg((F.coalesce(F.bool_or(flag), F.lit(False)) | F.lit(force)).alias("any_drift"))
