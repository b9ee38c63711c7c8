"""Exact KS p-values against enumeration; mergeable sketches against exact
quantiles, shares, PSI and KS."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import sketches as sk
from riskloom.operators import stats as st


def enumerated(n, m):
    """{h: P(max |i m - j n| >= h)} over all orders of n and m values."""
    gaps = []
    for at in itertools.combinations(range(n + m), n):
        i = j = top = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in at else (i, j + 1)
            top = max(top, abs(i * m - j * n))
        gaps.append(top)
    gaps = np.array(gaps)
    return {h: (gaps >= h).mean() for h in set(gaps.tolist())}


def test_exact_ks_p_equals_enumeration():
    for n in range(1, 8):
        for m in range(1, 8):
            for h, p in enumerated(n, m).items():
                assert abs(st.exact_ks_pvalue(h / (n * m), n, m) - p) < 1e-12, (n, m, h)
    assert st.exact_ks_pvalue(0.0, 5, 9) == 1.0
    assert 0 < st.exact_ks_pvalue(0.1, 10_000, 9999) < 1e-40  # far below the rounding of 1 - p


def test_exact_ks_p_of_large_samples_meets_the_limit(spark):
    rows = [("a", 0.05, 3000, 2500), ("b", 0.02, 9000, 10_000), ("c", 0.5, 10, 11), ("d", 0.9, 8, 12),
            ("e", 0.02, 10_001, 9000)]
    df = spark.createDataFrame(rows, "feature string, ks_statistic double, n_ref long, n_cur long") \
        .withColumn("_small", F.col("feature") == "d")
    got = {r["feature"]: r["ks_p_value"] for r in st.with_ks_pvalue(df).collect()}
    lim = {r["feature"]: r["ks_p_value"] for r in st.with_ks_pvalue(df, 0).collect()}
    assert abs(got["a"] - lim["a"]) < 5e-3 and abs(got["b"] - lim["b"]) < 5e-3, (got, lim)
    assert got["d"] == lim["d"] == 1.0 and got["e"] == lim["e"]


def test_a_small_case_that_the_limit_misjudges():
    """n = m = 5, D = 0.8: exact 0.079, limit form below 0.05."""
    exact = st.exact_ks_pvalue(0.8, 5, 5)
    assert abs(exact - 20 / 252) < 1e-12 and exact > 0.05
    en = math.sqrt(2.5)
    x = (en + 0.12 + 0.11 / en) * 0.8
    assert 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 30)) < 0.05


def long_frame(spark, rng, sizes, shift=0.0):
    rows = [(f, float(v)) for f, n in sizes.items() for v in rng.normal(shift, 1, n)]
    return spark.createDataFrame(rows + [("a", None), ("a", float("nan"))],
                                 "feature string, value double").repartition(6)


def test_sketches_of_snapshots_merge_into_the_baseline(spark, tmp_path):
    rng = np.random.default_rng(2)
    days = [long_frame(spark, rng, {"a": 9000, "b": 300}, s) for s in (0.0, 0.3, -0.2)]
    for i, d in enumerate(days):
        sk.store_snapshot(sk.sketched(d), str(tmp_path), f"d{i}")
    sk.store_snapshot(sk.sketched(days[1]), str(tmp_path), "d1")  # a replay replaces
    base = sk.stored_baseline(spark, str(tmp_path))
    whole = days[0].unionByName(days[1]).unionByName(days[2]).toPandas().dropna()
    probs = [0, .05, .25, .5, .9, 1]
    for r in sk.quantiles(base, probs).collect():
        v = np.sort(whole.value[whole.feature == r["feature"]])
        assert r["n"] == len(v)
        assert (r["quantiles"][0], r["quantiles"][-1]) == (v[0], v[-1])
        for p, q in zip(probs, r["quantiles"]):
            lo, hi = np.searchsorted(v, q, "left") / len(v), np.searchsorted(v, q, "right") / len(v)
            assert lo - 2 * sk.rank_error() <= p <= hi + 2 * sk.rank_error()
    edges = sk.quantile_edges(base)
    for f, g in sk.shares(base, edges).toPandas().groupby("feature"):
        v, g = whole.value[whole.feature == f].to_numpy(), g.sort_values("pos")
        assert len(g) == 10 and abs(g.proporcao.sum() - 1) < 1e-9
        exact = [((v > lo) & (v <= hi)).mean() for lo, hi in zip(g.lo, g.hi)]
        assert np.abs(g.proporcao.to_numpy()[1:] - exact[1:]).max() <= 2 * sk.rank_error(share=True) + 2 / sk.POINTS


def test_sketched_psi_and_ks_are_near_the_exact_ones(spark):
    rng = np.random.default_rng(5)
    ref, cur = (long_frame(spark, rng, {"a": 8000, "b": 5000}, s).filter(
        F.col("value").isNotNull() & ~F.isnan("value")) for s in (0.0, 0.4))
    near = {r["feature"]: r for r in sk.ks_two_sample(sk.sketched(ref), sk.sketched(cur)).collect()}
    for r in st.ks_two_sample(ref, cur).collect():
        got = near[r["feature"]]
        assert abs(got["ks_statistic"] - r["ks_statistic"]) <= got["erro"] < 0.02
        assert (got["n_ref"], got["n_cur"]) == (r["n_ref"], r["n_cur"])
    exact = {r["feature"]: r["psi"] for r in st.psi_raw(ref, cur).collect()}
    for r in sk.psi(sk.sketched(ref), sk.sketched(cur)).collect():
        assert abs(r["psi"] - exact[r["feature"]]) < 0.03 and r["psi"] > 0.1


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([("a", None)], "feature string, value double")
    assert sk.sketched(none).count() == 0
    assert sk.quantile_edges(sk.merged(sk.sketched(none))).count() == 0
    one = spark.createDataFrame([("a", 2.0)] * 3, "feature string, value double")
    assert sk.quantile_edges(sk.sketched(one)).first()["edges"] == [2.0]
    assert sk.shares(sk.sketched(one), sk.quantile_edges(sk.sketched(one))).count() == 0
