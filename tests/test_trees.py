"""Tree ensembles: margins, exact Shapley values against subset enumeration,
shared-design surrogates against the per-row solve."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ml, trees


def random_tree(rng, n_features, depth, cats=False):
    nodes = []

    def grow(d, cover):
        at = len(nodes)
        nodes.append(None)
        if d == 0 or (d < depth and rng.random() < .15):
            nodes[at] = [-1, 0.0, -1, -1, float(rng.normal()), cover, None]
            return at
        f, share = int(rng.integers(n_features)), float(rng.uniform(.05, .95))
        allowed = [0.0, 2.0] if cats and f == 0 else None
        left = grow(d - 1, cover * share)
        right = grow(d - 1, cover * (1 - share))
        nodes[at] = [f, float(rng.normal()), left, right, 0.0, cover, allowed]
        return at
    grow(depth, 100.0)
    return trees._from_nodes(nodes, float(rng.uniform(.1, 1)))


def expected(tree, x, known, node=0):
    """Mean of the leaves where known features follow x, others the covers."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return expected(tree, x, known, left if tree.goes_left(x[None], node)[0] else right)
    share = tree.cover[left] / tree.cover[node]
    return share * expected(tree, x, known, left) + (1 - share) * expected(tree, x, known, right)


def enumerated(ens, x):
    n, out = ens.n_features, np.zeros(ens.n_features)
    v = {s: sum(t.weight * expected(t, x, set(s)) for t in ens.trees)
         for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    for f in range(n):
        rest = [g for g in range(n) if g != f]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                out[f] += w * (v[tuple(sorted((*s, f)))] - v[s])
    return out, v[()]


@pytest.mark.parametrize("seed,n_features,depth,bits", [
    (0, 1, 3, 8), (1, 3, 4, 8), (2, 6, 3, 8), (3, 6, 7, 8), (4, 6, 6, 2), (5, 5, 0, 8)])
def test_shapley_values_equal_subset_enumeration(seed, n_features, depth, bits, monkeypatch):
    monkeypatch.setattr(trees, "_TABLE_BITS", bits)
    rng = np.random.default_rng(seed)
    ens = trees.TreeEnsemble([random_tree(rng, n_features, depth, cats=True) for _ in range(3)],
                             n_features)
    x = rng.normal(size=(12, n_features))
    x[:, 0] = rng.integers(0, 4, 12)
    got, margin = trees.Attributor(ens)(x), trees.Forest(ens).margins(x)
    for i in range(len(x)):
        want, base = enumerated(ens, x[i])
        assert np.allclose(got[i], want, atol=1e-12)
        assert abs(ens.base - base) < 1e-12
        assert abs(base + got[i].sum() - margin[i]) < 1e-10


def test_margins_equal_a_walk_and_stages_add_up():
    rng = np.random.default_rng(7)
    ens = trees.TreeEnsemble([random_tree(rng, 4, 5, cats=True) for _ in range(9)], 4)
    x = rng.normal(size=(700, 4))
    x[:, 0] = rng.integers(0, 4, 700)

    def walk(t, r):
        n = 0
        while t.feature[n] >= 0:
            n = int(t.left[n] if t.goes_left(r[None], n)[0] else t.right[n])
        return t.weight * t.value[n]
    each = np.array([[walk(t, r) for t in ens.trees] for r in x])
    forest = trees.Forest(ens)
    assert np.allclose(forest.margins(x), each.sum(axis=1))
    assert np.allclose(forest.staged(x, [9, 1, 4]),
                       np.cumsum(each, axis=1)[:, [8, 0, 3]])


def test_symmetry_and_dummy_features():
    """Two features used alike share alike; an unused one gets nothing."""
    rows = [(0, 0, "a", 0.5, 1, 2, 0.0, 8.0), (0, 1, None, None, None, None, 0.0, 4.0),
            (0, 2, "b", 0.5, 3, 4, 0.0, 4.0), (0, 3, None, None, None, None, 0.0, 2.0),
            (0, 4, None, None, None, None, 8.0, 2.0)]
    ens = trees.ensemble_from_rows(rows, ["a", "b", "c"])
    got = trees.Attributor(ens)(np.array([[1.0, 1.0, 5.0], [0.0, 1.0, 5.0]]))
    assert ens.base == 2.0
    assert np.allclose(got, [[3, 3, 0], [-3, 1, 0]])


def test_model_attributions_start_from_the_covers(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        F.lit(None).cast("double").alias("c"), ((F.col("id") % 17) + (F.col("id") % 5) > 10)
        .cast("int").alias("y"))
    model = ml.train_default(df.fillna(0.0), ["a", "b", "c"], "y", dict(ml.DEFAULT_GBT, maxIter=4))
    ens = ml.ensemble_from(model)
    assert all(t.cover[0] == 400 for t in ens.trees)
    out = ml.attribute_batch(ens, df, ["a", "b", "c"], "id", batch_rows=64).toPandas()
    per = out.pivot(index="id", columns="feature", values="valor")
    margin = out.groupby("id").margin.first()
    assert np.allclose(per.sum(axis=1) + ens.base, margin, atol=1e-10)
    assert (per["c"] == 0).all() and per["a"].abs().mean() > per["b"].abs().mean()
    rows = df.select("a", "b", F.lit(0.0)).toPandas().to_numpy()
    for i in (0, 31, 399):
        assert np.allclose(per.loc[i, ["a", "b", "c"]], enumerated(ens, rows[i])[0], atol=1e-12)
    assert ml.attribute_batch(ens, df.limit(0), ["a", "b", "c"], "id").count() == 0


def test_surrogates_equal_the_per_row_solve(spark):
    rng = np.random.default_rng(3)
    ens = trees.TreeEnsemble([random_tree(rng, 3, 4) for _ in range(20)], 3)
    x = rng.normal(size=(21, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                               "id long, a double, b double, c double")
    std = [1.5, 0.0, 0.2]
    out = trees.local_surrogates(ens, df, ["a", "b", "c"], "id", std, n_samples=900, top=2).toPandas()
    assert len(out) == 42 and out.erro.isna().all()
    z = np.random.default_rng(42).standard_normal((900, 3))
    z[0] = 0
    w = np.exp(-(z ** 2).sum(axis=1) / (math.sqrt(3) * .75) ** 2)
    a, forest = np.hstack([np.ones((900, 1)), z]), trees.Forest(ens)
    for i, r in enumerate(x):
        p = 1 / (1 + np.exp(-2 * forest.margins(r + z * np.array([1.5, 1.0, .2]))))
        coef, *_ = np.linalg.lstsq(a * np.sqrt(w)[:, None], p * np.sqrt(w), rcond=None)
        got = out[out.id == i].reset_index(drop=True)
        order = np.argsort(-np.abs(coef[1:]))[:2]
        assert list(got.feature) == ["abc"[j] for j in order]
        assert np.allclose(got.peso, coef[1:][order], atol=2e-6)
        assert np.allclose(got.intercepto, coef[0]) and np.allclose(got.prob_positiva, p[0])
        mean = np.average(p, weights=w)
        r2 = 1 - (w * (p - a @ coef) ** 2).sum() / (w * (p - mean) ** 2).sum()
        assert np.allclose(got.r2_local, r2)


def test_a_row_that_fails_keeps_its_error(spark):
    ens = trees.ensemble_from_rows([(0, 0, None, None, None, None, float("nan"), 1.0)], ["a"])
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id long, a double")
    out = trees.local_surrogates(ens, df, ["a"], "id", [1.0], n_samples=50).collect()
    assert sorted(r["id"] for r in out) == [1, 2]
    assert all(r["erro"] and r["feature"] is None for r in out)


def test_trials_read_off_one_fit_equal_their_own_fits(spark):
    """Trials that differ in rounds only: same trees, same AUC, same best."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    y = x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=900) * .7 > 0
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)],
                               "a double, b double, c double, d double, y int").repartition(3)
    cols, trials = list("abcd"), [dict(maxIter=r, maxDepth=d) for d in (2, 4) for r in (3, 14, 8)]
    held = df.limit(300)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ml, "trial_params", lambda n, seed: trials)
        best = ml.tune(df, held, cols, "y", n_trials=6)
    aucs = []
    for params in trials:
        model = ml.train_gbt(df, cols, "y", {**ml.CREDIT_GBT, **params})
        p = ml.positive_prob(model.transform(held)).select(F.col("y").cast("double").alias("y"), "p")
        from riskloom.operators import stats as st
        aucs.append(st.auc_exact(p, "y", "p").first()["auc"])
    assert best["params"] == trials[int(np.argmax(aucs))] and abs(best["auc"] - max(aucs)) < 1e-9


def test_trials_share_settings():
    t = ml.trial_params(20, 42)
    rest = [{k: v for k, v in p.items() if k != "maxIter"} for p in t]
    assert all(rest[i] == rest[i - i % 7] for i in range(20))
    assert len({str(r) for r in rest}) == 3 and len({p["maxIter"] for p in t}) > 12
    for k, (lo, hi) in ml.TUNE_SPACE.items():
        assert all(lo <= float(p[k]) <= hi for p in t)
