"""Round 3's findings on growth: plans and results of the mended steps."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ml
from riskloom.operators import stats as st
from riskloom.operators.trees import BitForest, Forest, TreeEnsemble, _from_nodes


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_values_of_a_feature_are_not_dealt_by_the_feature(spark, no_auto_broadcast):
    """A join on the feature alone gave one task all its values."""
    df = spark.range(400).select((F.col("id") % 37).cast("double").alias("x"),
                                 F.col("id").cast("double").alias("z"),
                                 (F.col("id") % 5).cast("string").alias("c"))
    long = st.to_long(df, ["x", "z"])
    edges = st.quantile_edges(long)
    by_feature = re.compile(r"SortMergeJoin(\(skew=true\))? \[feature#\d+\]")
    assert not by_feature.search(plan(st.histogram(long, edges)))
    cats = st.to_long_cat(df, ["c"])
    base = st.baseline_stats(df, ["x", "z"], ["c"])
    parts = st.category_vs_baseline(st.baseline_stats(df, [], ["c"]), cats)
    assert not by_feature.search(plan(parts))
    assert "BroadcastHashJoin [feature#" in plan(st.psi_of_parts(parts))
    # of the joins in a baseline and in a pair of samples those that see values
    assert "BroadcastHashJoin [feature#" in plan(st.baseline_stats(df, ["x", "z"], []))
    assert "BroadcastHashJoin [feature#" in plan(st.two_sample(st.value_profile(long, long)))
    psi = {r["feature"]: r["psi"] for r in st.psi_normalised(base, df).collect()}
    assert set(psi) == {"x", "z", "c"} and all(abs(v) < 1e-4 for v in psi.values()), psi


def _random_tree(rng, depth, cuts):
    nodes = []

    def grow(d):
        i = len(nodes)
        nodes.append(None)
        if d == depth or (d and rng.random() < 0.2):
            nodes[i] = [-1, 0.0, -1, -1, float(rng.standard_normal()), 1.0, None]
        else:
            f = int(rng.integers(len(cuts)))
            cut = float(cuts[f, rng.integers(cuts.shape[1])])
            nodes[i] = [f, cut, grow(d + 1), grow(d + 1), 0.0, 1.0, None]
        return i
    grow(0)
    return _from_nodes(nodes, 0.05)


@pytest.mark.parametrize("depth,n", [(1, 5), (4, 64), (6, 333), (9, 70)])
def test_margins_of_perturbations_by_bits(depth, n):
    """the bitwise margins are those of the descent, at thresholds as well;
    trees of a depth beyond the bits descend."""
    rng = np.random.default_rng(depth)
    cuts = rng.standard_normal((6, 5))
    ens = TreeEnsemble([_random_tree(rng, depth, cuts) for _ in range(70)], 6)
    x = rng.standard_normal((n, 6))
    x[0], x[1] = cuts[:, 2], 0.0
    assert np.allclose(BitForest(ens).margins(x), Forest(ens).margins(x), rtol=0, atol=1e-12)


def test_partitions_of_a_fit():
    """A task per core, whatever the table's size, until it would hold
    too much."""
    of = lambda rows: ml.fit_partitions(rows, 30, 12)
    assert of(0) == of(10_000) == 1
    assert of(55_000) == 4  # one task before
    assert of(550_000) == of(3_300_000) == 12  # 8 and 48 before
    assert of(100_000_000) * ml.FIT_PARTITION_MOST >= 100_000_000 * 240


def test_fraud_features_are_built_once(spark, tables_small, monkeypatch):
    """counts, codes and joins ran again for every read."""
    from riskloom.plans import q_ml
    built = []
    real = q_ml.fraud_table
    monkeypatch.setattr(q_ml, "fraud_table", lambda *a: built.append(1) or real(*a))
    monkeypatch.setattr(q_ml, "_CACHE", {})
    small = dict(numTrees=2, maxDepth=2)
    monkeypatch.setattr(ml, "FRAUD_FOREST", small)
    x = q_ml.q_isolation_forest(tables_small)
    assert "Window" not in plan(x) and len(built) == 1
    assert "Window" not in plan(q_ml.q_fraud_scores(tables_small)) and len(built) == 1
    assert x.count() == tables_small.events.count()
