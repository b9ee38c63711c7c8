"""Round 4's findings: whole searches and runs, and steps that grow."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import boost, ml


def _labelled(spark, n=1200, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = np.round(x[:, 3])
    y = x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * .5 > 0
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, d double, y int")
    return df, x, y.astype(float)


def test_fits_in_tasks_are_those_of_spark(spark):
    """where nothing is drawn, the trees of a task's fit are Spark ML's."""
    df, x, y = _labelled(spark)
    params = dict(maxDepth=4, stepSize=0.1, subsamplingRate=1.0, featureSubsetStrategy="all",
                  minInstancesPerNode=5)
    got = boost.boosted_margins(x, y, x, [1, 12], params, 42)
    for r, m in zip((1, 12), got.T):
        model = ml.train_gbt(df, list("abcd"), "y", dict(params, maxIter=r))
        want = model.transform(df).select("id", vector_to_array("rawPrediction")[1].alias("m"))
        assert np.allclose(m, want.toPandas().sort_values("id").m, rtol=0, atol=1e-9)
    half = dict(params, subsamplingRate=0.7, featureSubsetStrategy="0.5")
    a = boost.boosted_margins(x, y, x, [6], half, 42)
    back = np.random.default_rng(0).permutation(len(x))
    assert np.array_equal(a, boost.boosted_margins(x[back], y[back], x, [6], half, 42))
    assert not np.allclose(a, boost.boosted_margins(x, y, x, [6], half, 43))


@pytest.fixture
def short_search(monkeypatch):
    space = dict(ml.TUNE_SPACE, maxIter=(2, 4), maxDepth=(2, 3))
    monkeypatch.setattr(ml, "TUNE_SPACE", space)


def test_every_trial_is_a_fit(tables_small, monkeypatch, short_search):
    """F8: three fits served the query's 20 trials."""
    from riskloom.plans import q_ml
    made, real = [], ml.search_margins
    monkeypatch.setattr(ml, "search_margins", lambda *a: made.extend(a[4]) or real(*a))
    row = q_ml.q_tune(tables_small).first()
    assert len(made) == 20 and len({str(sorted(p.items())) for p, _ in made}) == 20
    assert all(list(r.values()) == [r[t]] for _, r in made for t in r)
    assert 0.5 < row["auc"] <= 1.0


def test_searches_in_tasks_and_over_the_cluster_agree(spark, monkeypatch, short_search):
    """nothing drawn but the settings: both ways find the same trial."""
    df, _, _ = _labelled(spark)
    monkeypatch.setitem(ml.TUNE_SPACE, "subsamplingRate", (1.0, 1.0))
    monkeypatch.setitem(ml.TUNE_SPACE, "featureSubsetStrategy", (1.0, 1.0))
    args = (df.filter("id % 3 > 0"), df.filter("id % 3 = 0"), list("abcd"), "y")
    a = ml.tune(*args, n_trials=5, per_fit=1)
    monkeypatch.setattr(ml, "SEARCH_TASK_BYTES", 0)
    b = ml.tune(*args, n_trials=5, per_fit=1)
    assert a["params"] == b["params"] and abs(a["auc"] - b["auc"]) < 1e-9


def test_a_training_run_uses_all_its_stages(spark, tables_small, monkeypatch, short_search):
    """nothing was tuned, no row of the validation side was used, and the
    attributions and the stored model were left out of the result."""
    import json
    from riskloom.plans import q_ml
    seen, tune, fit = {}, ml.tune, ml.train_credit
    monkeypatch.setattr(ml, "tune", lambda *a, **k: seen.setdefault("best", tune(*a, **k)))
    monkeypatch.setattr(ml, "train_credit", lambda df, *a: seen.update(rows=df.count()) or fit(df, *a))
    df = q_ml.q_training_run(tables_small)
    r = df.first()
    params, rows = json.loads(r["params"]), json.loads(r["linhas"])
    assert {**params, **seen["best"]["params"]} == params
    assert seen["rows"] == rows["train"] + rows["val"] and min(rows.values()) > 0
    top = json.loads(r["top_atribuicao"])
    assert len(top) == 10 and top[0][1] > 0 and top == sorted(top, key=lambda x: -x[1])
    assert json.loads(r["modelo"]) == {"arvores": params["maxIter"], "colunas": 30}


def test_attributions_without_tables_are_the_same(monkeypatch):
    """the tables of a searched model's deep trees do not fit a task."""
    from riskloom.operators import trees
    from .test_trees import random_tree
    rng = np.random.default_rng(5)
    ens = trees.TreeEnsemble([random_tree(rng, 4, 5) for _ in range(6)], 4)
    x = rng.normal(size=(50, 4))
    want = trees.Attributor(ens)(x)
    monkeypatch.setattr(trees, "_TABLE_BYTES", 1000)
    less = trees.Attributor(ens)
    assert sum(t.nbytes for _, g in less.trees for _, t in g if t is not None) <= 1000
    assert np.allclose(less(x), want, rtol=0, atol=1e-12)


@pytest.mark.parametrize("depth,n", [(1, 5), (4, 64), (6, 333), (7, 130), (9, 70)])
def test_margins_around_a_row_by_ranks(depth, n, monkeypatch):
    """the bits kept by rank are those of the comparisons, at thresholds
    as well; without room for them the comparisons are made."""
    from riskloom.operators import trees
    from .test_findings_r03 import _random_tree
    rng = np.random.default_rng(depth)
    cuts = rng.standard_normal((6, 5))
    ens = trees.TreeEnsemble([_random_tree(rng, depth, cuts) for _ in range(70)], 6)
    noise = rng.standard_normal((n, 6))
    noise[0], noise[1] = 0.0, noise[-1]
    around = trees.Around(trees.BitForest(ens), noise)
    assert around.ranked == (depth <= 7)
    monkeypatch.setattr(trees, "_RANK_BYTES", 0)
    direct = trees.Around(trees.BitForest(ens), noise)
    assert not direct.ranked
    for row in (np.zeros(6), cuts[:, 2], rng.standard_normal(6), np.full(6, 9.0), np.full(6, -9.0)):
        want = trees.Forest(ens).margins(row + noise)
        assert np.allclose(around.margins(row), want, rtol=0, atol=1e-12)
        assert np.allclose(direct.margins(row), want, rtol=0, atol=1e-12)


def test_rows_of_surrogates_are_dealt_over_the_cores(spark):
    """8 shuffle partitions left cores idle at the end."""
    from riskloom.operators import trees
    ens = trees.ensemble_from_rows([(0, 0, "a", 0.5, 1, 2, 0.0, 2.0), (0, 1, None, None, None, None, 1.0, 1.0),
                                    (0, 2, None, None, None, None, -1.0, 1.0)], ["a"])
    df = spark.range(50).select("id", F.rand(1).alias("a"))
    out = trees.local_surrogates(ens, df, ["a"], "id", [1.0], n_samples=50)
    assert out.rdd.getNumPartitions() >= trees._TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert out.select("id").distinct().count() == 50


def _descend(x, nodes):
    """Path length of one row in one tree of (feature, threshold, left, right, size)."""
    i, depth = 0, 0
    while nodes[i][0] >= 0:
        f, thr, left, right, _ = nodes[i]
        i, depth = int(left if x[int(f)] < thr else right), depth + 1
    return depth + ml._c(nodes[i][4])


def test_isolation_paths_descend_all_trees_at_once(spark):
    """every tree was descended by itself, level by level on the whole batch."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3))
    x[:, 2] = np.round(x[:, 2])
    grown = []
    for t in range(20):
        nodes = []
        ml._grow(x[rng.permutation(150)[:40]], np.random.default_rng(t), 0, 6, nodes)
        grown.append(nodes)
    grown.append([[-1, 0.0, -1, -1, 1.0]])
    grown.append([[2, 1.0, 1, 2, 3.0], [-1, 0.0, -1, -1, 1.0], [-1, 0.0, -1, -1, 2.0]])  # at its threshold
    forest = ml._path_forest(grown)
    want = np.array([sum(_descend(r, t) for t in grown) for r in x])
    assert np.allclose(forest.margins(x), want, rtol=0, atol=1e-9)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    model = ml.IsolationForestModel(list("abc"), grown, 40, offset=-0.5)
    got = model.score(df, ["id"]).toPandas().sort_values("id")
    score = -np.power(2.0, -want / len(grown) / ml._c(40))
    assert np.allclose(got.iso_score, score) and list(got.iso_pred) == list(np.where(score < -0.5, -1, 1))


def test_draws_of_trees_run_as_compiled_code(spark):
    """a hundred hashes a row were interpreted, one lambda call each."""
    df = spark.range(5000).select("id", (F.col("id") % 7).cast("double").alias("x"))
    got = ml.tree_samples(df, ["x"], "id", 12, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Generate explode" in plan
    drawn = F.explode(F.sequence(F.lit(0), F.lit(11)))
    want = df.select("*", drawn.alias("tree")).withColumn("r", F.xxhash64("id", "tree", F.lit(42))).toPandas()
    want = want.sort_values(["tree", "r", "id"]).groupby("tree").head(50)
    key = lambda p: sorted(map(tuple, p[["tree", "r", "id", "x"]].to_numpy().tolist()))
    assert key(got.toPandas()) == key(want)


def test_a_large_forest_is_fitted_and_scored_in_parts(spark, monkeypatch):
    """all nodes of 200 deep trees were on the driver at once."""
    assert ml.forest_parts(200, 10_800, 15) == [200]  # as before
    for trees, rows in ((200, 720_000), (201, 65_000), (200, 13_000)):
        parts = ml.forest_parts(trees, rows, 15)
        assert sum(parts) == trees and min(parts) >= 2 and len(parts) > 1
        assert max(parts) * min(2 << 15, 2 * rows) <= ml.FOREST_PART_NODES + 2 * (2 << 15)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3))
    y = np.round(500 + 80 * x[:, 0] - 40 * x[:, 1] * x[:, 2])
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, score int")
    params = dict(numTrees=12, maxDepth=6)
    scaler, whole = ml.train_legacy_score(df, list("abc"), "score", params)
    monkeypatch.setattr(ml, "FOREST_NODES", 1000)
    monkeypatch.setattr(ml, "FOREST_PART_NODES", 400)
    same, parted = ml.train_legacy_score(df, list("abc"), "score", params)
    assert same == scaler and [n for _, n in parted.parts] == [3, 3, 3, 3]
    z = scaler.transform(df, keep=["id", "score"])
    out = parted.transform(z)
    assert out.columns == [*z.columns, "prediction"]
    from pyspark.ml.regression import RandomForestRegressionModel
    each = []
    for path, n in parted.parts:
        model = RandomForestRegressionModel.load(path)
        assert model.getNumTrees == n
        each.append(model.transform(ml.assemble(list("abc")).transform(z)).toPandas().sort_values("id").prediction)
    got = out.toPandas().sort_values("id").prediction.to_numpy()
    assert np.allclose(got, np.mean(each, axis=0))
    assert len({tuple(e) for e in each}) == 4  # every part draws its own rows
    want = whole.transform(z).toPandas().sort_values("id").prediction.to_numpy()
    assert np.corrcoef(got, y)[0, 1] > 0.9 and np.abs(got - want).mean() < 15
