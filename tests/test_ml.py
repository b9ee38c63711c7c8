"""ML jobs by bounds on synthetic data (distributions, not rows, match the
reference generators) and exact identities (attributions sum to the margin)."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import ml, prep
from riskloom.sources.synth import synth_credit, synth_segmentation


def test_credit_model_bounds_and_attributions(spark):
    df = prep.prepare_credit_v2(synth_credit(spark, 8000, seed=42), keep=["id_cliente", "inadimplente"])
    sp = ml.stratified_split(df, "id_cliente", "inadimplente").cache()
    shares = {(r["inadimplente"], r["split"]): r["share"]
              for r in ml.split_shares(sp, "inadimplente").collect()}
    n = {r["inadimplente"]: r["tot"] for r in ml.split_shares(sp, "inadimplente").collect()}
    for c in (0, 1):  # exact to one row
        assert abs(shares[(c, "test")] * n[c] - 0.2 * n[c]) <= 1
        assert abs(shares[(c, "val")] * n[c] - 0.15 * 0.8 * n[c]) <= 1.2
    model = ml.train_credit(sp.filter(F.col("split") == "train"), prep.V2_FEATURES, "inadimplente",
                            dict(ml.CREDIT_GBT, maxIter=30))
    test = sp.filter(F.col("split") == "test")
    m = ml.evaluate(ml.positive_prob(model.transform(test)), "inadimplente", "p")
    assert m["auc_roc"] > 0.7 and m["ks_statistic"] > 0.1
    ens = ml.ensemble_from(model)
    attrs = ml.attribute_batch(ens, test, prep.V2_FEATURES, "id_cliente")
    s = attrs.groupBy("id_cliente").agg(F.sum("valor").alias("s"))
    raw = model.transform(test).select("id_cliente", vector_to_array("rawPrediction")[1].alias("m"))
    worst = s.join(raw, "id_cliente").select(F.max(F.abs(F.col("s") + ens.base - F.col("m")))).first()[0]
    assert worst < 1e-9
    scored = ml.score_batch(model, test, ["id_cliente"]).collect()
    assert all(300 <= r["score"] <= 850 and r["nivel_risco"] in "ABCD" for r in scored)
    sp.unpersist()


def test_isolation_forest_flags_contamination(spark, tables_small):
    f = tables_small.fx_fraude
    feats = prep.prepare_fraud(f, keep=["id"])
    cols = ["valor", "hour", "score_risco_normalized", "transaction_value_ratio"]
    model = ml.isolation_forest(feats, cols, "id", n_trees=20, sample=64)
    out = model.score(feats, ["id"]).toPandas()
    share = (out.iso_pred == -1).mean()
    assert 0.05 <= share <= 0.15
    assert (out.iso_score < 0).all() and (out.iso_score > -1).all()


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    sc = ml.fit_scaler(df, ["x"])
    vals = [r[0] for r in sc.transform(df).collect()]
    assert np.allclose(vals, (np.arange(1, 5) - 2.5) / np.std(np.arange(1, 5)))


def test_segments(spark):
    df = prep.prepare_segmentation(synth_segmentation(spark, 600), keep=["id_cliente"])
    scaler, model, sil = ml.train_segments(df, prep.SEGMENT_FEATURES, k=4, restarts=2)
    assert len(model.clusterCenters()) == 4 and -1.0 <= sil <= 1.0


def test_validate_gate_texts(spark):
    df = spark.createDataFrame([(0.75, 0.35, 50)], "auc_roc double, ks_statistic double, n_amostras_teste long")
    g = df.select(ml.validate_gate(None).alias("g")).first()["g"]
    assert not g["aprovado"]
    assert g["violacoes"] == ["AUC-ROC 0.7500 < minimo 0.8", "Amostra teste 50 < minimo 100"]


def test_save_load_model_roundtrip(spark, tmp_path):
    df = prep.prepare_default(
        __import__("riskloom.sources.synth", fromlist=["synth_default"]).synth_default(spark, 400),
        keep=["id_cliente", "inadimplente"])
    model = ml.train_default(df, prep.DEFAULT_FEATURES, "inadimplente", dict(ml.DEFAULT_GBT, maxIter=3))
    path = str(tmp_path / "modelo")
    ml.save_model(model, path, prep.DEFAULT_FEATURES, {"versao": "1"})
    loaded, meta = ml.load_model(path)
    assert meta["features"] == prep.DEFAULT_FEATURES and meta["versao"] == "1"
    a = ml.positive_prob(model.transform(df)).select("p").collect()
    b = ml.positive_prob(loaded.transform(df)).select("p").collect()
    assert a == b


def test_pick_feature_columns(spark):
    from riskloom.operators.stats import pick_feature_columns
    df = spark.createDataFrame([(1, 2.0, "x", 0)], "id_cliente long, v double, c string, inadimplente int")
    assert pick_feature_columns(df) == (["v"], ["c"])


def test_trees_sample_the_whole_table(spark):
    """Every tree draws its own rows, from everywhere."""
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 97).cast("double").alias("x"))
    got = ml.tree_samples(df, ["x"], "id", 30, 64).toPandas()
    assert (got.groupby("tree").size() == 64).all()
    assert got.id.nunique() > 0.9 * len(got)
    assert got.id.min() < 500 and got.id.max() > 19_500
    assert (got.groupby("tree").id.mean() - 10_000).abs().max() < 4000


def test_codes_are_those_of_the_fit(spark, tables_small):
    """A subset scores with the training codes; a new value is -1."""
    f = tables_small.fx_fraude
    fit = prep.fit_fraud(f)
    codes = [f"{c}_encoded" for c in prep.FRAUD_CATEGORICAL]
    whole = {r["id"]: r for r in prep.prepare_fraud(f, fit).select("id", *codes).collect()}
    part = f.filter("tipo_transacao NOT IN ('TED', 'PIX')")
    rows = prep.prepare_fraud(part, fit).select("id", *codes).collect()
    assert rows and all(whole[r["id"]] == r for r in rows)
    new = prep.prepare_fraud(part.withColumn("status", F.lit("NOVO")), fit)
    assert {r[0] for r in new.select("status_encoded").collect()} == {-1.0}


def test_tuning(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=1500) * 0.3 > 0).astype(float)
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)],
                               ", ".join(f"{c} double" for c in cols) + ", y int")
    best = ml.tune(df.limit(1000), df, cols, "y", n_trials=3)
    trials = ml.trial_params(3, 42)
    assert best["auc"] > 0.9 and best["params"] in trials
    assert len({t["maxIter"] for t in ml.trial_params(20, 42)}) > 10


def test_surrogate_of_a_small_model(spark):
    df = spark.range(300).select(
        F.col("id"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        ((F.col("id") % 17) > 8).cast("int").alias("y"))
    model = ml.train_default(df, ["a", "b"], "y", dict(ml.DEFAULT_GBT, maxIter=5))
    out = ml.local_surrogate_batch(model, df.filter("id < 17"), ["a", "b"], "id",
                                   n_samples=400).toPandas()
    assert len(out) == 34 and out.erro.isna().all()
    p = {r["id"]: r["p"] for r in ml.positive_prob(model.transform(df)).select("id", "p").collect()}
    for _, r in out.iterrows():
        assert abs(r.prob_positiva - p[r.id]) < 1e-9 and abs(r.prob_positiva + r.prob_negativa - 1) < 1e-12
    top = out.loc[out.groupby("id").peso.apply(lambda s: s.abs().idxmax())]
    assert (top[top.id.between(5, 12)].feature == "a").all()
