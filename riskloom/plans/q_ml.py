"""Registered queries: machine-learning jobs.

Inputs: the credit feature table with a stand-in label, and the fraud
transactions (label from the P29 rule).  Every run uses the library's defaults
(300 boosting rounds, 100 / 200 trees, 10 k-means restarts, 20 tuning trials,
5000 perturbations).  A fitted model is kept per session and table folder, so
that the queries that read it do not fit it again.

The stand-in label ``inadimplente`` mixes bureau score, balance, debt burden
and a per-client term that no feature holds: a model can learn part of it and
no single feature gives it away.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import label_fraud_rule, legacy_score_target, segment_name
from ..operators import ml, prep
from ..operators import stats as st
from ..operators.windows import importance_ranking, top_attributions
from ..session import scratch_path, scratch_table
from .catalog import finish, register
from .q_features import _JOINED_SQL, credit_features_df

_CACHE: dict = {}

#: the stand-in label, as text both engines read alike
LABEL_SQL = ("CAST(CASE WHEN (500 - score_bureau) / CAST(250 AS DOUBLE)"
             " + CASE WHEN saldo_atual < 2000 THEN 1 ELSE 0 END"
             " + least(total_dividas / (renda_mensal * 6), CAST(1.5 AS DOUBLE))"
             " + (((id_cliente * 104729) % 1009) / CAST(1009 AS DOUBLE) - 0.5) * 3 > 1.6"
             " THEN 1 ELSE 0 END AS INT)")


def credit_training_table(t):
    """Credit table in the v2 feature layout plus the stand-in label."""
    c = credit_features_df(t).withColumn("inadimplente", F.expr(LABEL_SQL))
    return prep.prepare_credit_v2(c, keep=["id_cliente", "inadimplente"])


def _credit_split(t):
    """The split training table, stored: its readers do not build it again."""
    return scratch_table(ml.stratified_split(credit_training_table(t), "id_cliente",
                                             "inadimplente"), "split")


def _credit_model(t, split=None):
    k = ("credit", t.sf_dir, t.spark.sparkContext.applicationId)
    if k not in _CACHE:
        sp = _credit_split(t) if split is None else split
        _CACHE[k] = ml.train_credit(sp.filter(F.col("split") == "train"),
                                    prep.V2_FEATURES, "inadimplente")
    return _CACHE[k]


def fraud_table(t, fit):
    """The fraud features under a given fit, the P29 label and the P31 score."""
    f = t.fx_fraude
    feats = prep.prepare_fraud(f, fit, keep=["id"])
    lab = f.select("id", label_fraud_rule("valor", F.lit(fit.p99), F.hour("data_transacao"),
                                          F.weekday("data_transacao"), "score_risco")
                   .alias("is_fraud"), legacy_score_target("score_risco").alias("score_credito"))
    return feats.join(lab, "id")


def _fraud_cols(df):
    return [c for c in prep.FRAUD_NUMERIC + [f"{c}_encoded" for c in prep.FRAUD_CATEGORICAL]
            if c in df.columns]


# --- M1 -------------------------------------------------------------------------
@register("stratified_split", f"""
WITH c AS (SELECT {LABEL_SQL} AS inadimplente, count(*) AS tot FROM ({_JOINED_SQL}) j GROUP BY 1),
s AS (SELECT *, CAST(floor(0.2 * (tot - 1)) + 1 AS BIGINT) AS te FROM c),
v AS (SELECT *, CAST(floor(0.15 * (tot - te - 1)) + 1 AS BIGINT) AS va FROM s),
u AS (SELECT inadimplente, 'test' AS split, te AS n, tot FROM v
      UNION ALL SELECT inadimplente, 'val', va, tot FROM v
      UNION ALL SELECT inadimplente, 'train', tot - te - va, tot FROM v)
SELECT inadimplente, split, n, tot, round(n / tot, 6) AS share FROM u""")
def q_stratified_split(t):
    """M1: hash-seeded 80/20 then 85/15 split, exact to one row per class."""
    return finish(ml.split_shares(_credit_split(t), "inadimplente"))


# --- M2 -------------------------------------------------------------------------
_SCALE_COLS = ["renda_mensal", "idade", "score_bureau", "total_dividas"]


@register("scale", "SELECT id_cliente, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}"
    for c in _SCALE_COLS) + " FROM fx_clientes c JOIN fx_contas USING (id_cliente)")
def q_scale(t):
    """M2: zero mean, unit population std (fitted once, applied as columns)."""
    df = t.fx_clientes.join(t.fx_contas.select("id_cliente", "total_dividas"), "id_cliente")
    df = df.select("id_cliente", *[F.col(c).cast("double").alias(c) for c in _SCALE_COLS])
    sc = ml.fit_scaler(df, _SCALE_COLS)
    return finish(sc.transform(df, keep=["id_cliente"]))


# --- M3 / M12 / K2 / M13 / A16 / K1 / M15 -----------------------------------------
@register("train_credit")
def q_train_credit(t):
    """M3 + A10/A12/A13: held-out metrics of the credit booster."""
    sp = _credit_split(t)
    pred = ml.positive_prob(_credit_model(t, sp).transform(sp.filter(F.col("split") == "test")))
    metrics = ml.evaluate(pred, "inadimplente", "p")
    return t.spark.createDataFrame([metrics]).select(
        "*", ml.validate_gate(None).alias("gate"))


@register("train_credit_alt")
def q_train_credit_alt(t):
    """M4: the second booster's held-out metrics."""
    sp = _credit_split(t)
    m = ml.train_credit_alt(sp.filter(F.col("split") == "train"), prep.V2_FEATURES, "inadimplente")
    pred = ml.positive_prob(m.transform(sp.filter(F.col("split") == "test")))
    return t.spark.createDataFrame([ml.evaluate(pred, "inadimplente", "p")])


@register("score_batch")
def q_score_batch(t):
    """Probability, score and band for every client."""
    return finish(ml.score_batch(_credit_model(t), credit_training_table(t), ["id_cliente"]))


@register("importance_ranking")
def q_importance_ranking(t):
    """K2: feature importances, descending."""
    return finish(importance_ranking(ml.importance_table(t.spark, _credit_model(t),
                                                         prep.V2_FEATURES)))


#: a given ensemble (tree, node, feature, threshold, left, right, value, cover)
#: that SQL can spell out; the fitted model goes through the same code
GIVEN_TREES = (
    (0, 0, "score_bureau", 520.0, 1, 2, 0.0, 1000.0),
    (0, 1, "saldo_atual", 2000.0, 3, 4, 0.0, 271.0),
    (0, 2, "total_dividas", 30000.0, 5, 6, 0.0, 729.0),
    (0, 3, None, None, None, None, 0.9131, 121.0),
    (0, 4, "score_bureau", 400.0, 7, 8, 0.0, 150.0),
    (0, 5, None, None, None, None, -0.4177, 499.0),
    (0, 6, None, None, None, None, 0.1093, 230.0),
    (0, 7, None, None, None, None, 0.5537, 61.0),
    (0, 8, None, None, None, None, 0.2039, 89.0),
    (1, 0, "renda_mensal", 5000.0, 1, 2, 0.0, 1000.0),
    (1, 1, "total_dividas", 12000.0, 3, 4, 0.0, 401.0),
    (1, 2, "idade", 45.0, 5, 6, 0.0, 599.0),
    (1, 3, None, None, None, None, -0.1013, 221.0),
    (1, 4, "saldo_atual", 3500.0, 7, 8, 0.0, 180.0),
    (1, 5, None, None, None, None, -0.2071, 341.0),
    (1, 6, "renda_mensal", 9000.0, 9, 10, 0.0, 258.0),
    (1, 7, None, None, None, None, 0.7113, 97.0),
    (1, 8, None, None, None, None, 0.0517, 83.0),
    (1, 9, None, None, None, None, -0.0531, 149.0),
    (1, 10, None, None, None, None, -0.6089, 109.0),
    (2, 0, "saldo_atual", 5000.0, 1, 2, 0.0, 1000.0),
    (2, 1, None, None, None, None, 0.1571, 611.0),
    (2, 2, None, None, None, None, -0.1597, 389.0))
GIVEN_COLS = ["score_bureau", "saldo_atual", "total_dividas", "renda_mensal", "idade"]


def _given_leaves():
    """Per leaf of the given trees: value, and per feature of its path the SQL
    condition of its splits and the share of the covers that meets them."""
    for tree in sorted({r[0] for r in GIVEN_TREES}):
        nodes = {r[1]: r for r in GIVEN_TREES if r[0] == tree}
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            _, _, f, threshold, left, right, value, cover = nodes[at]
            if f is None:
                yield value, path
                continue
            for child, op in ((left, "<="), (right, ">")):
                cond, share = path.get(f, ("true", 1.0))
                todo.append((child, {**path, f: (f"{cond} AND {f} {op} {threshold!r}",
                                                 share * nodes[child][7] / cover)}))


def _given_sql():
    """Attributions by the definition: over all subsets of a leaf's features."""
    import itertools
    import math
    num = lambda v: f"CAST({v!r} AS DOUBLE)"  # noqa: E731 - decimals would overflow
    terms, margin, base = {c: ["0"] for c in GIVEN_COLS}, [], 0.0
    for value, path in _given_leaves():
        o = {f: f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END" for f, (cond, _) in path.items()}
        z = {f: num(share) for f, (_, share) in path.items()}
        base += value * math.prod(share for _, share in path.values())
        margin.append(f"{num(value)} * " + " * ".join(f"({o[f]})" for f in path))
        for f in path:
            rest = [g for g in path if g != f]
            sets = []
            for k in range(len(rest) + 1):
                w = math.factorial(k) * math.factorial(len(rest) - k) / math.factorial(len(path))
                sets += [" * ".join([num(w), *[f"({o[g] if g in on else z[g]})" for g in rest]])
                         for on in itertools.combinations(rest, k)]
            terms[f].append(f"{num(value)} * (({o[f]}) - {z[f]}) * ({' + '.join(sets)})")
    x = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in GIVEN_COLS)
    return (f"WITH x AS (SELECT id_cliente, {x} FROM ({_JOINED_SQL}) j), "
            f"m AS (SELECT *, CAST({' + '.join(margin)} AS DOUBLE) AS margin FROM x)", base, terms)


_GIVEN_SQL, _GIVEN_BASE, _GIVEN_TERMS = _given_sql()


def given_ensemble():
    return ml.ensemble_from_rows(GIVEN_TREES, GIVEN_COLS)


@register("attribute_batch", _GIVEN_SQL + " UNION ALL ".join(
    f" SELECT id_cliente, '{c}' AS feature, round(CAST({' + '.join(_GIVEN_TERMS[c])} AS DOUBLE), 6) AS valor, "
    f"round(margin, 6) AS margin, round(CAST({_GIVEN_BASE!r} AS DOUBLE), 6) AS base FROM m"
    for c in GIVEN_COLS))
def q_attribute_batch(t):
    """Shapley values of the given trees for every client; base + sum =
    margin."""
    ens = given_ensemble()
    a = ml.attribute_batch(ens, credit_features_df(t), GIVEN_COLS, "id_cliente")
    return finish(a.withColumn("base", F.lit(ens.base)))


@register("score_trees", _GIVEN_SQL + """, p AS (
SELECT id_cliente, 1 / (1 + exp(-2 * margin)) AS p FROM m)
SELECT id_cliente, round(p, 6) AS probabilidade,
       CAST(greatest(300, least(850, CAST(trunc(300 + (1 - p) * 550) AS INTEGER))) AS INTEGER) AS score,
       CASE WHEN p < 0.15 THEN 'A' WHEN p < 0.35 THEN 'B' WHEN p < 0.60 THEN 'C' ELSE 'D' END
         AS nivel_risco FROM p""")
def q_score_trees(t):
    """M12 on the given trees: probability, score and band of every client."""
    return finish(ml.score_trees(given_ensemble(), credit_features_df(t), GIVEN_COLS, "id_cliente"))


def _attributions(t):
    ens = ml.ensemble_from(_credit_model(t))
    return ml.attribute_batch(ens, credit_training_table(t), prep.V2_FEATURES, "id_cliente"), ens


@register("attribute_model")
def q_attribute_model(t):
    """M13 on the fitted credit model: Shapley values (base + sum = margin)."""
    a, ens = _attributions(t)
    return finish(a.withColumn("base", F.lit(ens.base)))


# the three below read a given attribution table: scaled features as the
# attribution of a linear score, so that SQL can say the same
_ATTR_COLS = ["renda_mensal", "idade", "score_bureau", "possui_imovel", "possui_veiculo",
              "pessoas_residencia"]
_ATTR_SQL = "WITH a AS (" + " UNION ALL ".join(
    f"SELECT id_cliente, '{c}' AS feature, CAST({c} AS DOUBLE) / 100 - "
    f"((id_cliente * {i + 3}) % 7) AS valor FROM fx_clientes"
    for i, c in enumerate(_ATTR_COLS)) + ")"


def attribution_table(t):
    """Given (id_cliente, feature, valor) rows."""
    vals = [(F.col(c).cast("double") / 100 - (F.col("id_cliente") * (i + 3)) % 7).alias(c)
            for i, c in enumerate(_ATTR_COLS)]
    return t.fx_clientes.select("id_cliente", *vals).unpivot(
        ["id_cliente"], _ATTR_COLS, "feature", "valor")


@register("mean_abs_attribution", _ATTR_SQL + """
SELECT feature, round(avg(abs(valor)), 6) AS importancia FROM a GROUP BY feature""")
def q_mean_abs_attribution(t):
    """Mean |attribution| per feature, ranked, of a given table."""
    return finish(st.mean_abs_attribution(attribution_table(t)))


@register("model_attribution")
def q_model_attribution(t):
    """M13 + A16: mean |Shapley value| per feature of the credit model."""
    a, _ = _attributions(t)
    return finish(st.mean_abs_attribution(a))


@register("top_attributions", _ATTR_SQL + """
SELECT id_cliente, CAST(row_number() OVER (PARTITION BY id_cliente
         ORDER BY abs(valor) DESC, feature) AS INTEGER) AS pos, feature, round(abs(valor), 6) AS valor
FROM a QUALIFY pos <= 3""")
def q_top_attributions(t):
    """K1: per row, the 3 largest attributions by magnitude of a given table."""
    per_row = attribution_table(t).groupBy("id_cliente").agg(
        F.collect_list(F.struct("feature", "valor")).alias("a"))
    # a row holds one entry per feature: a fixed bound
    top = top_attributions(per_row, "a", 3).select("id_cliente", F.posexplode("top").alias("p", "x"))
    return finish(top.select("id_cliente", (F.col("p") + 1).alias("pos"),
                             F.col("x.feature").alias("feature"), F.col("x.valor").alias("valor")))


@register("local_surrogate_batch")
def q_local_surrogate(t):
    """Local weighted linear surrogates (top 10 weights) per client."""
    return finish(ml.local_surrogate_batch(_credit_model(t), credit_training_table(t),
                                           prep.V2_FEATURES, "id_cliente"))


@register("merge_attributions", _ATTR_SQL + """,
p AS (SELECT feature, avg(abs(valor)) AS shap_value FROM a WHERE feature <> 'idade' GROUP BY feature),
l AS (SELECT feature, avg(valor) AS lime_value FROM a WHERE feature <> 'renda_mensal' GROUP BY feature),
c AS (SELECT unnest(['idade', 'renda_mensal', 'sem_valor']) AS feature)
SELECT feature, round(shap_value, 6) AS shap_value, round(lime_value, 6) AS lime_value,
       round(greatest(abs(coalesce(shap_value, 0.0)), abs(coalesce(lime_value, 0.0))), 6) AS peso_absoluto
FROM c FULL JOIN p USING (feature) FULL JOIN l USING (feature)""")
def q_merge_attributions(t):
    """Full outer merge of mean attributions, mean surrogate weights
    and a column list (given tables); weight = the larger magnitude."""
    a = attribution_table(t)
    path = st.mean_abs_attribution(a.filter("feature <> 'idade'"))
    local = a.filter("feature <> 'renda_mensal'").withColumnRenamed("valor", "peso")
    return finish(ml.merge_attributions(path, local, ["idade", "renda_mensal", "sem_valor"]))


@register("validate_gate", """
WITH g AS (SELECT y_prob AS s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM fx_avaliacao GROUP BY y_prob),
c AS (SELECT s, pos, neg, sum(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cneg,
             sum(pos) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cpos,
             sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM g),
m AS (SELECT sum(pos * (cneg - neg + 0.5 * neg)) / (max(tp) * max(tn)) AS auc_roc,
             max(abs(cpos / tp - cneg / tn)) AS ks_statistic,
             CAST(max(tp) + max(tn) AS BIGINT) AS n_amostras_teste FROM c)
SELECT round(auc_roc, 6) AS auc_roc, round(ks_statistic, 6) AS ks_statistic, n_amostras_teste,
  len(list_filter([CASE WHEN auc_roc < 0.8 THEN 1 END, CASE WHEN ks_statistic < 0.3 THEN 1 END,
                   CASE WHEN n_amostras_teste < 100 THEN 1 END], lambda x: x IS NOT NULL)) = 0 AS aprovado,
  list_filter([CASE WHEN auc_roc < 0.8 THEN printf('AUC-ROC %.4f < minimo 0.8', auc_roc) END,
               CASE WHEN ks_statistic < 0.3 THEN printf('KS statistic %.4f < minimo 0.3', ks_statistic) END,
               CASE WHEN n_amostras_teste < 100 THEN printf('Amostra teste %d < minimo 100', n_amostras_teste) END],
              lambda x: x IS NOT NULL) AS violacoes
FROM m""")
def q_validate_gate(t):
    """Release gate on AUC / KS / sample size of an evaluation frame."""
    a = t.fx_avaliacao
    auc = st.auc_exact(a)
    ks = st.ks_separation(a)
    n = a.agg(F.count(F.lit(1)).alias("n_amostras_teste"))
    cols = ["auc_roc", "ks_statistic", "n_amostras_teste"]
    # three one-row aggregates stacked into one row (no join)
    u = (auc.select(F.col("auc").alias("auc_roc"), F.lit(None).cast("double").alias("ks_statistic"),
                    F.lit(None).cast("long").alias("n_amostras_teste"))
         .unionByName(ks.select(F.lit(None).cast("double").alias("auc_roc"),
                                F.col("ks").alias("ks_statistic"),
                                F.lit(None).cast("long").alias("n_amostras_teste")))
         .unionByName(n.select(F.lit(None).cast("double").alias("auc_roc"),
                               F.lit(None).cast("double").alias("ks_statistic"), "n_amostras_teste"))
         .agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols]))
    g = ml.validate_gate(None)
    return finish(u.select(*cols, g["aprovado"].alias("aprovado"), g["violacoes"].alias("violacoes")))


# --- M5 / M6 / M7 ------------------------------------------------------------------
def _fraud_models(t):
    """Split first, then fit: constants, dictionaries, scaler and both models
    see the training rows only; every row is prepared under that fit."""
    k = ("fraud", t.sf_dir, t.spark.sparkContext.applicationId)
    if k not in _CACHE:
        f = t.fx_fraude
        risky = f.withColumn("_risk", (F.col("score_risco") > 0.9).cast("int"))
        sp = scratch_table(ml.stratified_split(risky, "id", "_risk", val=None)
                           .select("id", "split"), "split")
        fit = prep.fit_fraud(f.join(sp.filter("split = 'train'"), "id", "left_semi"))
        # the features under the fit, stored: counts, codes and joins run once
        feats = scratch_table(fraud_table(t, fit), "fraud")
        cols = _fraud_cols(feats)
        train = scratch_table(feats.join(sp.filter("split = 'train'"), "id"), "fraud-train")
        scaler, rf = ml.train_fraud(train, cols, "is_fraud")
        iso = ml.isolation_forest(scaler.transform(train, keep=["id"]), cols, "id")
        _CACHE[k] = (cols, feats, sp, scaler, rf, iso)
    return _CACHE[k]


@register("isolation_forest")
def q_isolation_forest(t):
    """M6: isolation-forest score and -1/1 flag (contamination 0.1)."""
    _, feats, _, scaler, _, iso = _fraud_models(t)
    x = scaler.transform(feats, keep=["id"])
    return finish(iso.score(x, ["id"]))


@register("fraud_scores")
def q_fraud_scores(t):
    """M5 + M6 + M7: forest probability, anomaly score, combined score/flag
    of every row, with the side of the split it is on."""
    cols, feats, sp, scaler, rf, iso = _fraud_models(t)
    x = scaler.transform(feats, keep=["id", "is_fraud"])
    p = ml.positive_prob(rf.transform(x)).select("id", "is_fraud", F.col("p").alias("rf_prob"),
                                                 F.col("prediction").cast("int").alias("rf_pred"))
    j = p.join(iso.score(x.select("id", *cols), ["id"]), "id").join(sp, "id")
    comb = ml.fraud_combine("iso_score", "iso_pred", "rf_prob", "rf_pred")
    norm = ml.fraud_combine("iso_score", "iso_pred", "rf_prob", "rf_pred", normalised=True)
    return finish(j.select("id", "split", "is_fraud", "rf_prob", "rf_pred", "iso_score", "iso_pred",
                           comb["combined_score"].alias("combined_score"),
                           comb["combined_pred"].alias("combined_pred"),
                           norm["combined_score"].alias("combined_score_normalised")))


@register("fraud_combine", """
WITH g AS (SELECT id, -score_risco AS iso_score, CASE WHEN score_risco > 0.9 THEN -1 ELSE 1 END AS iso_pred,
             least(valor / 1000, 1.0) AS rf_prob, CAST(valor > 800 AS INTEGER) AS rf_pred FROM fx_fraude)
SELECT id, round((iso_score + rf_prob) / 2, 6) AS combined_score,
       CAST(iso_pred = -1 OR rf_pred = 1 AS INTEGER) AS combined_pred,
       round((rf_prob - iso_score) / 2, 6) AS combined_score_normalised FROM g""")
def q_fraud_combine(t):
    """M7 on given scores: mean of both, flag if either fires."""
    g = t.fx_fraude.select(
        "id", (-F.col("score_risco")).alias("iso_score"),
        F.when(F.col("score_risco") > 0.9, -1).otherwise(1).alias("iso_pred"),
        F.least(F.col("valor") / 1000, F.lit(1.0)).alias("rf_prob"),
        (F.col("valor") > 800).cast("int").alias("rf_pred"))
    comb = ml.fraud_combine("iso_score", "iso_pred", "rf_prob", "rf_pred")
    norm = ml.fraud_combine("iso_score", "iso_pred", "rf_prob", "rf_pred", normalised=True)
    return finish(g.select("id", comb["combined_score"].alias("combined_score"),
                           comb["combined_pred"].alias("combined_pred"),
                           norm["combined_score"].alias("combined_score_normalised")))


@register("window_metrics")
def q_window_metrics(t):
    """Metrics of the fraud forest on the held-out rows (A10 + A12 on
    M12-style scores) against the label it was trained for."""
    _, feats, sp, scaler, rf, _ = _fraud_models(t)
    held = feats.join(sp.filter("split = 'test'"), "id", "left_semi")
    pred = ml.positive_prob(rf.transform(scaler.transform(held, keep=["id", "is_fraud"])))
    return t.spark.createDataFrame([ml.evaluate(pred, "is_fraud", "p")])


# --- M8 -------------------------------------------------------------------------
@register("train_default")
def q_train_default(t):
    """M8 + P14 + P30: default booster trained on the rule label."""
    from .q_scoring import default_input
    from ..functions.scoring import label_default_rule
    d = default_input(t)
    x = prep.prepare_default(d, keep=["id_cliente"]).join(
        d.select("id_cliente", label_default_rule("dias_atraso_medio", "pct_pagamentos_atraso")
                 .alias("inadimplente")), "id_cliente")
    sp = ml.stratified_split(x, "id_cliente", "inadimplente")
    m = ml.train_default(sp.filter(F.col("split") != "test"), prep.DEFAULT_FEATURES, "inadimplente")
    pred = ml.positive_prob(m.transform(sp.filter(F.col("split") == "test")))
    return t.spark.createDataFrame([ml.evaluate(pred, "inadimplente", "p")])


# --- M9 / A19 / P28 -------------------------------------------------------------
@register("train_segments")
def q_train_segments(t):
    """M9 + A19 + P28: k-means segments (best of restarts), silhouette."""
    c = credit_features_df(t).select(
        "id_cliente", "renda_mensal", "idade", "saldo_atual", "valor_total_transacoes",
        F.col("total_transacoes_90d").alias("transacoes_ultimo_mes"))
    x = prep.prepare_segmentation(c, keep=["id_cliente"])
    scaler, model, sil = ml.train_segments(x, prep.SEGMENT_FEATURES)
    pred = model.transform(ml.assemble(prep.SEGMENT_FEATURES).transform(
        scaler.transform(x, keep=["id_cliente"])))
    return finish(pred.select("id_cliente", F.col("prediction").alias("cluster"),
                              segment_name("prediction", training_side=True).alias("segmento"),
                              segment_name("prediction").alias("segmento_servico"),
                              F.lit(sil).alias("silhouette")))


# --- M10 ------------------------------------------------------------------------
@register("train_legacy_score")
def q_train_legacy_score(t):
    """M10 + P4 + P31: regression forest on the legacy integer score; the
    forest and its scaler see the training rows, the held-out rows are scored."""
    from .q_scoring import legacy_input
    from ..sources.fixtures import AS_OF_TRANSACOES
    li = legacy_input(t)
    x = prep.prepare_credit_legacy(li, AS_OF_TRANSACOES, keep=["id_cliente"])
    y = li.select("id_cliente", F.least(F.greatest(
        (300 + 400 * (1 - F.col("risk_score"))).cast("int"), F.lit(300)), F.lit(850))
        .alias("score_credito"))
    x = x.join(y, "id_cliente").withColumn("_all", F.lit(1))
    # the split table, stored: the joins below it run once
    sp = scratch_table(ml.stratified_split(scratch_table(x, "legacy"), "id_cliente", "_all",
                                           val=None), "split")
    scaler, m = ml.train_legacy_score(sp.filter("split = 'train'"), prep.LEGACY_FEATURES,
                                      "score_credito")
    pred = m.transform(scaler.transform(sp.filter("split = 'test'"),
                                        keep=["id_cliente", "score_credito"]))
    return pred.select("id_cliente", "score_credito",
                       F.round("prediction").cast("int").alias("score_previsto"))


# --- M11 / M16 ------------------------------------------------------------------
@register("tune")
def q_tune(t):
    """Seeded random search (20 trials in parallel, each with a draw of
    all six parameters and a fit of its own) maximising validation AUC."""
    import json
    sp = _credit_split(t)
    res = ml.tune(sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "val"),
                  prep.V2_FEATURES, "inadimplente", per_fit=1)
    return t.spark.createDataFrame([(json.dumps(res["params"]), float(res["auc"]))],
                                   "params string, auc double")


@register("training_run")
def q_training_run(t):
    """Split -> search of 20 trials -> fit -> held-out metrics -> gate ->
    attributions -> stored model."""
    _, res = ml.training_run(credit_training_table(t), prep.V2_FEATURES, "id_cliente",
                             "inadimplente", tune_trials=20,
                             model_path=scratch_path(t.spark, "training-run"))
    r = ml.result_row(res)
    names = [f.split()[0] for f in ml.RESULT_SCHEMA.split(", ")]
    return t.spark.createDataFrame([tuple(r[k] for k in names)], ml.RESULT_SCHEMA)
