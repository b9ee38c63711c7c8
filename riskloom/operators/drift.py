"""Drift and monitoring reports (D1-D12, A18, W3 users, S9 lines).

Reports are DataFrames (one row per feature / metric plus summary rows), so
they can be written with the sinks in :mod:`riskloom.sources.io` and checked
against SQL.  The heavy parts (quantiles, histograms, KS running sums,
contingency counts) run distributed in :mod:`riskloom.operators.stats`; only
the per-feature results (a handful of rows) meet the small p-value helpers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col
from ..session import scratch_table
from . import stats as st


@dataclass(frozen=True)
class DriftThresholds:
    """Every rule limit is a parameter (U4); defaults equal the reference."""
    psi_alerta: float = 0.2
    psi_critico: float = 0.5
    ks_pvalue_limite: float = 0.05
    chi2_pvalue_limite: float = 0.05
    n_bins: int = 10
    min_count: int = 10
    baseline_threshold: float = 0.15
    decay_threshold: float = 0.1
    #: samples up to this size get an exact KS p-value, larger ones the limit
    ks_exact_rows: int = st.EXACT_KS_ROWS


DEFAULT = DriftThresholds()
LEVEL_RANK = {"ok": 0, "atencao": 1, "alerta": 2, "critico": 3}


# --- D2 -----------------------------------------------------------------------
def drift_level(psi, p_value, th: DriftThresholds = DEFAULT) -> Column:
    """critico > 0.5, alerta > 0.2, atencao when p < 0.05, else ok; a null PSI
    (every current value outside the reference range) is critico."""
    psi, p = col(psi), col(p_value)
    return (F.when(psi.isNull(), "critico").when(psi > th.psi_critico, "critico")
            .when(psi > th.psi_alerta, "alerta").when(p < th.ks_pvalue_limite, "atencao")
            .otherwise("ok"))


def _level_rank(c) -> Column:
    return (F.when(col(c) == "critico", 3).when(col(c) == "alerta", 2)
            .when(col(c) == "atencao", 1).otherwise(0))


def _rank_level(c) -> Column:
    return (F.when(col(c) == 3, "critico").when(col(c) == 2, "alerta")
            .when(col(c) == 1, "atencao").otherwise("ok"))


# --- D1 -----------------------------------------------------------------------
def numeric_drift(ref: DataFrame, cur: DataFrame, numeric: list[str],
                  th: DriftThresholds = DEFAULT, with_p: bool = True) -> DataFrame:
    """Per numeric feature with >= min_count values on both sides: psi (A6),
    ks statistic (A8), p-value and level."""
    prof = st.value_profile(st.to_long(ref, numeric), st.to_long(cur, numeric))
    out = st.ks_of(st.two_sample(prof, th.n_bins)).filter(
        (F.col("n_ref") >= th.min_count) & (F.col("n_cur") >= th.min_count))
    if with_p:
        out = st.with_ks_pvalue(out, th.ks_exact_rows).withColumn("nivel", drift_level("psi", "ks_p_value", th))
    return out.drop("n_ref", "n_cur", "_small")


def categorical_drift(ref: DataFrame, cur: DataFrame, categorical: list[str],
                      th: DriftThresholds = DEFAULT) -> DataFrame:
    chi = st.chi2_two_sample(st.to_long_cat(ref, categorical), st.to_long_cat(cur, categorical),
                             th.chi2_pvalue_limite)
    return chi.withColumn("nivel", F.when(F.col("drift_detectado"), "critico").otherwise("ok"))


def feature_drift(ref: DataFrame, cur: DataFrame, numeric: list[str], categorical: list[str],
                  th: DriftThresholds = DEFAULT) -> DataFrame:
    """D1 report rows: one per feature (tipo numerica / categorica) plus a
    summary row (feature = '__resumo__') with psi_geral (A18), drift flag and
    the worst level among numeric features (atencao does not count, Q12).  The
    handful of numeric rows is stored once: the rows and the summary read it."""
    num = numeric_drift(ref, cur, numeric, th).select(
        "feature", F.lit("numerica").alias("tipo"), F.round("psi", 6).alias("psi"),
        F.round("ks_statistic", 6).alias("ks_statistic"), F.round("ks_p_value", 6).alias("ks_p_value"),
        F.lit(None).cast("double").alias("chi2_statistic"),
        F.lit(None).cast("double").alias("chi2_p_value"),
        F.lit(None).cast("boolean").alias("drift_detectado"), "nivel")
    num = scratch_table(num, "numeric-drift")
    rows = num
    if categorical:
        cat = categorical_drift(ref, cur, categorical, th).select(
            "feature", F.lit("categorica").alias("tipo"), F.lit(None).cast("double").alias("psi"),
            F.lit(None).cast("double").alias("ks_statistic"),
            F.lit(None).cast("double").alias("ks_p_value"),
            F.round("chi2_statistic", 6).alias("chi2_statistic"),
            F.round("chi2_p_value", 6).alias("chi2_p_value"), "drift_detectado", "nivel")
        rows = rows.unionByName(cat)
    return rows.unionByName(drift_summary(num, th))


# --- A18 ----------------------------------------------------------------------
def drift_summary(num_rows: DataFrame, th: DriftThresholds = DEFAULT) -> DataFrame:
    """Summary row: mean PSI (6 decimals), drift if > psi_alerta, worst of
    critico / alerta among numeric levels."""
    worst = F.max(F.when(F.col("nivel") == "critico", 3).when(F.col("nivel") == "alerta", 2)
                  .otherwise(0))
    g = num_rows.agg(F.round(F.avg("psi"), 6).alias("psi"), worst.alias("w"),
                     F.count(F.lit(1)).alias("n"))
    return g.select(
        F.lit("__resumo__").alias("feature"), F.lit("resumo").alias("tipo"),
        F.when(F.col("n") > 0, F.col("psi")).otherwise(F.lit(0.0)).alias("psi"),
        F.lit(None).cast("double").alias("ks_statistic"),
        F.lit(None).cast("double").alias("ks_p_value"),
        F.lit(None).cast("double").alias("chi2_statistic"),
        F.lit(None).cast("double").alias("chi2_p_value"),
        F.coalesce(F.col("psi") > th.psi_alerta, F.lit(False)).alias("drift_detectado"),
        _rank_level(F.coalesce(F.col("w"), F.lit(0))).alias("nivel"))


# --- D3 / D4 ------------------------------------------------------------------
def _one_feature_drift(ref: DataFrame, cur: DataFrame, c: str, th: DriftThresholds,
                       with_p: bool = True) -> DataFrame:
    prof = st.value_profile(st.to_long(ref, [c]), st.to_long(cur, [c]))
    out = st.ks_of(st.two_sample(prof, th.n_bins))
    sel = [F.round("psi", 6).alias("psi"), F.round("ks_statistic", 6).alias("ks_statistic")]
    if with_p:
        out = st.with_ks_pvalue(out, th.ks_exact_rows)
        sel += [F.round("ks_p_value", 6).alias("ks_p_value"),
                drift_level("psi", "ks_p_value", th).alias("nivel")]
    sel.append(F.coalesce(F.col("psi") > th.psi_alerta, F.lit(False)).alias("drift_detectado"))
    return out.select(*sel)


def prediction_drift(ref_preds: DataFrame, cur_preds: DataFrame, prob: str = "probabilidade",
                     th: DriftThresholds = DEFAULT, with_p: bool = True) -> DataFrame:
    """D3: PSI + KS between two prediction samples; drift if psi > 0.2."""
    return _one_feature_drift(ref_preds.select(F.col(prob).alias("predicao")),
                              cur_preds.select(F.col(prob).alias("predicao")), "predicao", th, with_p)


def concept_drift(ref: DataFrame, cur: DataFrame, y: str = "y", p: str = "y_prob",
                  th: DriftThresholds = DEFAULT, with_p: bool = True) -> DataFrame:
    """PSI + KS between the absolute errors |y - p| of two samples."""
    err = lambda d: d.select(F.abs(F.col(y) - F.col(p)).alias("erro"))
    return _one_feature_drift(err(ref), err(cur), "erro", th, with_p)


# --- D5 -----------------------------------------------------------------------
def full_drift_report(feature_rows: DataFrame, pred_row: DataFrame | None = None,
                      concept_row: DataFrame | None = None) -> DataFrame:
    """Overall level = worst of the feature summary, prediction and concept
    levels; drift when critico or alerta.  One row per part plus 'geral'."""
    parts = feature_rows.filter(F.col("feature") == "__resumo__").select(
        F.lit("feature_drift").alias("parte"), "nivel", "drift_detectado")
    for name, r in (("prediction_drift", pred_row), ("concept_drift", concept_row)):
        if r is not None:
            parts = parts.unionByName(r.select(F.lit(name).alias("parte"), "nivel", "drift_detectado"))
    g = parts.agg(F.max(_level_rank("nivel")).alias("r")).select(
        F.lit("geral").alias("parte"), _rank_level("r").alias("nivel"),
        F.col("r") >= 2)
    return parts.unionByName(g.toDF("parte", "nivel", "drift_detectado"))


# --- D6 -----------------------------------------------------------------------
def baseline_drift(baseline: DataFrame, current: DataFrame,
                   th: DriftThresholds = DEFAULT) -> DataFrame:
    """Per feature: psi (A7, 4 decimals), drift_score = min(1, psi / 0.25)
    (4 decimals), drifted when >= threshold; plus an 'overall' row with the
    max score."""
    psi = st.psi_normalised(baseline, current, th.min_count)
    rows = psi.select("feature", F.round(F.least(F.lit(1.0), F.col("psi") / 0.25), 4).alias("drift_score"),
                      F.round("psi", 4).alias("psi"))
    rows = scratch_table(rows.withColumn(
        "drifted", F.col("drift_score") >= th.baseline_threshold), "baseline-drift")
    over = rows.agg(F.round(F.coalesce(F.max("drift_score"), F.lit(0.0)), 4).alias("s")).select(
        F.lit("__overall__").alias("feature"), F.col("s").alias("drift_score"),
        F.lit(None).cast("double").alias("psi"), (F.col("s") >= th.baseline_threshold).alias("drifted"))
    return rows.unionByName(over)


# --- D7 -----------------------------------------------------------------------
DECAY_METRICS = ["auc", "precisao", "recall", "f1", "acuracia"]


def model_decay(base: DataFrame, cur: DataFrame, th: DriftThresholds = DEFAULT,
                metrics: list[str] | None = None) -> DataFrame:
    """Both inputs are one-row metric frames.  Per metric: degradation =
    clamp((base - cur) / base, 0, 1) (0 when base <= 0), 4 decimals, drifted
    when >= threshold; plus an 'overall' row with the mean."""
    metrics = metrics or DECAY_METRICS
    b = base.select(F.array(*[F.struct(F.lit(m).alias("metrica"), F.col(m).cast("double").alias("v"))
                              for m in metrics]).alias("b"))
    c = cur.select(F.array(*[F.col(m).cast("double") for m in metrics]).alias("c"))
    # two one-row frames -> one row without a join: stack and aggregate
    both = (b.select(F.col("b"), F.lit(None).cast("array<double>").alias("c"))
            .unionByName(c.select(F.lit(None).alias("b").cast(b.schema["b"].dataType), "c"))
            .agg(F.first("b", ignorenulls=True).alias("b"), F.first("c", ignorenulls=True).alias("c")))
    z = both.select(F.explode(F.arrays_zip("b", "c")).alias("z"))
    rows = z.select(F.col("z.b.metrica").alias("metrica"), F.col("z.b.v").alias("base"),
                    F.col("z.c").alias("atual"))
    deg = F.when(F.col("base") <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("base") - F.col("atual")) / F.col("base"))))
    rows = rows.select("metrica", F.round("base", 4).alias("baseline"),
                       F.round("atual", 4).alias("atual"), deg.alias("_d"))
    out = rows.select("metrica", "baseline", "atual", F.round("_d", 4).alias("degradacao"),
                      (F.col("_d") >= th.decay_threshold).alias("drifted"))
    over = rows.agg(F.round(F.avg("_d"), 4).alias("d")).select(
        F.lit("__overall__").alias("metrica"), F.lit(None).cast("double").alias("baseline"),
        F.lit(None).cast("double").alias("atual"), F.col("d").alias("degradacao"),
        (F.col("d") >= th.decay_threshold).alias("drifted"))
    return out.unionByName(over)


# --- D9 -----------------------------------------------------------------------
# Python formats with round-half-even on the exact binary value; bround
# first, then print, so ties like 0.53125 read 0.5312 as in the reference.
ALERT_LIMITS = {"auc_roc": ("AUC-ROC", 0.8), "precision": ("Precision", 0.7),
                "recall": ("Recall", 0.6), "f1": ("F1", 0.65)}


def metric_alerts(metrics: DataFrame, limits: dict | None = None,
                  names: dict | None = None) -> DataFrame:
    """Alert texts per metric row ('<Name> <v:.4f> < <limit>') and active flag.
    ``names`` maps the canonical metric names to this frame's columns."""
    limits = limits or ALERT_LIMITS
    names = names or {}
    arr = F.filter(F.array(*[
        F.when(F.col(names.get(k, k)) < lim,
               F.format_string(f"{label} %.4f < {lim}", F.bround(F.col(names.get(k, k)), 4)))
        for k, (label, lim) in limits.items()]), lambda x: x.isNotNull())
    return metrics.withColumn("alertas", arr).withColumn("alerta_ativo", F.size("alertas") > 0)


# --- D10 ----------------------------------------------------------------------
# Fixed values that must equal the reference's (texts); the title is a
# parameter, because the reference puts a product's name there.
ALERT_TITLE = ":rotating_light: *Drift detectado nos modelos*"
TXT_DATA_DRIFT = "- *Data drift*: score %%.4f (threshold %s)"
TXT_MODEL_DRIFT = "- *Model drift*: degradação %%.4f (threshold %s)"
TXT_FEATURES = "  - Features com drift: "
TXT_METRICS = "  - Métricas degradadas: "
TXT_RETRAIN = "- Retreino automático acionado."


def alert_text(data_report: DataFrame, model_report: DataFrame, retrain: bool = False,
               data_threshold: float = 0.15, model_threshold: float = 0.1,
               title: str = ALERT_TITLE) -> DataFrame:
    """One-row text of the alert (no row when neither report drifted)."""
    d = data_report.agg(
        F.max(F.when(F.col("feature") == "__overall__", F.col("drift_score"))).alias("ds"),
        F.max(F.when(F.col("feature") == "__overall__", F.col("drifted").cast("int"))).alias("dd"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            (F.col("feature") != "__overall__") & F.col("drifted"),
            F.struct("feature", "drift_score")))),
            lambda s: F.format_string("%s (%.2f)", s["feature"], F.bround(s["drift_score"], 2))), ", ").alias("df"))
    m = model_report.agg(
        F.max(F.when(F.col("metrica") == "__overall__", F.col("degradacao"))).alias("md"),
        F.max(F.when(F.col("metrica") == "__overall__", F.col("drifted").cast("int"))).alias("mdd"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            (F.col("metrica") != "__overall__") & F.col("drifted"),
            F.struct("metrica", "degradacao")))),
            lambda s: F.format_string("%s (%.2f)", s["metrica"], F.bround(s["degradacao"], 2))), ", ").alias("mf"))
    both = d.select("ds", "dd", "df", F.lit(None).cast("double").alias("md"),
                    F.lit(None).cast("int").alias("mdd"), F.lit(None).cast("string").alias("mf")) \
        .unionByName(m.select(F.lit(None).cast("double").alias("ds"), F.lit(None).cast("int").alias("dd"),
                              F.lit(None).cast("string").alias("df"), "md", "mdd", "mf")) \
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("ds", "dd", "df", "md", "mdd", "mf")])
    data_on = F.coalesce(F.col("dd"), F.lit(0)) == 1
    model_on = F.coalesce(F.col("mdd"), F.lit(0)) == 1
    lines = F.array(
        F.lit(title),
        F.when(data_on, F.format_string(TXT_DATA_DRIFT % data_threshold, F.bround("ds", 4))),
        F.when(data_on & (F.col("df") != ""), F.concat(F.lit(TXT_FEATURES), F.col("df"))),
        F.when(model_on, F.format_string(TXT_MODEL_DRIFT % model_threshold, F.bround("md", 4))),
        F.when(model_on & (F.col("mf") != ""), F.concat(F.lit(TXT_METRICS), F.col("mf"))),
        F.when(F.lit(retrain), F.lit(TXT_RETRAIN)))
    return both.filter(data_on | model_on).select(
        F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("texto"))


# --- D12 / A21 ----------------------------------------------------------------
def retrain_decision(reports: DataFrame, model: str = "fraud_detection", force: bool = False,
                     flag: str = "drifted", key: str = "feature") -> DataFrame:
    """Retrain when any report's overall row drifted, or forced."""
    r = reports.filter(F.col(key) == "__overall__").agg(
        F.coalesce(F.bool_or(flag), F.lit(False)).alias("drift"))
    return r.select((F.col("drift") | F.lit(force)).alias("retrain_triggered"),
                    F.lit(model).alias("modelo"),
                    F.when(F.col("drift"), "drift").when(F.lit(force), "forced")
                    .otherwise("none").alias("motivo"))


# --- S9 -----------------------------------------------------------------------
def prometheus_lines(data_report: DataFrame, model_report: DataFrame,
                     prefix: str = "ml") -> DataFrame:
    """Gauge lines ``name{label="x"} value`` of the textfile exporter: four
    unlabelled gauges and two labelled families (one row per line), named
    ``<prefix>_...``."""
    d = data_report.select(
        F.when(F.col("feature") == "__overall__", F.lit(f"{prefix}_data_drift_score"))
        .otherwise(F.concat(F.lit(prefix + '_feature_drift_score{feature="'), F.col("feature"),
                            F.lit('"}'))).alias("metric"),
        F.col("drift_score").cast("double").alias("value"))
    dd = data_report.filter(F.col("feature") == "__overall__").select(
        F.lit(f"{prefix}_data_drift_detected").alias("metric"),
        F.col("drifted").cast("double").alias("value"))
    m = model_report.select(
        F.when(F.col("metrica") == "__overall__", F.lit(f"{prefix}_model_degradation"))
        .otherwise(F.concat(F.lit(prefix + '_metric_degradation{metrica="'), F.col("metrica"),
                            F.lit('"}'))).alias("metric"),
        F.col("degradacao").cast("double").alias("value"))
    md = model_report.filter(F.col("metrica") == "__overall__").select(
        F.lit(f"{prefix}_model_drift_detected").alias("metric"),
        F.col("drifted").cast("double").alias("value"))
    out = d.unionByName(dd).unionByName(m).unionByName(md)
    return out.select("metric", "value",
                      F.concat_ws(" ", "metric", F.col("value").cast("decimal(18,4)").cast("string"))
                      .alias("line"))

