"""Registered queries: round trips of given tables through the readers and
sinks (S2-S5, S7, S8, S10, S11), feature choice (F4), regimes (U3) and
thresholds (U4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as gv
from ..operators import ml, prep
from ..operators import stats as st
from ..session import scratch_path
from ..sources import io
from .catalog import _ORACLE, finish, register
from .q_features import _JOINED_SQL
from .q_governance import AMB_SQL, CASES_SQL
from .q_ml import _credit_model, credit_training_table
from .q_stats import CAT, NUM, sides


@register("read_by_suffix", """
SELECT n_nationkey, n_name, n_regionkey, 'csv' AS how FROM nation
UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'parquet' FROM nation""")
def q_read_by_suffix(t):
    """A table written as CSV and as Parquet and read by its suffix."""
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    base = scratch_path(t.spark, "suffix")
    n.write.option("header", True).csv(f"{base}/nation.csv")
    n.write.parquet(f"{base}/nation.parquet")
    out = [io.read_by_suffix(t.spark, f"{base}/nation.{how}", n.schema).withColumn("how", F.lit(how))
           for how in ("csv", "parquet")]
    return out[0].unionByName(out[1])


@register("read_transactions_json", """
SELECT l_orderkey * 10 + l_linenumber AS id, round(l_extendedprice, 2) AS valor FROM lineitem""")
def q_read_transactions_json(t):
    """S3: transactions in objects with a list, one per document."""
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                             F.round("l_extendedprice", 2).alias("valor"))
    path = scratch_path(t.spark, "json")
    # 4096 order keys (a few thousand rows) a document however large the table,
    # one document a file
    docs = rows.groupBy(F.expr("id div 40960").alias("d")).agg(
        F.collect_list(F.struct("id", "valor")).alias("transactions"))
    docs.select(F.to_json(F.struct("transactions")).alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)
    return finish(io.read_transactions_json(t.spark, path).select("id", "valor"))


@register("metric_log", """
SELECT CAST(dia AS VARCHAR) AS dia, round(auc_roc, 6) AS auc_roc, n_amostras FROM fx_metricas""")
def q_metric_log(t):
    """Metrics appended to a JSON log by day, with a malformed line, and
    read back."""
    path = scratch_path(t.spark, "log")
    m = t.fx_metricas.select(F.col("dia").cast("string").alias("timestamp"), "auc_roc",
                             F.col("n_amostras"))
    io.append_log(m, path)
    t.spark.range(1).select(F.lit("{not json").alias("value")).write.text(f"{path}/date=bad")
    return finish(io.read_metric_log(t.spark, path).select(F.col("timestamp").alias("dia"), "auc_roc",
                                                           "n_amostras"))


@register("feature_view", f"""
WITH v AS (SELECT id_cliente, round(CAST(saldo_atual AS DOUBLE), 2) AS saldo FROM fx_contas)
SELECT id_cliente, saldo, '2024-01-01' AS snapshot_date FROM v
UNION ALL SELECT id_cliente, saldo, '2024-01-02' FROM v WHERE id_cliente % 2 = 0""")
def q_feature_view(t):
    """Two dated snapshots; writing the second again replaces only it."""
    v = t.fx_contas.select("id_cliente", F.round("saldo_atual", 2).alias("saldo"))
    path = scratch_path(t.spark, "view")
    io.write_feature_view(v, path, "2024-01-01")
    io.write_feature_view(v, path, "2024-01-02")
    io.write_feature_view(v.filter("id_cliente % 2 = 0"), path, "2024-01-02")
    return t.spark.read.parquet(path).select(
        "id_cliente", "saldo", F.col("snapshot_date").cast("string").alias("snapshot_date"))


@register("decisions_csv", f"""
SELECT * EXCLUDE (gates_triggered), '' AS gates FROM ({_ORACLE['r1_decide']}) o""")
def q_decisions_csv(t):
    """R1 decisions written as CSV and read back."""
    from .catalog import _QUERIES
    d = _QUERIES["r1_decide"](t.spark, t.sf_dir)
    path = scratch_path(t.spark, "csv")
    io.write_decisions_csv(d.withColumnRenamed("gates_triggered", "gates"), path)
    kinds = {"i6q_passed": "boolean", "tokens_used": "long", "i6q_retries": "int"}
    back = t.spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(path)
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "gates"
                         else F.col(c).cast(kinds.get(c, "string")).alias(c) for c in back.columns])


@register("report_json", _ORACLE["baseline_drift"])
def q_report_json(t):
    """The baseline drift report written as JSON lines and read back."""
    from .catalog import _QUERIES
    path = scratch_path(t.spark, "report")
    rep = _QUERIES["baseline_drift"](t.spark, t.sf_dir)
    io.write_report_json(rep, path)
    return t.spark.read.schema(rep.schema).json(path)


@register("stored_baseline", _ORACLE["baseline_stats"])
def q_stored_baseline(t):
    """The baseline built once, stored and reused."""
    ref, _ = sides(t)
    path = scratch_path(t.spark, "stored")
    io.load_or_build_baseline(t.spark, path, lambda: st.baseline_stats(ref, NUM, CAT))

    def never():
        raise AssertionError("a stored baseline is not built again")
    return finish(io.load_or_build_baseline(t.spark, path, never))


@register("model_round_trip", f"SELECT count(*) AS n, 0 AS differ FROM ({_JOINED_SQL}) c")
def q_model_round_trip(t):
    """The credit model saved, loaded and compared on every row."""
    path = scratch_path(t.spark, "model")
    ml.save_model(_credit_model(t), path, prep.V2_FEATURES, {"versao": "1"})
    loaded, meta = ml.load_model(path)
    x = credit_training_table(t)
    a = ml.positive_prob(_credit_model(t).transform(x)).select("id_cliente", F.col("p").alias("a"))
    b = ml.positive_prob(loaded.transform(x.select("id_cliente", *meta["features"]))).select(
        "id_cliente", F.col("p").alias("b"))
    return a.join(b, "id_cliente").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(
        F.when(F.col("a") != F.col("b"), 1).otherwise(0)), F.lit(0)).cast("int").alias("differ"))


@register("pick_feature_columns", """
SELECT * FROM (VALUES ('c_custkey', 'numerica'), ('c_nationkey', 'numerica'), ('c_acctbal', 'numerica'),
  ('c_name', 'categorica'), ('c_mktsegment', 'categorica')) v(coluna, tipo)""")
def q_pick_feature_columns(t):
    """numeric and categorical columns of a table's schema."""
    num, cat = st.pick_feature_columns(t.customer)
    return t.spark.createDataFrame([(c, "numerica") for c in num] + [(c, "categorica") for c in cat],
                                   "coluna string, tipo string")


@register("custom_regime", f"""
WITH {CASES_SQL.strip()}
SELECT case_id, CASE WHEN client_score >= 600 THEN 'APPROVE' ELSE 'DEFER' END AS decision FROM cases""")
def q_custom_regime(t):
    """A registered regime decides over the same contract."""
    def by_score(cases, answers, key, th):
        ok = cases.join(answers.select(key), key, "left_semi")
        return ok.select("case_id", F.when(F.col("client_score") >= 600, "APPROVE")
                         .otherwise("DEFER").alias("decision"))
    gv.register_regime("by_score", by_score)
    return gv.decide("by_score", t.fx_casos, t.fx_candidatos)


@register("gate_thresholds", f"""
SELECT case_id, {AMB_SQL.replace('< 0.30', '< 0.90').replace('>= 0.75', '>= 0.4')} AS override FROM fx_casos""")
def q_gate_thresholds(t):
    """U4: the ambiguity gate under other thresholds."""
    th = gv.GovernanceThresholds(theta_iota=0.90, risk_escalation_threshold=0.4)
    return t.fx_casos.select("case_id", gv.ambiguity_gate(th).alias("override"))

