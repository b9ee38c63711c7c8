"""Registered queries: model-input preparation and scoring rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..operators import prep
from ..sources.fixtures import AS_OF_FRAUDE, AS_OF_TRANSACOES
from .catalog import finish, register, rounded
from .q_features import _DERIVED_SQL, credit_features_df

CREDIT = f"({_DERIVED_SQL})"


def _r6(cols):
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {n}" for n, c in cols)


def _coalesce0(expr):
    return f"COALESCE(CAST({expr} AS DOUBLE), 0.0)"


# --- P2 ---------------------------------------------------------------------
_V2_EXPR = {
    "renda_log": "ln(1 + COALESCE(renda_mensal, 0))",
    "renda_per_capita": "renda_mensal / (pessoas_residencia + 1)",
    "idade_squared": "idade * idade",
    "saldo_renda_ratio": "saldo_atual / (renda_mensal + 1)",
    "comprometimento_renda": "total_dividas / (renda_mensal + 1)",
    "parcela_renda_ratio": "valor_parcela / (renda_mensal + 1)",
    "transacao_frequency": "CAST(numero_operacoes_credito AS DOUBLE) / GREATEST(COALESCE(tempo_conta_meses, 1.0), 1.0)",
    "risk_score": "(1 - LEAST(GREATEST(score_bureau, 0), 1000) / 1000.0) * 0.4 + LEAST(GREATEST(atrasos_hist, 0), 30) / 30.0 * 0.3 + LEAST(GREATEST(total_dividas / (renda_mensal + 1), 0), 5) / 5.0 * 0.3",
    "saldo_ratio": "saldo_atual / (saldo_medio_12m + 1)",
    "escolaridade_numeric": "CASE escolaridade WHEN 'FUNDAMENTAL' THEN 1 WHEN 'MEDIO' THEN 2 WHEN 'SUPERIOR' THEN 3 WHEN 'POS_GRADUACAO' THEN 4 WHEN 'MESTRADO' THEN 5 WHEN 'DOUTORADO' THEN 6 ELSE 0 END",
    "is_married": "CASE WHEN estado_civil = 'CASADO' THEN 1 ELSE 0 END",
    "is_clt": "CASE WHEN tipo_empregador = 'CLT' THEN 1 ELSE 0 END",
    "is_pj": "CASE WHEN tipo_empregador = 'PJ' THEN 1 ELSE 0 END",
    "is_servidor": "CASE WHEN tipo_empregador = 'SERV_PUBLICO' THEN 1 ELSE 0 END",
    "is_capital": "CASE WHEN cidade IN ('Sao Paulo','Rio de Janeiro','Belo Horizonte','Salvador','Brasilia','Campinas','Porto Alegre','Fortaleza','Curitiba') THEN 1 ELSE 0 END",
}


def _feature_sql(order, exprs, source, keep=("id_cliente",)):
    sel = [*keep] + [f"round({_coalesce0(exprs.get(n, n))}, 6) AS {n}" for n in order]
    return f"SELECT {', '.join(sel)} FROM {source} src"


@register("prepare_credit_v2", _feature_sql(prep.V2_FEATURES, _V2_EXPR, CREDIT))
def q_prepare_credit_v2(t):
    """30 model-v2 features over the credit table."""
    return finish(prep.prepare_credit_v2(credit_features_df(t), keep=["id_cliente"]))


_V1_EXPR = dict(_V2_EXPR)
_V1_EXPR.update({
    "tempo_conta_meses": "floor((epoch(TIMESTAMP '2001-11-05 00:00:00') - epoch(data_abertura)) / 86400) / 30.0",
    "is_capital": "CASE WHEN cidade IN ('São Paulo','Rio de Janeiro','Belo Horizonte','Salvador','Brasília') THEN 1 ELSE 0 END",
})


@register("prepare_credit_v1", _feature_sql(prep.V1_FEATURES, _V1_EXPR, CREDIT))
def q_prepare_credit_v1(t):
    """24 model-v1 features, account age recomputed at as_of."""
    return finish(prep.prepare_credit_v1(credit_features_df(t), AS_OF_TRANSACOES,
                                         keep=["id_cliente"]))


_LEGACY_SRC = (f"(SELECT *, total_transacoes_90d AS transacoes_ultimo_mes, "
               f"CAST(NULL AS VARCHAR) AS profissao FROM {CREDIT} c0)")
_LEGACY_EXPR = dict(_V1_EXPR)
_LEGACY_EXPR.update({
    "renda_log": "ln(1 + renda_mensal)",
    "is_young": "CASE WHEN idade < 30 THEN 1 ELSE 0 END",
    "is_middle_age": "CASE WHEN idade >= 30 AND idade <= 50 THEN 1 ELSE 0 END",
    "is_senior": "CASE WHEN idade > 50 THEN 1 ELSE 0 END",
    "is_single": "CASE WHEN estado_civil = 'SOLTEIRO' THEN 1 ELSE 0 END",
    "is_high_income_profession": "CASE WHEN profissao IN ('MEDICO','ENGENHEIRO','ADVOGADO','DENTISTA','ARQUITETO') THEN 1 ELSE 0 END",
    "transacoes_mes": "transacoes_ultimo_mes",
    "valor_medio_transacao": "valor_total_transacoes / (transacoes_ultimo_mes + 1)",
})


def legacy_input(t):
    """Stand-in rows in the legacy schema from the credit table."""
    return (credit_features_df(t)
            .withColumn("transacoes_ultimo_mes", F.col("total_transacoes_90d"))
            .withColumn("profissao", F.lit(None).cast("string")))


@register("prepare_credit_legacy", _feature_sql(prep.LEGACY_FEATURES, _LEGACY_EXPR, _LEGACY_SRC))
def q_prepare_credit_legacy(t):
    """18 legacy score-model features."""
    return finish(prep.prepare_credit_legacy(legacy_input(t), AS_OF_TRANSACOES,
                                             keep=["id_cliente"]))


# --- P5..P13 (fraud) --------------------------------------------------------
_FRAUD_SQL = """
WITH f AS (SELECT * FROM fx_fraude),
q AS (SELECT quantile_cont(valor, 0.95) AS p95 FROM f),
mc AS (SELECT cidade AS m FROM (SELECT cidade, COUNT(*) n FROM f WHERE cidade IS NOT NULL GROUP BY 1) ORDER BY n DESC, cidade LIMIT 1),
ms AS (SELECT estado AS m FROM (SELECT estado, COUNT(*) n FROM f WHERE estado IS NOT NULL GROUP BY 1) ORDER BY n DESC, estado LIMIT 1),
mx AS (SELECT MAX(score_risco) AS m FROM f),
b AS (
  SELECT f.*,
    AVG(valor) OVER (PARTITION BY conta_id) AS avg_v,
    COUNT(*) OVER (PARTITION BY conta_id ORDER BY data_transacao RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS t1h,
    COUNT(*) OVER (PARTITION BY conta_id ORDER BY data_transacao RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS t24h,
    DENSE_RANK() OVER (ORDER BY COALESCE(tipo_transacao, 'None')) - 1 AS c_tipo,
    DENSE_RANK() OVER (ORDER BY COALESCE(status, 'None')) - 1 AS c_status,
    DENSE_RANK() OVER (ORDER BY COALESCE(cidade, 'None')) - 1 AS c_cidade,
    DENSE_RANK() OVER (ORDER BY COALESCE(estado, 'None')) - 1 AS c_estado
  FROM f)
SELECT id,
  round(COALESCE(valor, 0), 6) AS valor,
  round(COALESCE(ln(1 + valor), 0), 6) AS valor_log,
  round(COALESCE(sqrt(valor), 0), 6) AS valor_sqrt,
  CAST(hour(data_transacao) AS DOUBLE) AS hour,
  CAST(isodow(data_transacao) - 1 AS DOUBLE) AS day_of_week,
  CAST(day(data_transacao) AS DOUBLE) AS day_of_month,
  CAST(month(data_transacao) AS DOUBLE) AS month,
  CASE WHEN valor > (SELECT p95 FROM q) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_high_value,
  CASE WHEN valor % 1000 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_round_value,
  CASE WHEN cidade = (SELECT m FROM mc) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_same_city,
  CASE WHEN estado = (SELECT m FROM ms) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_same_state,
  CASE WHEN canal = 'MOBILE' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_mobile,
  CASE WHEN canal = 'WEB' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_web,
  CASE WHEN canal = 'ATM' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_atm,
  CASE WHEN hour(data_transacao) BETWEEN 9 AND 18 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_business_hours,
  CASE WHEN hour(data_transacao) >= 22 OR hour(data_transacao) <= 6 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_night,
  CASE WHEN isodow(data_transacao) - 1 >= 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_weekend,
  CASE WHEN contains(dispositivo, 'iPhone') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_iphone,
  CASE WHEN contains(dispositivo, 'Android') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_android,
  CASE WHEN contains(dispositivo, 'Samsung') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_samsung,
  COALESCE(TRY_CAST(split_part(ip_address, '.', 1) AS DOUBLE), 0.0) AS ip_first_octet,
  COALESCE(TRY_CAST(NULLIF(split_part(ip_address, '.', 2), '') AS DOUBLE), 0.0) AS ip_second_octet,
  CASE WHEN contains(user_agent, 'Chrome') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_chrome,
  CASE WHEN contains(user_agent, 'Firefox') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_firefox,
  CASE WHEN contains(user_agent, 'Safari') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_safari,
  round(COALESCE(score_risco / (SELECT m FROM mx), 0), 6) AS score_risco_normalized,
  CAST(t1h AS DOUBLE) AS transactions_last_hour,
  CAST(t24h AS DOUBLE) AS transactions_last_day,
  round(COALESCE(valor / avg_v, 0), 6) AS transaction_value_ratio,
  CAST(c_tipo AS DOUBLE) AS tipo_transacao_encoded,
  CAST(c_status AS DOUBLE) AS status_encoded,
  CAST(c_cidade AS DOUBLE) AS cidade_encoded,
  CAST(c_estado AS DOUBLE) AS estado_encoded
FROM b"""


@register("prepare_fraud", _FRAUD_SQL)
def q_prepare_fraud(t):
    """P5 (with P6-P13, W1, W2, W5): fraud features with fitted constants."""
    return finish(prep.prepare_fraud(t.fx_fraude))


@register("trailing_counts", """
SELECT id, conta_id,
  COUNT(*) OVER (PARTITION BY conta_id ORDER BY data_transacao RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS transactions_last_hour,
  COUNT(*) OVER (PARTITION BY conta_id ORDER BY data_transacao RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS transactions_last_day
FROM fx_fraude""")
def q_trailing_counts(t):
    """Real 1 h / 24 h trailing transaction counts per account."""
    from ..operators.windows import trailing_counts
    return trailing_counts(t.fx_fraude.select("id", "conta_id", "data_transacao")) \
        .select("id", "conta_id", "transactions_last_hour", "transactions_last_day")


@register("account_mean", """
SELECT id, conta_id, round(AVG(valor) OVER (PARTITION BY conta_id), 6) AS avg_transaction_value,
       round(valor / AVG(valor) OVER (PARTITION BY conta_id), 6) AS transaction_value_ratio
FROM fx_fraude""")
def q_account_mean(t):
    """W1 + P13: account mean on every row and the value ratio."""
    from ..operators.windows import account_mean
    df = account_mean(t.fx_fraude.select("id", "conta_id", "valor"))
    return finish(df.select("id", "conta_id", "avg_transaction_value",
                            (F.col("valor") / F.col("avg_transaction_value"))
                            .alias("transaction_value_ratio")))


@register("label_codes", """
SELECT id, CAST(DENSE_RANK() OVER (ORDER BY tipo_transacao) - 1 AS INTEGER) AS tipo_transacao_encoded,
       CAST(DENSE_RANK() OVER (ORDER BY cidade) - 1 AS INTEGER) AS cidade_encoded
FROM fx_fraude""")
def q_label_codes(t):
    """0-based codes by sorted distinct value (distributed dictionary)."""
    from ..operators.windows import label_codes
    df = label_codes(t.fx_fraude.select("id", "tipo_transacao", "cidade"), "tipo_transacao")
    df = label_codes(df, "cidade")
    return df.select("id", "tipo_transacao_encoded", "cidade_encoded")


@register("time_parts", """
SELECT id, CAST(hour(data_transacao) AS INTEGER) AS hour, CAST(isodow(data_transacao) - 1 AS INTEGER) AS day_of_week,
       CAST(day(data_transacao) AS INTEGER) AS day_of_month, CAST(month(data_transacao) AS INTEGER) AS month,
       CASE WHEN hour(data_transacao) BETWEEN 9 AND 18 THEN 1 ELSE 0 END AS is_business_hours,
       CASE WHEN hour(data_transacao) >= 22 OR hour(data_transacao) <= 6 THEN 1 ELSE 0 END AS is_night,
       CASE WHEN isodow(data_transacao) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend
FROM fx_fraude""")
def q_time_parts(t):
    """Calendar parts and hour flags."""
    return t.fx_fraude.select("id", *[e.alias(n) for n, e in
                                      prep.time_parts("data_transacao").items()])


@register("ip_octets", """
SELECT id, TRY_CAST(split_part(ip_address, '.', 1) AS DOUBLE) AS ip_first_octet,
       TRY_CAST(NULLIF(split_part(ip_address, '.', 2), '') AS DOUBLE) AS ip_second_octet
FROM fx_fraude""")
def q_ip_octets(t):
    """Dotted parts as double; malformed text gives null."""
    return t.fx_fraude.select("id", prep.ip_octet("ip_address", 0).alias("ip_first_octet"),
                              prep.ip_octet("ip_address", 1).alias("ip_second_octet"))


@register("modal_flags", """
WITH mc AS (SELECT cidade AS m FROM (SELECT cidade, COUNT(*) n FROM fx_fraude WHERE cidade IS NOT NULL GROUP BY 1) ORDER BY n DESC, cidade LIMIT 1),
ms AS (SELECT estado AS m FROM (SELECT estado, COUNT(*) n FROM fx_fraude WHERE estado IS NOT NULL GROUP BY 1) ORDER BY n DESC, estado LIMIT 1)
SELECT id, CASE WHEN cidade = (SELECT m FROM mc) THEN 1 ELSE 0 END AS is_same_city,
       CASE WHEN estado = (SELECT m FROM ms) THEN 1 ELSE 0 END AS is_same_state
FROM fx_fraude""")
def q_modal_flags(t):
    """City / state equal to the global mode (smallest on ties)."""
    f = t.fx_fraude
    city = prep.global_mode(f, "cidade").first()["mode"]
    state = prep.global_mode(f, "estado").first()["mode"]
    return f.select("id", prep._flag(F.col("cidade") == F.lit(city)).alias("is_same_city"),
                    prep._flag(F.col("estado") == F.lit(state)).alias("is_same_state"))


@register("value_features", """
WITH q AS (SELECT quantile_cont(valor, 0.95) AS p95, MAX(score_risco) AS mx FROM fx_fraude)
SELECT id, round(ln(1 + valor), 6) AS valor_log, round(sqrt(valor), 6) AS valor_sqrt,
       CASE WHEN valor > (SELECT p95 FROM q) THEN 1 ELSE 0 END AS is_high_value,
       CASE WHEN valor % 1000 = 0 THEN 1 ELSE 0 END AS is_round_value,
       round(score_risco / (SELECT mx FROM q), 6) AS score_risco_normalized
FROM fx_fraude""")
def q_value_features(t):
    """P7 + P12: log/sqrt, above global p95, round values, risk / global max."""
    f = t.fx_fraude
    fit = prep.fit_fraud(f)
    v = F.col("valor")
    return finish(f.select(
        "id", F.log1p(v).alias("valor_log"), F.sqrt(v).alias("valor_sqrt"),
        prep._flag(v > F.lit(fit.p95)).alias("is_high_value"),
        prep._flag(F.try_mod(v, F.lit(1000)) == 0).alias("is_round_value"),
        (F.col("score_risco") / F.lit(fit.max_risk)).alias("score_risco_normalized")))


@register("channel_device_flags", """
SELECT id,
  CASE WHEN canal = 'MOBILE' THEN 1 ELSE 0 END AS is_mobile,
  CASE WHEN canal = 'WEB' THEN 1 ELSE 0 END AS is_web,
  CASE WHEN canal = 'ATM' THEN 1 ELSE 0 END AS is_atm,
  CASE WHEN contains(dispositivo, 'iPhone') THEN 1 ELSE 0 END AS is_iphone,
  CASE WHEN contains(dispositivo, 'Android') THEN 1 ELSE 0 END AS is_android,
  CASE WHEN contains(dispositivo, 'Samsung') THEN 1 ELSE 0 END AS is_samsung,
  CASE WHEN contains(user_agent, 'Chrome') THEN 1 ELSE 0 END AS is_chrome,
  CASE WHEN contains(user_agent, 'Firefox') THEN 1 ELSE 0 END AS is_firefox,
  CASE WHEN contains(user_agent, 'Safari') THEN 1 ELSE 0 END AS is_safari
FROM fx_fraude""")
def q_channel_device_flags(t):
    """P9 + P10: channel equality flags, device / agent substring flags."""
    fl = prep._flag
    c = F.col
    return t.fx_fraude.select(
        "id", fl(c("canal") == "MOBILE").alias("is_mobile"), fl(c("canal") == "WEB").alias("is_web"),
        fl(c("canal") == "ATM").alias("is_atm"),
        fl(c("dispositivo").contains("iPhone")).alias("is_iphone"),
        fl(c("dispositivo").contains("Android")).alias("is_android"),
        fl(c("dispositivo").contains("Samsung")).alias("is_samsung"),
        fl(c("user_agent").contains("Chrome")).alias("is_chrome"),
        fl(c("user_agent").contains("Firefox")).alias("is_firefox"),
        fl(c("user_agent").contains("Safari")).alias("is_safari"))


# --- P14 / P30 (default) ----------------------------------------------------
def default_input(t):
    """Stand-in rows in the default-model schema, from the credit table."""
    return credit_features_df(t).select(
        "id_cliente", "renda_mensal", "idade",
        F.col("dias_desde_ultima").cast("double").alias("dias_atraso_medio"),
        F.col("total_dividas").alias("valor_pendente"),
        F.col("numero_operacoes_credito").alias("num_operacoes_12m"),
        (F.col("atrasos_hist") / F.greatest(F.col("total_transacoes_90d"), F.lit(1)))
        .alias("pct_pagamentos_atraso"),
        F.least(F.col("total_dividas") / F.greatest(F.col("total_financiado"), F.lit(1.0)),
                F.lit(1.0)).alias("limite_utilizado"),
        F.col("tempo_conta_meses").alias("tempo_relacionamento_meses"))


_DEFAULT_SRC = f"""(SELECT id_cliente, renda_mensal, idade, CAST(dias_desde_ultima AS DOUBLE) AS dias_atraso_medio,
  total_dividas AS valor_pendente, numero_operacoes_credito AS num_operacoes_12m,
  atrasos_hist / GREATEST(total_transacoes_90d, 1) AS pct_pagamentos_atraso,
  LEAST(total_dividas / GREATEST(total_financiado, 1.0), 1.0) AS limite_utilizado,
  tempo_conta_meses AS tempo_relacionamento_meses FROM {CREDIT} c0)"""


@register("prepare_default", _feature_sql(prep.DEFAULT_FEATURES, {
    "valor_pendente_renda": "valor_pendente / (renda_mensal + 1)",
    "renda_log": "ln(1 + renda_mensal)"}, _DEFAULT_SRC))
def q_prepare_default(t):
    """8 default-model features (absent inputs raise)."""
    return finish(prep.prepare_default(default_input(t), keep=["id_cliente"]))


@register("label_default_rule", f"""
SELECT id_cliente,
  CASE WHEN dias_atraso_medio > 30 OR pct_pagamentos_atraso > 0.2 THEN 1 ELSE 0 END AS inadimplente,
  CASE WHEN dias_atraso_medio > 30 OR pct_pagamentos_atraso > 0.25 THEN 1 ELSE 0 END AS inadimplente_gerador
FROM {_DEFAULT_SRC} d""")
def q_label_default_rule(t):
    """Default label rule, training (0.2) and generator (0.25) limits."""
    d = default_input(t)
    return d.select("id_cliente",
                    sc.label_default_rule("dias_atraso_medio", "pct_pagamentos_atraso", 0.2)
                    .alias("inadimplente"),
                    sc.label_default_rule("dias_atraso_medio", "pct_pagamentos_atraso", 0.25)
                    .alias("inadimplente_gerador"))


# --- P15 --------------------------------------------------------------------
_SEG_SRC = (f"(SELECT id_cliente, renda_mensal, idade, saldo_atual, valor_total_transacoes, "
            f"total_transacoes_90d AS transacoes_ultimo_mes FROM {CREDIT} c0)")


@register("prepare_segmentation", _feature_sql(prep.SEGMENT_FEATURES, {
    "renda_log": "ln(1 + renda_mensal)",
    "transacoes_mes": "transacoes_ultimo_mes",
    "valor_medio": "valor_total_transacoes / (transacoes_ultimo_mes + 1)",
    "saldo_renda": "saldo_atual / (renda_mensal + 1)",
    "idade_norm": "(idade - 20) / 50.0"}, _SEG_SRC))
def q_prepare_segmentation(t):
    """5 segmentation features."""
    src = credit_features_df(t).select(
        "id_cliente", "renda_mensal", "idade", "saldo_atual", "valor_total_transacoes",
        F.col("total_transacoes_90d").alias("transacoes_ultimo_mes"))
    return finish(prep.prepare_segmentation(src, keep=["id_cliente"]))


# --- P16 --------------------------------------------------------------------
@register("fill_defaults", """
SELECT id_cliente,
  COALESCE(renda_mensal, 5000.0) AS renda_mensal, COALESCE(idade, 35) AS idade,
  COALESCE(pessoas_residencia, 2) AS pessoas_residencia,
  COALESCE(escolaridade, 'SUPERIOR') AS escolaridade, COALESCE(estado_civil, 'SOLTEIRO') AS estado_civil,
  COALESCE(tipo_empregador, 'CLT') AS tipo_empregador, COALESCE(cidade, 'Sao Paulo') AS cidade,
  COALESCE(data_abertura, TIMESTAMP '2020-01-01 00:00:00') AS data_abertura,
  CAST(60 AS DOUBLE) AS tempo_conta_meses, COALESCE(score_bureau, 600) AS score_bureau,
  0 AS atrasos_hist, 0 AS consultas_ultimo_6m, CAST(0 AS DOUBLE) AS total_dividas, CAST(0 AS DOUBLE) AS total_financiado,
  CAST(0 AS DOUBLE) AS valor_parcela, CAST(10000 AS DOUBLE) AS saldo_medio_12m, CAST(12000 AS DOUBLE) AS saldo_atual,
  3 AS numero_operacoes_credito, COALESCE(possui_imovel, 0) AS possui_imovel,
  COALESCE(possui_veiculo, 0) AS possui_veiculo
FROM fx_clientes""")
def q_fill_defaults(t):
    """Request rows over the scoring default profile (nulls keep default)."""
    return prep.fill_defaults(t.fx_clientes, "scoring")


@register("fill_defaults_rest", """
SELECT id_cliente, renda_mensal, idade, pessoas_residencia, escolaridade, estado_civil,
  tipo_empregador, cidade, data_abertura, score_bureau, 0 AS atrasos_hist, 0 AS consultas_ultimo_6m,
  CAST(0 AS DOUBLE) AS total_dividas, CAST(0 AS DOUBLE) AS total_financiado, CAST(0 AS DOUBLE) AS valor_parcela, CAST(0 AS DOUBLE) AS saldo_medio_12m,
  CAST(0 AS DOUBLE) AS saldo_atual, 0 AS numero_operacoes_credito, possui_imovel, possui_veiculo
FROM fx_clientes""")
def q_fill_defaults_rest(t):
    """P16, REST profile: present request columns win even when null."""
    return prep.fill_defaults(t.fx_clientes, "rest")


# --- P17 --------------------------------------------------------------------
@register("align_columns", "SELECT id_cliente, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in prep.EXPLAIN_COLUMNS["credit_risk"][:3])
    + ", round(CAST(atrasos_hist AS DOUBLE), 6) AS atrasos_hist, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in prep.EXPLAIN_COLUMNS["credit_risk"][4:])
    + f" FROM {CREDIT} c0")
def q_align_columns(t):
    """Credit table in explainer column order as doubles, absent -> 0."""
    return finish(prep.align_columns(credit_features_df(t), prep.EXPLAIN_COLUMNS["credit_risk"],
                                     keep=["id_cliente"]))


# --- P18 --------------------------------------------------------------------
def application_input(t):
    """Stand-in loan applications: one per case of fx_casos."""
    return t.fx_casos.select(
        F.col("case_key").alias("id_pedido"), F.col("income").alias("renda_mensal"),
        F.lit(0).alias("idade"), F.lit(None).cast("string").alias("cidade"),
        F.col("client_score").alias("score_bureau"),
        F.col("meses_inadimplencia_recente").alias("atrasos_historico"),
        (F.floor("amount").cast("double") / 10).alias("divida_total"),
        F.floor("amount").cast("double").alias("valor_solicitado"),
        F.col("lista_coaf").alias("possui_imovel"))


@register("application_row", """
SELECT case_key AS id_pedido, 0 AS id_cliente, round(GREATEST(income, 1.0), 6) AS renda_mensal, 35 AS idade,
  1 AS pessoas_residencia, 'MEDIO' AS escolaridade, 'SOLTEIRO' AS estado_civil, 'CLT' AS tipo_empregador,
  'Campinas' AS cidade, TIMESTAMP '2020-01-01 00:00:00' AS data_abertura,
  CASE WHEN client_score > 0 THEN client_score ELSE 600 END AS score_bureau,
  meses_inadimplencia_recente AS atrasos_hist, 0 AS consultas_ultimo_6m,
  round(CAST(floor(amount) AS DOUBLE) / 10, 6) AS total_dividas, round(CAST(floor(amount) AS DOUBLE), 6) AS total_financiado,
  round(CAST(floor(amount) AS DOUBLE) * 0.03, 6) AS valor_parcela, CAST(0 AS DOUBLE) AS saldo_medio_12m, CAST(0 AS DOUBLE) AS saldo_atual,
  0 AS numero_operacoes_credito, CASE WHEN lista_coaf THEN 1 ELSE 0 END AS possui_imovel, 0 AS possui_veiculo
FROM fx_casos""")
def q_application_row(t):
    """Loan application to a credit-frame row."""
    return finish(prep.application_row(application_input(t)))


# --- P19..P22, P32 ----------------------------------------------------------
@register("score_rules", """
WITH s AS (SELECT event_id, probabilidade, value_amt,
  CAST(trunc(LEAST(GREATEST(850 - 550 * probabilidade, 300), 850)) AS INTEGER) AS score
  FROM (SELECT p.*, e.value * 100 AS value_amt FROM fx_predicoes p JOIN events e USING (event_id)) x)
SELECT event_id, score,
  CASE WHEN probabilidade < 0.15 THEN 'A' WHEN probabilidade < 0.35 THEN 'B' WHEN probabilidade < 0.60 THEN 'C' ELSE 'D' END AS risk_band,
  CASE WHEN score >= 700 THEN 'LOW' WHEN score >= 500 THEN 'MEDIUM' ELSE 'HIGH' END AS nivel_risco,
  CASE WHEN score >= 700 THEN 'APROVADO' WHEN score >= 500 THEN 'REVISAO' ELSE 'REJEITADO' END AS decisao,
  CASE WHEN score >= 700 THEN 'BAIXO' WHEN score >= 500 THEN 'MEDIO' ELSE 'ALTO' END AS nivel_risco_grpc,
  CASE WHEN score >= 700 THEN 'APPROVED' WHEN score >= 400 THEN 'REVIEW' ELSE 'REJECTED' END AS decisao_gateway,
  CASE WHEN score < 400 THEN 0.0 ELSE round(value_amt * score / 1000.0, 6) END AS limite_sugerido,
  CASE WHEN probabilidade >= 0.5 THEN 1 ELSE 0 END AS classe
FROM s""")
def q_score_rules(t):
    """P19 to_score, P20 risk_band, P21 policy_decision (3 profiles),
    P22 suggested_limit, P32 classify over prediction rows."""
    p = t.fx_predicoes.join(t.events.select("event_id", (F.col("value") * 100).alias("value_amt")),
                            "event_id")
    s = p.withColumn("score", sc.to_score("probabilidade"))
    return s.select(
        "event_id", "score", sc.risk_band("probabilidade").alias("risk_band"),
        sc.policy_decision("score", "rest")["nivel_risco"].alias("nivel_risco"),
        sc.policy_decision("score", "rest")["decisao"].alias("decisao"),
        sc.policy_decision("score", "grpc")["nivel_risco"].alias("nivel_risco_grpc"),
        sc.policy_decision("score", "gateway")["decisao"].alias("decisao_gateway"),
        F.round(sc.suggested_limit("value_amt", "score"), 6).alias("limite_sugerido"),
        sc.classify("probabilidade").alias("classe"))


# --- P23, P25, P27 ----------------------------------------------------------
@register("credit_factors", f"""
SELECT id_cliente,
  list_filter([CASE WHEN tempo_conta_meses >= 24 THEN '{sc.FACTOR_HISTORY}' END], lambda x: x IS NOT NULL) AS fatores_positivos,
  list_filter([CASE WHEN total_dividas / GREATEST(total_financiado, 1.0) > 0.8 THEN '{sc.FACTOR_UTILISATION}' END,
               CASE WHEN total_dividas / GREATEST(renda_mensal, 1.0) > 0.5 THEN '{sc.FACTOR_COMMITMENT}' END],
              lambda x: x IS NOT NULL) AS fatores_risco,
  CAST(trunc(LEAST(GREATEST(700 - total_dividas / 50.0, 300), 850)) AS INTEGER) AS score_fallback
FROM {CREDIT} c0""")
def q_credit_factors(t):
    """P23 credit factor texts and P27 no-model fallback score."""
    c = credit_features_df(t)
    util = F.col("total_dividas") / F.greatest(F.col("total_financiado"), F.lit(1.0))
    f = sc.credit_factors("tempo_conta_meses", util, "total_dividas", "renda_mensal")
    return c.select("id_cliente", f["fatores_positivos"].alias("fatores_positivos"),
                    f["fatores_risco"].alias("fatores_risco"),
                    sc.fallback_score("total_dividas").alias("score_fallback"))


@register("compliance_tags", f"""
SELECT case_key,
  list_filter([CASE WHEN amount > 10000 THEN '{sc.REG_COAF}' END,
               CASE WHEN operation_type = 'pix_suspicious' THEN '{sc.REG_BACEN}' END,
               '{sc.REG_LGPD}', '{sc.REG_CMN}'], lambda x: x IS NOT NULL) AS regulacoes,
  NOT (amount > 50000) AS conforme,
  CASE WHEN amount > 50000 THEN 'NAO_CONFORME' ELSE 'CONFORME' END AS status,
  CASE WHEN amount > 50000 THEN 'HIGH' ELSE 'LOW' END AS nivel_risco
FROM fx_casos""")
def q_compliance_tags(t):
    """P25: regulation list and conformity by amount and country (stand-in:
    suspicious PIX cases are foreign)."""
    c = t.fx_casos.withColumn(
        "pais", F.when(F.col("operation_type") == "pix_suspicious", "US").otherwise("BR"))
    r = sc.compliance_tags("amount", "pais")
    return c.select("case_key", r["regulacoes"].alias("regulacoes"), r["conforme"].alias("conforme"),
                    r["status"].alias("status"), r["nivel_risco"].alias("nivel_risco"))


# --- P24 --------------------------------------------------------------------
@register("fraud_band", f"""
SELECT id,
  CASE WHEN score_risco >= 0.8 THEN 'CRITICO' WHEN score_risco >= 0.5 THEN 'ALTO' WHEN score_risco >= 0.2 THEN 'MEDIO' ELSE 'BAIXO' END AS nivel_risco,
  score_risco >= 0.8 AS bloquear,
  list_filter([CASE WHEN tempo_processamento_ms / 500.0 > 0.7 THEN '{sc.FLAG_ANOMALY}' END,
               CASE WHEN score_risco > 0.7 THEN '{sc.FLAG_KNOWN_PATTERN}' END], lambda x: x IS NOT NULL) AS sinalizadores,
  CASE WHEN score_risco >= 0.8 THEN 'BLOQUEAR' ELSE 'PERMITIR' END AS recomendacao
FROM fx_fraude""")
def q_fraud_band(t):
    """Fraud level, block flag, red flags, recommendation."""
    f = t.fx_fraude
    b = sc.fraud_band("score_risco", F.col("tempo_processamento_ms") / 500.0, "score_risco")
    return f.select("id", b["nivel_risco"].alias("nivel_risco"), b["bloquear"].alias("bloquear"),
                    b["sinalizadores"].alias("sinalizadores"),
                    b["recomendacao"].alias("recomendacao"))


# --- P26 --------------------------------------------------------------------
@register("rule_decision_fallback", """
SELECT case_key,
  CASE WHEN amount > 500000 THEN 'ESCALATE'
       WHEN (CASE WHEN COALESCE(client_score, 0) = 0 THEN 500 ELSE client_score END) < 300 THEN 'REJECT'
       WHEN (CASE WHEN COALESCE(client_score, 0) = 0 THEN 500 ELSE client_score END) < 500 THEN 'REVIEW'
       ELSE 'APPROVE' END AS decision
FROM fx_casos""")
def q_rule_decision_fallback(t):
    """Rule-based governance fallback."""
    return t.fx_casos.select("case_key",
                             sc.rule_decision_fallback("amount", "client_score").alias("decision"))


# --- P28 --------------------------------------------------------------------
@register("segment_name", """
SELECT id_cliente,
  CASE pessoas_residencia - 1 WHEN 0 THEN 'PREMIUM' WHEN 1 THEN 'REGULAR' WHEN 2 THEN 'RECENTE'
    WHEN 3 THEN 'RISCO' WHEN 4 THEN 'INATIVO' ELSE 'CLUSTER_' || CAST(pessoas_residencia - 1 AS VARCHAR) END AS segmento,
  'segment_' || CAST(pessoas_residencia - 1 AS VARCHAR) AS segmento_treino
FROM fx_clientes""")
def q_segment_name(t):
    """Cluster id to segment name (stand-in cluster ids)."""
    c = t.fx_clientes.withColumn("cluster", F.col("pessoas_residencia") - 1)
    return c.select("id_cliente", sc.segment_name("cluster").alias("segmento"),
                    sc.segment_name("cluster", training_side=True).alias("segmento_treino"))


# --- P29, P31 ---------------------------------------------------------------
@register("label_fraud_rule", """
WITH q AS (SELECT quantile_cont(valor, 0.99) AS p99 FROM fx_fraude)
SELECT id,
  CASE WHEN valor > (SELECT p99 FROM q) OR hour(data_transacao) < 6 OR hour(data_transacao) > 22
        OR isodow(data_transacao) - 1 >= 5 OR score_risco > 0.8 THEN 1 ELSE 0 END AS is_fraud,
  LEAST(GREATEST(CAST(trunc(300 + 400 * (1 - score_risco)) AS INTEGER), 300), 850) AS score_credito
FROM fx_fraude""")
def q_label_fraud_rule(t):
    """P29 fraud label rule (exact global p99) and P31 legacy score target."""
    f = t.fx_fraude
    fit = prep.fit_fraud(f)
    return f.select("id", sc.label_fraud_rule(
        "valor", F.lit(fit.p99), F.hour("data_transacao"), F.weekday("data_transacao"),
        "score_risco").alias("is_fraud"),
        sc.legacy_score_target("score_risco").alias("score_credito"))


__all__ = ["AS_OF_FRAUDE"]
