"""Model-input preparation (P2-P18): pure column projections.

Fitted constants of the fraud preparation (p95, modes, max, label codes) are
computed once by :func:`fit_fraud` with distributed aggregates and reused by
:func:`prepare_fraud` (trap T8); a global statistic never pulls data to the
driver, only its one-row result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import clip, col, nan_to_null, safe_div, ts_lit, whole_days_between
from ..session import scratch_table
from .ordered import apply_codes, code_dictionary, exact_quantiles
from .windows import account_mean, trailing_counts

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (feature orders, maps, lists).
# ---------------------------------------------------------------------------
SCHOOLING_LEVELS = {"FUNDAMENTAL": 1, "MEDIO": 2, "SUPERIOR": 3,
                    "POS_GRADUACAO": 4, "MESTRADO": 5, "DOUTORADO": 6}
CAPITALS_V2 = ["Sao Paulo", "Rio de Janeiro", "Belo Horizonte", "Salvador",
               "Brasilia", "Campinas", "Porto Alegre", "Fortaleza", "Curitiba"]
CAPITALS_V1 = ["São Paulo", "Rio de Janeiro", "Belo Horizonte", "Salvador", "Brasília"]
HIGH_INCOME_PROFESSIONS = ["MEDICO", "ENGENHEIRO", "ADVOGADO", "DENTISTA", "ARQUITETO"]

V2_BASE = ["renda_mensal", "idade", "score_bureau", "saldo_medio_12m", "saldo_atual",
           "total_dividas", "total_financiado", "valor_parcela", "numero_operacoes_credito",
           "atrasos_hist", "consultas_ultimo_6m", "tempo_conta_meses", "pessoas_residencia",
           "possui_imovel", "possui_veiculo"]
V2_DERIVED = ["renda_log", "renda_per_capita", "idade_squared", "saldo_renda_ratio",
              "comprometimento_renda", "parcela_renda_ratio", "transacao_frequency",
              "risk_score", "saldo_ratio", "escolaridade_numeric", "is_married", "is_clt",
              "is_pj", "is_servidor", "is_capital"]
V2_FEATURES = V2_BASE + V2_DERIVED
V1_FEATURES = ["renda_mensal", "renda_log", "renda_per_capita", "idade", "idade_squared",
               "escolaridade_numeric", "is_married", "tempo_conta_meses", "saldo_medio_12m",
               "saldo_renda_ratio", "comprometimento_renda", "score_bureau",
               "numero_operacoes_credito", "total_financiado", "valor_parcela",
               "parcela_renda_ratio", "atrasos_hist", "consultas_ultimo_6m", "is_clt", "is_pj",
               "is_servidor", "possui_imovel", "possui_veiculo", "is_capital"]
LEGACY_FEATURES = ["renda_mensal", "renda_log", "renda_per_capita", "idade", "idade_squared",
                   "is_young", "is_middle_age", "is_senior", "escolaridade_numeric",
                   "is_married", "is_single", "is_capital", "is_high_income_profession",
                   "tempo_conta_meses", "saldo_renda_ratio", "transacoes_mes",
                   "valor_medio_transacao", "pessoas_residencia"]
FRAUD_NUMERIC = ["valor", "valor_log", "valor_sqrt", "hour", "day_of_week", "day_of_month",
                 "month", "is_high_value", "is_round_value", "is_same_city", "is_same_state",
                 "is_mobile", "is_web", "is_atm", "is_business_hours", "is_night",
                 "is_weekend", "is_iphone", "is_android", "is_samsung", "ip_first_octet",
                 "ip_second_octet", "is_chrome", "is_firefox", "is_safari",
                 "score_risco_normalized", "transactions_last_hour", "transactions_last_day",
                 "transaction_value_ratio"]
FRAUD_CATEGORICAL = ["tipo_transacao", "status", "cidade", "estado"]
DEFAULT_FEATURES = ["dias_atraso_medio", "valor_pendente_renda", "num_operacoes_12m",
                    "pct_pagamentos_atraso", "limite_utilizado", "tempo_relacionamento_meses",
                    "idade", "renda_log"]
SEGMENT_FEATURES = ["renda_log", "transacoes_mes", "valor_medio", "saldo_renda", "idade_norm"]
EXPLAIN_COLUMNS = {
    "credit_risk": ["renda_mensal", "idade", "score_bureau", "atrasos_hist", "total_dividas",
                    "total_financiado", "valor_parcela", "saldo_medio_12m", "saldo_atual",
                    "numero_operacoes_credito", "possui_imovel", "possui_veiculo",
                    "pessoas_residencia"],
    "fraud_detection": ["valor", "hora", "dia_semana", "is_fim_de_semana",
                        "is_horario_comercial", "transacoes_ultima_hora", "valor_acumulado_1h",
                        "distancia_ultima_transacao_km", "qtd_dispositivos_30d",
                        "is_novo_dispositivo"],
    "customer_segmentation": ["idade", "tempo_como_cliente_dias", "qtd_contas", "saldo_total",
                              "volume_mensal_transacoes", "frequencia_transacoes_semanal",
                              "tem_emprestimo", "tem_cartao", "tem_investimento",
                              "risco_score"],
}
REQUEST_DEFAULTS = {
    # profile "rest": request values replace defaults, nulls included
    "rest": {"id_cliente": 0, "renda_mensal": 3000.0, "idade": 35, "pessoas_residencia": 1,
             "escolaridade": "MEDIO", "estado_civil": "SOLTEIRO", "tipo_empregador": "CLT",
             "cidade": "Campinas", "data_abertura": "2020-01-01", "score_bureau": 600,
             "atrasos_hist": 0, "consultas_ultimo_6m": 0, "total_dividas": 0.0,
             "total_financiado": 0.0, "valor_parcela": 0.0, "saldo_medio_12m": 0.0,
             "saldo_atual": 0.0, "numero_operacoes_credito": 0, "possui_imovel": 0,
             "possui_veiculo": 0},
    # profile "scoring": null / NaN request values keep the default
    "scoring": {"id_cliente": 0, "renda_mensal": 5000.0, "idade": 35, "pessoas_residencia": 2,
                "escolaridade": "SUPERIOR", "estado_civil": "SOLTEIRO",
                "tipo_empregador": "CLT", "cidade": "Sao Paulo", "data_abertura": "2020-01-01",
                "tempo_conta_meses": 60.0, "score_bureau": 600, "atrasos_hist": 0,
                "consultas_ultimo_6m": 0, "total_dividas": 0.0, "total_financiado": 0.0,
                "valor_parcela": 0.0, "saldo_medio_12m": 10000.0, "saldo_atual": 12000.0,
                "numero_operacoes_credito": 3, "possui_imovel": 0, "possui_veiculo": 0},
}


def _flag(cond: Column) -> Column:
    """pandas ``(cond).astype(int)``: null comparisons count as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def _schooling(c) -> Column:
    m = F.create_map(*[x for k, v in SCHOOLING_LEVELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col(c)], F.lit(0))


def _fill_zero(exprs: dict[str, Column], order: list[str], keep: list[str]) -> list[Column]:
    out = [F.col(k) for k in keep]
    for name in order:
        e = exprs[name]
        out.append(F.coalesce(nan_to_null(e.cast("double")), F.lit(0.0)).alias(name))
    return out


def _get(df: DataFrame, name: str, default=0) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


# --- P2 ---------------------------------------------------------------------
def prepare_credit_v2(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """15 base + 15 derived features in fixed order; absent -> 0, null -> 0."""
    g = lambda n: _get(df, n)
    renda = g("renda_mensal")
    e = {n: g(n) for n in V2_BASE}
    compr = safe_div(g("total_dividas"), renda + 1)
    months = F.greatest(F.coalesce(g("tempo_conta_meses").cast("double"), F.lit(1.0)), F.lit(1.0))
    e.update({
        "renda_log": F.log1p(F.coalesce(renda.cast("double"), F.lit(0.0))),
        "renda_per_capita": safe_div(renda, g("pessoas_residencia") + 1),
        "idade_squared": g("idade") * g("idade"),
        "saldo_renda_ratio": safe_div(g("saldo_atual"), renda + 1),
        "comprometimento_renda": compr,
        "parcela_renda_ratio": safe_div(g("valor_parcela"), renda + 1),
        "saldo_ratio": safe_div(g("saldo_atual"), g("saldo_medio_12m") + 1),
        "transacao_frequency": safe_div(g("numero_operacoes_credito").cast("double"), months),
        "risk_score": (1 - clip(g("score_bureau"), 0, 1000) / 1000.0) * 0.4
        + clip(g("atrasos_hist"), 0, 30) / 30.0 * 0.3 + clip(compr, 0, 5) / 5.0 * 0.3,
        "escolaridade_numeric": _schooling(g("escolaridade")) if "escolaridade" in df.columns
        else F.lit(0),
        "is_married": _flag(g("estado_civil") == "CASADO") if "estado_civil" in df.columns
        else F.lit(0),
        "is_clt": _flag(g("tipo_empregador") == "CLT") if "tipo_empregador" in df.columns
        else F.lit(0),
        "is_pj": _flag(g("tipo_empregador") == "PJ") if "tipo_empregador" in df.columns
        else F.lit(0),
        "is_servidor": _flag(g("tipo_empregador") == "SERV_PUBLICO")
        if "tipo_empregador" in df.columns else F.lit(0),
        "is_capital": _flag(g("cidade").isin(CAPITALS_V2)) if "cidade" in df.columns
        else F.lit(0),
    })
    return df.select(*_fill_zero(e, V2_FEATURES, keep or []))


# --- P3 ---------------------------------------------------------------------
def prepare_credit_v1(df: DataFrame, as_of: str, keep: list[str] | None = None) -> DataFrame:
    """24 features; account age recomputed from data_abertura at ``as_of``."""
    renda = F.col("renda_mensal")
    e = {n: F.col(n) for n in V1_FEATURES if n in df.columns}
    e.update({
        "renda_log": F.log1p(F.coalesce(renda.cast("double"), F.lit(0.0))),
        "renda_per_capita": safe_div(renda, F.col("pessoas_residencia") + 1),
        "idade_squared": F.col("idade") * F.col("idade"),
        "escolaridade_numeric": _schooling("escolaridade"),
        "is_married": _flag(F.col("estado_civil") == "CASADO"),
        "tempo_conta_meses": whole_days_between("data_abertura", ts_lit(as_of)) / 30.0,
        "saldo_renda_ratio": safe_div(F.col("saldo_atual"), renda + 1),
        "comprometimento_renda": safe_div(F.col("total_dividas"), renda + 1),
        "parcela_renda_ratio": safe_div(F.col("valor_parcela"), renda + 1),
        "is_clt": _flag(F.col("tipo_empregador") == "CLT"),
        "is_pj": _flag(F.col("tipo_empregador") == "PJ"),
        "is_servidor": _flag(F.col("tipo_empregador") == "SERV_PUBLICO"),
        "is_capital": _flag(F.col("cidade").isin(CAPITALS_V1)),
    })
    return df.select(*_fill_zero(e, V1_FEATURES, keep or []))


# --- P4 ---------------------------------------------------------------------
def prepare_credit_legacy(df: DataFrame, as_of: str, keep: list[str] | None = None) -> DataFrame:
    """18 features of the legacy score model (age bands, profession list)."""
    renda = F.col("renda_mensal")
    idade = F.col("idade")
    e = {n: F.col(n) for n in ("renda_mensal", "idade", "pessoas_residencia")}
    e.update({
        "renda_log": F.log1p(renda.cast("double")),
        "renda_per_capita": safe_div(renda, F.col("pessoas_residencia") + 1),
        "idade_squared": idade * idade,
        "is_young": _flag(idade < 30),
        "is_middle_age": _flag((idade >= 30) & (idade <= 50)),
        "is_senior": _flag(idade > 50),
        "escolaridade_numeric": _schooling("escolaridade"),
        "is_married": _flag(F.col("estado_civil") == "CASADO"),
        "is_single": _flag(F.col("estado_civil") == "SOLTEIRO"),
        "is_capital": _flag(F.col("cidade").isin(CAPITALS_V1)),
        "is_high_income_profession": _flag(F.col("profissao").isin(HIGH_INCOME_PROFESSIONS)),
        "tempo_conta_meses": whole_days_between("data_abertura", ts_lit(as_of)) / 30.0,
        "saldo_renda_ratio": safe_div(F.col("saldo_atual"), renda + 1),
        "transacoes_mes": F.col("transacoes_ultimo_mes"),
        "valor_medio_transacao": safe_div(F.col("valor_total_transacoes"),
                                          F.col("transacoes_ultimo_mes") + 1),
    })
    return df.select(*_fill_zero(e, LEGACY_FEATURES, keep or []))


# --- P5..P13 ----------------------------------------------------------------
@dataclass(frozen=True)
class FraudFit:
    """Constants fitted on the training frame and reused when scoring."""
    p95: float
    p99: float
    city_mode: str | None
    state_mode: str | None
    max_risk: float
    codes: DataFrame | None = None  # (column, value, code) of the training rows


def global_mode(df: DataFrame, c: str):
    """Most frequent non-null value, smallest on ties (pandas ``mode()[0]``).
    Distributed: count per value, then two global aggregates over the counts."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).count()
    top = counts.agg(F.max("count").alias("m"))
    return (counts.join(top, counts["count"] == top["m"])
            .agg(F.min(c).alias("mode")))


def global_modes(df: DataFrame, cols: list[str]) -> dict:
    """Modes of several columns from one counting pass (unpivot, count per
    value, then max count and smallest value at that count per column)."""
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "_col", "_v").filter(F.col("_v").isNotNull()))
    counts = long.groupBy("_col", "_v").count()
    top = counts.groupBy("_col").agg(F.max("count").alias("m"))
    res = (counts.join(F.broadcast(top), "_col").filter(F.col("count") == F.col("m"))
           .groupBy("_col").agg(F.min("_v").alias("mode")).collect())
    return {r["_col"]: r["mode"] for r in res}


def fit_fraud(df: DataFrame) -> FraudFit:
    """Fit p95/p99 of valor (exact, linear interpolation), modal city/state,
    max score_risco and the label-code dictionary of the categorical columns.
    Only one-row results reach the driver; the dictionary is a stored table."""
    q = {r["prob"]: r["quantile"] for r in
         exact_quantiles(df, "valor", [0.95, 0.99]).collect()}
    modes = global_modes(df, ["cidade", "estado"])
    city, state = modes.get("cidade"), modes.get("estado")
    mx = df.agg(F.max("score_risco").alias("m")).first()["m"]
    cats = [c for c in FRAUD_CATEGORICAL if c in df.columns]
    codes = scratch_table(code_dictionary(_text_categories(df, cats), cats), "codes")
    return FraudFit(p95=q[0.95], p99=q[0.99], city_mode=city, state_mode=state, max_risk=mx,
                    codes=codes)


def _text_categories(df: DataFrame, cats: list[str]) -> DataFrame:
    """The label-coded columns as text, null as the word None."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cats})


def time_parts(ts) -> dict[str, Column]:
    """Hour, weekday (Monday=0), day of month, month and hour flags."""
    t = col(ts)
    h = F.hour(t)
    return {"hour": h, "day_of_week": F.weekday(t), "day_of_month": F.dayofmonth(t),
            "month": F.month(t),
            "is_business_hours": _flag((h >= 9) & (h <= 18)),
            "is_night": _flag((h >= 22) | (h <= 6)),
            "is_weekend": _flag(F.weekday(t) >= 5)}


def ip_octet(ip, i: int) -> Column:
    """I-th dotted part as double; malformed text -> null (then 0)."""
    return F.try_element_at(F.split(col(ip), r"\."), F.lit(i + 1)).try_cast("double")


def prepare_fraud(df: DataFrame, fit: FraudFit | None = None, keep: list[str] | None = None,
                  id_col: str = "id", account_col: str = "conta_id",
                  ts_col: str = "data_transacao") -> DataFrame:
    """P5 umbrella: 29 numeric + 4 label-coded columns, null -> 0.
    ``transactions_last_hour/day`` are real trailing counts (W2), not random.
    Codes, modes and quantiles are those of ``fit``, so a batch is encoded as
    the training rows were; a category the fit has not seen is -1."""
    fit = fit or fit_fraud(df)
    keep = keep or [id_col]
    base = account_mean(df, account_col, "valor", "avg_transaction_value")
    base = trailing_counts(base, account_col, ts_col, id_col)
    cats = [c for c in FRAUD_CATEGORICAL if c in base.columns]
    if cats:
        base = apply_codes(_text_categories(base, cats), fit.codes, cats)
    v = F.col("valor")
    e = dict(time_parts(ts_col))
    e.update({
        "valor": v, "valor_log": F.log1p(v), "valor_sqrt": F.sqrt(v),
        "is_high_value": _flag(v > F.lit(fit.p95)),
        "is_round_value": _flag(F.try_mod(v, F.lit(1000)) == 0),
        "is_same_city": _flag(F.col("cidade") == F.lit(fit.city_mode)),
        "is_same_state": _flag(F.col("estado") == F.lit(fit.state_mode)),
        "is_mobile": _flag(F.col("canal") == "MOBILE"),
        "is_web": _flag(F.col("canal") == "WEB"),
        "is_atm": _flag(F.col("canal") == "ATM"),
        "is_iphone": _flag(F.col("dispositivo").contains("iPhone")),
        "is_android": _flag(F.col("dispositivo").contains("Android")),
        "is_samsung": _flag(F.col("dispositivo").contains("Samsung")),
        "ip_first_octet": ip_octet("ip_address", 0),
        "ip_second_octet": ip_octet("ip_address", 1),
        "is_chrome": _flag(F.col("user_agent").contains("Chrome")),
        "is_firefox": _flag(F.col("user_agent").contains("Firefox")),
        "is_safari": _flag(F.col("user_agent").contains("Safari")),
        "score_risco_normalized": safe_div(F.col("score_risco"), F.lit(fit.max_risk)),
        "transactions_last_hour": F.col("transactions_last_hour"),
        "transactions_last_day": F.col("transactions_last_day"),
        "transaction_value_ratio": safe_div(v, F.col("avg_transaction_value")),
    })
    order = list(FRAUD_NUMERIC)
    for c in FRAUD_CATEGORICAL:
        if f"{c}_encoded" in base.columns:
            e[f"{c}_encoded"] = F.col(f"{c}_encoded")
            order.append(f"{c}_encoded")
    return base.select(*_fill_zero(e, order, keep))


# --- P14 --------------------------------------------------------------------
def prepare_default(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """8 default-model features.  Absent inputs raise (the reference fills
    them with random numbers; see SURVEY Q9)."""
    need = ["dias_atraso_medio", "valor_pendente", "renda_mensal", "num_operacoes_12m",
            "pct_pagamentos_atraso", "limite_utilizado", "tempo_relacionamento_meses", "idade"]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"prepare_default: missing columns {missing}")
    e = {n: F.col(n) for n in DEFAULT_FEATURES if n in df.columns}
    e["valor_pendente_renda"] = safe_div(F.col("valor_pendente"), F.col("renda_mensal") + 1)
    e["renda_log"] = F.log1p(F.col("renda_mensal"))
    return df.select(*_fill_zero(e, DEFAULT_FEATURES, keep or []))


# --- P15 --------------------------------------------------------------------
def prepare_segmentation(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """5 segmentation features; absent inputs take the reference defaults."""
    renda = _get(df, "renda_mensal", 5000)
    tx = _get(df, "transacoes_ultimo_mes", 0)
    e = {
        "renda_log": F.log1p(renda.cast("double")),
        "transacoes_mes": tx,
        "valor_medio": safe_div(_get(df, "valor_total_transacoes", 0),
                                _get(df, "transacoes_ultimo_mes", 1) + 1),
        "saldo_renda": safe_div(_get(df, "saldo_atual", 0), _get(df, "renda_mensal", 1) + 1),
        "idade_norm": (_get(df, "idade", 40) - 20) / 50.0,
    }
    return df.select(*_fill_zero(e, SEGMENT_FEATURES, keep or []))


# --- P16 --------------------------------------------------------------------
def fill_defaults(df: DataFrame, profile: str = "scoring") -> DataFrame:
    """Request columns over a default row.  ``rest``: present columns win even
    when null; ``scoring``: null/NaN keeps the default.  Absent -> default."""
    defaults = REQUEST_DEFAULTS[profile]
    out = []
    for name, d in defaults.items():
        lit = F.lit(d).cast("timestamp_ntz") if name == "data_abertura" else F.lit(d)
        if name not in df.columns:
            out.append(lit.alias(name))
            continue
        c = F.col(name)
        if profile == "scoring":
            dt = dict(df.dtypes)[name]
            if dt in ("double", "float"):
                c = nan_to_null(c)
            c = F.coalesce(c, lit)
        out.append(c.alias(name))
    return df.select(*out)


# --- P17 --------------------------------------------------------------------
def align_columns(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Select in model order as doubles; absent columns are 0.0."""
    return df.select(*(keep or []), *[
        (F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in cols])


# --- P18 --------------------------------------------------------------------
def application_row(df: DataFrame) -> DataFrame:
    """Loan application -> credit frame (income >= 1, age/score defaults,
    instalment = 3 % of the requested amount)."""
    return df.select(
        F.col("id_pedido"),
        F.lit(0).alias("id_cliente"),
        F.greatest(F.col("renda_mensal").cast("double"), F.lit(1.0)).alias("renda_mensal"),
        F.when(F.col("idade") > 0, F.col("idade")).otherwise(35).alias("idade"),
        F.lit(1).alias("pessoas_residencia"),
        F.lit("MEDIO").alias("escolaridade"),
        F.lit("SOLTEIRO").alias("estado_civil"),
        F.lit("CLT").alias("tipo_empregador"),
        F.when(F.coalesce(F.col("cidade"), F.lit("")) != "", F.col("cidade"))
         .otherwise("Campinas").alias("cidade"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("data_abertura"),
        F.when(F.col("score_bureau") > 0, F.col("score_bureau")).otherwise(600)
         .alias("score_bureau"),
        F.col("atrasos_historico").cast("int").alias("atrasos_hist"),
        F.lit(0).alias("consultas_ultimo_6m"),
        F.col("divida_total").cast("double").alias("total_dividas"),
        F.col("valor_solicitado").cast("double").alias("total_financiado"),
        (F.col("valor_solicitado") * 0.03).alias("valor_parcela"),
        F.lit(0.0).alias("saldo_medio_12m"),
        F.lit(0.0).alias("saldo_atual"),
        F.lit(0).alias("numero_operacoes_credito"),
        F.when(F.col("possui_imovel"), 1).otherwise(0).alias("possui_imovel"),
        F.lit(0).alias("possui_veiculo"))
