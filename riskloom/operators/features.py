"""Credit feature pipeline: filters F1/F2, joins J1/J2, rollup A1, derived
features P1 and account age P33.

Spark form of the whole chain is one lazy plan: both filters reach the parquet
scan, the rollup is one hash aggregation with map-side partial aggregation,
and the two joins are on ``id_cliente`` so the rollup's hash partitioning is
reused by the left join (AQE turns either into a broadcast when a side is
measured small at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import clip, safe_div, ts_lit, whole_days_between

ACCOUNT_CLIENT_COLUMNS = [
    "id_cliente", "renda_mensal", "idade", "escolaridade", "estado_civil",
    "tipo_empregador", "cidade", "data_abertura", "score_bureau",
    "pessoas_residencia", "possui_imovel", "possui_veiculo",
]
ACCOUNT_COLUMNS = [
    "saldo_atual", "saldo_medio_12m", "total_dividas", "total_financiado",
    "valor_parcela", "numero_operacoes_credito",
]


# --- F1 ---------------------------------------------------------------------
def active_accounts(contas: DataFrame) -> DataFrame:
    """Accounts flagged active (``ativa = true``)."""
    return contas.filter(F.col("ativa"))


# --- F2 ---------------------------------------------------------------------
def cutoff_date(as_of: str, days: int):
    """Midnight of the day ``days`` before ``as_of`` (the reference formats the
    cut-off as a date string)."""
    return F.date_trunc("day", ts_lit(as_of) - F.make_dt_interval(F.lit(days))).cast(
        "timestamp_ntz")


def recent_transactions(transacoes: DataFrame, as_of: str, days: int = 90,
                        ts_col: str = "data_transacao") -> DataFrame:
    """Transactions on or after midnight ``days`` before ``as_of``.  A plain
    comparison against a folded literal, so it is pushed into the scan and
    prunes date partitions when the table is partitioned by date."""
    return transacoes.filter(F.col(ts_col) >= cutoff_date(as_of, days))


# --- P33 --------------------------------------------------------------------
def account_months(open_col="data_abertura", as_of: str = None):
    """Whole elapsed days since opening divided by 30 (fractional months)."""
    return whole_days_between(open_col, ts_lit(as_of)).cast("double") / F.lit(30.0)


# --- J1 ---------------------------------------------------------------------
def accounts_features(clientes: DataFrame, contas: DataFrame, as_of: str) -> DataFrame:
    """Inner equi-join of clients and their active accounts plus account age."""
    acc = active_accounts(contas).select("id_cliente", *ACCOUNT_COLUMNS)
    return (clientes.select(*ACCOUNT_CLIENT_COLUMNS)
            .join(acc, "id_cliente", "inner")
            .withColumn("tempo_conta_meses", account_months("data_abertura", as_of)))


# --- A1 ---------------------------------------------------------------------
def transactions_rollup(transacoes: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Per-client transaction statistics over the last ``days`` days."""
    t = recent_transactions(transacoes, as_of, days)
    n_of = lambda kind: F.count(F.when(F.col("tipo") == kind, F.lit(1)))
    agg = t.groupBy("id_cliente").agg(
        F.count(F.lit(1)).alias(f"total_transacoes_{days}d"),
        F.avg("valor").alias("valor_medio_transacao"),
        F.sum("valor").alias("valor_total_transacoes"),
        n_of("CREDITO").alias("qtd_creditos"),
        n_of("DEBITO").alias("qtd_debitos"),
        n_of("PIX").alias("qtd_pix"),
        F.max("data_transacao").alias("data_ultima_transacao"),
        F.sum(F.when(F.col("atrasado"), F.lit(1)).otherwise(F.lit(0))).cast("long")
         .alias("atrasos_hist"),
        F.count_distinct(F.when(F.col("tipo_consulta"), F.col("data_transacao")))
         .alias("consultas_ultimo_6m"),
    )
    return agg.withColumn("dias_desde_ultima",
                          whole_days_between("data_ultima_transacao", ts_lit(as_of)))


# --- J2 ---------------------------------------------------------------------
def join_transactions(accounts: DataFrame, rollup: DataFrame | None) -> DataFrame:
    """Left join of the rollup; numeric rollup columns null -> 0.  Date columns
    stay null ("never" is not day 0).  An absent/empty-schema right side
    returns the left side unchanged."""
    if rollup is None or len(rollup.columns) <= 1:
        return accounts
    joined = accounts.join(rollup, "id_cliente", "left")
    numeric = [f.name for f in rollup.schema.fields
               if f.name != "id_cliente" and f.dataType.typeName() in
               ("long", "integer", "double", "float", "short", "decimal")]
    return joined.fillna(0, subset=numeric)


# --- P1 ---------------------------------------------------------------------
def derive_features(df: DataFrame) -> DataFrame:
    """saldo_ratio, transacao_frequency, comprometimento_renda,
    parcela_renda_ratio and the composite risk_score in [0, 1]."""
    cols = set(df.columns)
    months = (F.greatest(F.coalesce(F.col("tempo_conta_meses"), F.lit(1.0)), F.lit(1.0))
              if "tempo_conta_meses" in cols else F.lit(1.0))
    ops = F.col("numero_operacoes_credito") if "numero_operacoes_credito" in cols else F.lit(0)
    late = F.col("atrasos_hist") if "atrasos_hist" in cols else F.lit(0)
    compr = safe_div(F.col("total_dividas"), F.col("renda_mensal") + 1)
    out = df.withColumns({
        "saldo_ratio": safe_div(F.col("saldo_atual"), F.col("saldo_medio_12m") + 1),
        "transacao_frequency": safe_div(ops.cast("double"), months),
        "comprometimento_renda": compr,
        "parcela_renda_ratio": safe_div(F.col("valor_parcela"), F.col("renda_mensal") + 1),
    })
    return out.withColumn(
        "risk_score",
        (1 - clip("score_bureau", 0, 1000) / 1000.0) * 0.4
        + clip(late, 0, 30) / 30.0 * 0.3
        + clip("comprometimento_renda", 0, 5) / 5.0 * 0.3)


def credit_feature_table(clientes: DataFrame, contas: DataFrame, transacoes: DataFrame,
                         as_of: str, days: int = 90) -> DataFrame:
    """F1 -> J1, F2 -> A1 -> J2 -> P1 as a single plan (the feature job)."""
    acc = accounts_features(clientes, contas, as_of)
    roll = transactions_rollup(transacoes, as_of, days)
    return derive_features(join_transactions(acc, roll))
