"""Registered queries: feature pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..sources.fixtures import AS_OF_TRANSACOES as AS_OF
from .catalog import finish, register, rounded

DAYS = 90

_ACC_SQL = """
SELECT c.id_cliente, c.renda_mensal, c.idade, c.escolaridade, c.estado_civil, c.tipo_empregador,
       c.cidade, c.data_abertura, c.score_bureau, c.pessoas_residencia, c.possui_imovel,
       c.possui_veiculo, ct.saldo_atual, ct.saldo_medio_12m, ct.total_dividas,
       ct.total_financiado, ct.valor_parcela, ct.numero_operacoes_credito,
       CAST(floor((epoch(TIMESTAMP '2001-11-05 00:00:00') - epoch(c.data_abertura)) / 86400) AS DOUBLE) / 30.0
         AS tempo_conta_meses
FROM fx_clientes c JOIN fx_contas ct ON c.id_cliente = ct.id_cliente
WHERE ct.ativa"""

_ROLLUP_SQL = """
SELECT id_cliente,
       COUNT(*) AS total_transacoes_90d,
       AVG(valor) AS valor_medio_transacao,
       SUM(valor) AS valor_total_transacoes,
       COUNT(CASE WHEN tipo = 'CREDITO' THEN 1 END) AS qtd_creditos,
       COUNT(CASE WHEN tipo = 'DEBITO' THEN 1 END) AS qtd_debitos,
       COUNT(CASE WHEN tipo = 'PIX' THEN 1 END) AS qtd_pix,
       MAX(data_transacao) AS data_ultima_transacao,
       CAST(SUM(CASE WHEN atrasado THEN 1 ELSE 0 END) AS BIGINT) AS atrasos_hist,
       COUNT(DISTINCT CASE WHEN tipo_consulta THEN data_transacao END) AS consultas_ultimo_6m,
       CAST(floor((epoch(TIMESTAMP '2001-11-05 00:00:00') - epoch(MAX(data_transacao))) / 86400) AS BIGINT)
         AS dias_desde_ultima
FROM fx_transacoes
WHERE data_transacao >= TIMESTAMP '2001-08-07 00:00:00'
GROUP BY id_cliente"""

_JOINED_SQL = f"""
SELECT a.*,
       COALESCE(r.total_transacoes_90d, 0) AS total_transacoes_90d,
       COALESCE(r.valor_medio_transacao, 0) AS valor_medio_transacao,
       COALESCE(r.valor_total_transacoes, 0) AS valor_total_transacoes,
       COALESCE(r.qtd_creditos, 0) AS qtd_creditos,
       COALESCE(r.qtd_debitos, 0) AS qtd_debitos,
       COALESCE(r.qtd_pix, 0) AS qtd_pix,
       r.data_ultima_transacao,
       COALESCE(r.atrasos_hist, 0) AS atrasos_hist,
       COALESCE(r.consultas_ultimo_6m, 0) AS consultas_ultimo_6m,
       COALESCE(r.dias_desde_ultima, 0) AS dias_desde_ultima
FROM ({_ACC_SQL}) a LEFT JOIN ({_ROLLUP_SQL}) r ON a.id_cliente = r.id_cliente"""

_DERIVED_SQL = f"""
SELECT j.*,
       j.saldo_atual / (j.saldo_medio_12m + 1) AS saldo_ratio,
       CAST(j.numero_operacoes_credito AS DOUBLE) / GREATEST(COALESCE(j.tempo_conta_meses, 1.0), 1.0)
         AS transacao_frequency,
       j.total_dividas / (j.renda_mensal + 1) AS comprometimento_renda,
       j.valor_parcela / (j.renda_mensal + 1) AS parcela_renda_ratio,
       (1 - LEAST(GREATEST(j.score_bureau, 0), 1000) / 1000.0) * 0.4
         + LEAST(GREATEST(j.atrasos_hist, 0), 30) / 30.0 * 0.3
         + LEAST(GREATEST(j.total_dividas / (j.renda_mensal + 1), 0), 5) / 5.0 * 0.3 AS risk_score
FROM ({_JOINED_SQL}) j"""

_ACC_DOUBLES = ["renda_mensal", "saldo_atual", "saldo_medio_12m", "total_dividas",
                "total_financiado", "valor_parcela", "tempo_conta_meses"]
_ROLL_DOUBLES = ["valor_medio_transacao", "valor_total_transacoes"]
_DER_DOUBLES = ["saldo_ratio", "transacao_frequency", "comprometimento_renda",
                "parcela_renda_ratio", "risk_score"]
_MONEY = {"valor_total_transacoes": 4, "total_dividas": 4, "valor_medio_transacao": 4}


def credit_features_df(t):
    return fe.credit_feature_table(t.fx_clientes, t.fx_contas, t.fx_transacoes, AS_OF, DAYS)


@register("credit_features",
          rounded(_DERIVED_SQL, _ACC_DOUBLES + _ROLL_DOUBLES + _DER_DOUBLES, overrides=_MONEY))
def q_credit_features(t):
    """Flagship: F1 -> J1 (+P33), F2 -> A1 -> J2 -> P1 over the whole tables."""
    return finish(credit_features_df(t), overrides=_MONEY)


@register("read_table", "SELECT * FROM customer")
def q_read_table(t):
    """A core table by name from a table folder."""
    from ..sources import io
    return io.read_table(t.spark, "customer", t.sf_dir)


@register("active_accounts", rounded(
    "SELECT * FROM fx_contas WHERE ativa",
    ["saldo_atual", "saldo_medio_12m", "total_dividas", "total_financiado", "valor_parcela"],
    overrides=_MONEY))
def q_active_accounts(t):
    """accounts with ativa = true."""
    return finish(fe.active_accounts(t.fx_contas), overrides=_MONEY)


@register("recent_transactions", rounded(
    "SELECT * FROM fx_transacoes WHERE data_transacao >= TIMESTAMP '2001-08-07 00:00:00'",
    ["valor"]))
def q_recent_transactions(t):
    """transactions since midnight 90 days before as_of."""
    return finish(fe.recent_transactions(t.fx_transacoes, AS_OF, DAYS))


@register("accounts_features", rounded(_ACC_SQL, _ACC_DOUBLES, overrides=_MONEY))
def q_accounts_features(t):
    """J1 + P33: clients inner-joined to active accounts, account age in months."""
    return finish(fe.accounts_features(t.fx_clientes, t.fx_contas, AS_OF), overrides=_MONEY)


@register("account_months", """
SELECT id_cliente, CAST(floor((epoch(TIMESTAMP '2001-11-05 00:00:00') - epoch(data_abertura)) / 86400) AS BIGINT) AS dias,
       round(CAST(floor((epoch(TIMESTAMP '2001-11-05 00:00:00') - epoch(data_abertura)) / 86400) AS DOUBLE) / 30.0, 6) AS tempo_conta_meses
FROM fx_clientes""")
def q_account_months(t):
    """Whole elapsed days (24 h periods) / 30."""
    from ..functions.core import ts_lit, whole_days_between
    c = t.fx_clientes
    return finish(c.select(
        "id_cliente",
        whole_days_between("data_abertura", ts_lit(AS_OF)).alias("dias"),
        fe.account_months("data_abertura", AS_OF).alias("tempo_conta_meses")))


@register("transactions_rollup", rounded(_ROLLUP_SQL, _ROLL_DOUBLES, overrides=_MONEY))
def q_transactions_rollup(t):
    """A1: per-client 90-day transaction rollup."""
    return finish(fe.transactions_rollup(t.fx_transacoes, AS_OF, DAYS), overrides=_MONEY)


@register("join_transactions", rounded(_JOINED_SQL, _ACC_DOUBLES + _ROLL_DOUBLES,
                                       overrides=_MONEY))
def q_join_transactions(t):
    """Left join of the rollup onto accounts, numeric nulls -> 0."""
    acc = fe.accounts_features(t.fx_clientes, t.fx_contas, AS_OF)
    roll = fe.transactions_rollup(t.fx_transacoes, AS_OF, DAYS)
    return finish(fe.join_transactions(acc, roll), overrides=_MONEY)


@register("derive_features", rounded(
    f"SELECT id_cliente, saldo_ratio, transacao_frequency, comprometimento_renda, "
    f"parcela_renda_ratio, risk_score FROM ({_DERIVED_SQL}) d", _DER_DOUBLES))
def q_derive_features(t):
    """Derived credit features over the joined table."""
    return finish(credit_features_df(t).select(
        "id_cliente", "saldo_ratio", "transacao_frequency", "comprometimento_renda",
        "parcela_renda_ratio", "risk_score"))


__all__ = ["credit_features_df", "F"]
