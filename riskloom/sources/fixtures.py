"""Banking-shaped stand-in inputs built from the driver's tables.

The driver data has no banking tables, so FIXTURES.md section 2 defines views
over it.  This module gives them twice:

* ``fx_*`` functions build the Spark DataFrame (lazy, column-pruned, no
  cartesian product: the three candidate slots of ``fx_candidatos`` are an
  ``explode`` of a literal array, not a cross join);
* ``FIXTURE_SQL`` holds the same definitions as DuckDB text, used by the
  oracle side (:func:`with_fixtures` prepends the needed ones as CTEs).

These views only give rows in the schema the operators expect; no operator
result is computed here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Timestamps used as "now" by the fixture-based queries (FIXTURES.md).
AS_OF_TRANSACOES = "2001-11-05 00:00:00"
AS_OF_FRAUDE = "2024-01-31 00:00:00"


def fx_clientes(t) -> DataFrame:
    first_order = (t.orders.groupBy("o_custkey")
                   .agg(F.min("o_orderdate").alias("data_abertura")))
    c = t.customer.alias("c")
    n = t.nation.alias("n")
    return (c.join(n, F.col("n.n_nationkey") == F.col("c.c_nationkey"))
             .join(first_order.alias("o"), F.col("o.o_custkey") == F.col("c.c_custkey"), "left")
             .selectExpr(
                 "c.c_custkey AS id_cliente",
                 "CAST(1500 + (c.c_custkey % 97) * 125 AS DOUBLE) AS renda_mensal",
                 "CAST(18 + c.c_custkey % 62 AS INT) AS idade",
                 "CAST(1 + c.c_custkey % 6 AS INT) AS pessoas_residencia",
                 "CASE c.c_custkey % 7 WHEN 0 THEN 'FUNDAMENTAL' WHEN 1 THEN 'MEDIO' "
                 "WHEN 2 THEN 'SUPERIOR' WHEN 3 THEN 'POS_GRADUACAO' WHEN 4 THEN 'MESTRADO' "
                 "WHEN 5 THEN 'DOUTORADO' END AS escolaridade",
                 "CASE c.c_custkey % 4 WHEN 0 THEN 'SOLTEIRO' WHEN 1 THEN 'CASADO' "
                 "WHEN 2 THEN 'DIVORCIADO' ELSE 'VIUVO' END AS estado_civil",
                 "CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'CLT' WHEN 'BUILDING' THEN 'PJ' "
                 "WHEN 'FURNITURE' THEN 'SERV_PUBLICO' WHEN 'HOUSEHOLD' THEN 'DESEMPREGADO' "
                 "END AS tipo_empregador",
                 "CASE c.c_custkey % 6 WHEN 0 THEN 'Sao Paulo' WHEN 1 THEN 'Curitiba' "
                 "WHEN 2 THEN 'Recife' WHEN 3 THEN 'Salvador' ELSE n.n_name END AS cidade",
                 "o.data_abertura",
                 "CAST((c.c_custkey * 7919) % 1001 AS INT) AS score_bureau",
                 "CAST(c.c_custkey % 2 AS INT) AS possui_imovel",
                 "CAST(CASE WHEN c.c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS possui_veiculo",
             ))


def fx_contas(t) -> DataFrame:
    c = t.customer.select("c_custkey", "c_acctbal").alias("c")
    o = t.orders.select("o_custkey", "o_orderstatus", "o_totalprice").alias("o")
    # grouped by the key alone (the balance is one value per client), so the
    # joins on id_cliente downstream reuse this hash partitioning
    return (c.join(o, F.col("o.o_custkey") == F.col("c.c_custkey"))
             .groupBy("c.c_custkey")
             .agg(F.first("c.c_acctbal").alias("c_acctbal"),
                  F.expr("AVG(o.o_totalprice) / CAST(50 AS DOUBLE)").alias("saldo_medio_12m"),
                  F.expr("SUM(CASE WHEN o.o_orderstatus = 'O' THEN o.o_totalprice "
                         "ELSE CAST(0 AS DOUBLE) END) / CAST(100 AS DOUBLE)").alias("total_dividas"),
                  F.max("o.o_totalprice").alias("total_financiado"),
                  F.expr("MIN(o.o_totalprice) * CAST(0.03 AS DOUBLE)").alias("valor_parcela"),
                  F.count(F.lit(1)).alias("numero_operacoes_credito"))
             .selectExpr("c_custkey AS id_cliente", "c_acctbal AS saldo_atual",
                         "saldo_medio_12m", "total_dividas", "total_financiado",
                         "valor_parcela", "numero_operacoes_credito",
                         "(c_custkey % 10 <> 0) AS ativa"))


def fx_transacoes(t) -> DataFrame:
    l = t.lineitem.alias("l")
    o = t.orders.select("o_orderkey", "o_custkey").alias("o")
    return (l.join(o, F.col("o.o_orderkey") == F.col("l.l_orderkey"))
             .selectExpr(
                 "l.l_orderkey * 10 + l.l_linenumber AS id_transacao",
                 "o.o_custkey AS id_cliente",
                 "l.l_extendedprice AS valor",
                 "l.l_shipdate AS data_transacao",
                 "CASE l.l_returnflag WHEN 'A' THEN 'CREDITO' WHEN 'N' THEN 'DEBITO' "
                 "ELSE 'PIX' END AS tipo",
                 "(l.l_linestatus = 'F' AND l.l_quantity > 45) AS atrasado",
                 "(l.l_discount > 0.08) AS tipo_consulta"))


def fx_fraude(t) -> DataFrame:
    return t.events.selectExpr(
        "event_id AS id", "user_id AS conta_id", "value AS valor", "ts AS data_transacao",
        "CASE event_type WHEN 'purchase' THEN 'PIX' WHEN 'view' THEN 'TED' WHEN 'click' "
        "THEN 'DOC' WHEN 'signup' THEN 'SAQUE' ELSE 'DEPOSITO' END AS tipo_transacao",
        "CASE WHEN event_id % 20 = 0 THEN 'PENDENTE' WHEN event_id % 7 = 0 THEN 'REJEITADA' "
        "ELSE 'APROVADA' END AS status",
        "CASE WHEN event_id % 10 < 6 THEN 'MOBILE' WHEN event_id % 10 < 8 THEN 'WEB' "
        "WHEN event_id % 10 = 8 THEN 'ATM' ELSE 'AGENCIA' END AS canal",
        "CASE event_id % 5 WHEN 0 THEN 'iPhone 14' WHEN 1 THEN 'Samsung Galaxy' "
        "WHEN 2 THEN 'Chrome' WHEN 3 THEN 'Android 13' END AS dispositivo",
        "CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE '192.168.' || CAST(user_id % 255 AS STRING)"
        " || '.' || CAST(event_id % 255 AS STRING) END AS ip_address",
        "CASE event_id % 4 WHEN 0 THEN 'Mozilla/5.0 Chrome' WHEN 1 THEN 'Mozilla/5.0 Firefox' "
        "WHEN 2 THEN 'Mozilla/5.0 Safari' END AS user_agent",
        "CASE user_id % 5 WHEN 0 THEN 'Sao Paulo' WHEN 1 THEN 'Rio de Janeiro' "
        "WHEN 2 THEN 'Belo Horizonte' WHEN 3 THEN 'Salvador' ELSE 'Brasilia' END AS cidade",
        "CASE user_id % 5 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' WHEN 3 THEN 'BA' "
        "ELSE 'DF' END AS estado",
        "CAST((event_id * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score_risco",
        "CAST(50 + (event_id * 13) % 450 AS INT) AS tempo_processamento_ms")


def fx_predicoes(t) -> DataFrame:
    return t.events.selectExpr(
        "event_id", "user_id AS id_cliente", "ts AS momento",
        "LEAST(value / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)) AS probabilidade")


def fx_avaliacao(t) -> DataFrame:
    return t.labels.selectExpr(
        "doc_id", "quality AS y",
        "CAST((doc_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.7 AS DOUBLE)"
        " + quality * CAST(0.3 AS DOUBLE) AS y_prob")


def fx_casos(t) -> DataFrame:
    return t.orders.selectExpr(
        "'CASE-' || CAST(o_orderkey AS STRING) AS case_id", "o_orderkey AS case_key",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'pix_suspicious' ELSE 'credit_approval' END"
        " AS operation_type",
        "CASE o_orderkey % 4 WHEN 0 THEN o_totalprice / CAST(100 AS DOUBLE) WHEN 1 THEN "
        "o_totalprice / CAST(1000 AS DOUBLE) WHEN 2 THEN o_totalprice * CAST(1.5 AS DOUBLE) "
        "ELSE CAST(0 AS DOUBLE) END AS amount",
        "CAST((o_custkey * 7919) % 1001 AS INT) AS client_score",
        "CASE WHEN o_orderkey % 4 = 2 THEN CAST(2000000 AS DOUBLE) WHEN o_orderkey % 11 = 0 "
        "THEN CAST(0 AS DOUBLE) ELSE CAST(1500 + (o_custkey % 97) * 125 AS DOUBLE) END AS income",
        "CAST((o_orderkey * 31) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS risk_score",
        "CAST((o_orderkey * 17) % 8 AS INT) AS meses_inadimplencia_recente",
        "(o_orderkey % 53 = 0) AS lista_coaf",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'order ' || o_orderpriority END"
        " AS description")


_LONGO = ("um dois tres quatro cinco seis sete oito nove dez "
          "um dois tres quatro cinco seis sete oito nove dez")
_ARG = "um dois tres quatro cinco seis sete oito"


def answer_texts() -> list[str]:
    """The six answer shapes of the candidate view, by ``(key + idx) % 6``."""
    longo, arg = _LONGO, _ARG
    shapes = {
        0: ('{"decision":"APPROVE","rationale":"' + longo + '","pro_arguments":["' + arg
            + '","' + arg + '"],"con_arguments":["' + arg + '","' + arg + '"],"confidence":0.9}'),
        1: ('{"decision":"reject","rationale":"curta","pro_arguments":["renda boa"],'
            '"con_arguments":["nenhum"]}'),
        2: ('```json {"decision":"DEFER","rationale":"' + longo + '","pro_arguments":["' + arg
            + '","' + arg + '"],"con_arguments":["um dois tres quatro cinco",'
            '"um dois tres quatro cinco"],"confidence":0.5} ```'),
        3: ('{"decision":"ESCALATE","rationale":"' + longo + '","pro_arguments":["' + arg
            + '","' + arg + '",],"con_arguments":["' + arg + '","' + arg
            + '"],"confidence":0.7,}'),
        4: ('Resposta: {"decision":"APROVADO","rationale":"curta","pro_arguments":[],'
            '"con_arguments":[],"confidence":0.2} fim'),
    }
    return [*(shapes[k] for k in sorted(shapes)), "sem resposta"]


def _answers(t, n: int) -> DataFrame:
    """(case_key, case_id, idx, raw) with ``n`` answers per case."""
    texts = F.array(*[F.lit(x) for x in answer_texts()])
    raw = F.element_at(texts, ((F.col("case_key") + F.col("idx")) % 6 + 1).cast("int"))
    return (t.fx_casos.select("case_key", "case_id")
            .withColumn("idx", F.explode(F.array(*[F.lit(i) for i in range(n)])))
            .select("case_key", "case_id", "idx", raw.alias("raw")))


def fx_candidatos(t) -> DataFrame:
    return _answers(t, 3)


def fx_respostas(t) -> DataFrame:
    """Three first-round answers and two answers to retries per case."""
    return _answers(t, 5)


def fx_entidades(t) -> DataFrame:
    return (t.events.filter("event_type = 'purchase'")
            .selectExpr("event_id AS linha", "user_id AS id_cliente", "ts AS event_timestamp"))


def fx_visao(t) -> DataFrame:
    return (t.events.filter("event_type = 'view'")
            .selectExpr("user_id AS id_cliente", "ts AS event_timestamp", "value AS atributo"))


def fx_metricas(t) -> DataFrame:
    e = t.events.selectExpr("CAST(ts AS DATE) AS dia", "event_type", "value")
    return e.groupBy("dia").agg(
        F.count(F.lit(1)).alias("n_amostras"),
        F.expr("AVG(CASE WHEN event_type <> 'error' THEN CAST(1 AS DOUBLE) "
               "ELSE CAST(0 AS DOUBLE) END)").alias("auc_roc"),
        F.expr("AVG(value) / CAST(500 AS DOUBLE)").alias("precisao"),
        F.expr("AVG(CASE WHEN event_type IN ('view','click','purchase') THEN CAST(1 AS DOUBLE)"
               " ELSE CAST(0 AS DOUBLE) END)").alias("recall"),
        F.expr("MAX(value) / CAST(500 AS DOUBLE)").alias("f1"))


# ---------------------------------------------------------------------------
# DuckDB text of the same views (oracle side), from FIXTURES.md section 2.
# ---------------------------------------------------------------------------
FIXTURE_SQL = {
    "fx_clientes": """
SELECT c.c_custkey AS id_cliente,
       CAST(1500 + (c.c_custkey % 97) * 125 AS DOUBLE) AS renda_mensal,
       CAST(18 + c.c_custkey % 62 AS INT) AS idade,
       CAST(1 + c.c_custkey % 6 AS INT) AS pessoas_residencia,
       CASE c.c_custkey % 7 WHEN 0 THEN 'FUNDAMENTAL' WHEN 1 THEN 'MEDIO' WHEN 2 THEN 'SUPERIOR' WHEN 3 THEN 'POS_GRADUACAO' WHEN 4 THEN 'MESTRADO' WHEN 5 THEN 'DOUTORADO' END AS escolaridade,
       CASE c.c_custkey % 4 WHEN 0 THEN 'SOLTEIRO' WHEN 1 THEN 'CASADO' WHEN 2 THEN 'DIVORCIADO' ELSE 'VIUVO' END AS estado_civil,
       CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'CLT' WHEN 'BUILDING' THEN 'PJ' WHEN 'FURNITURE' THEN 'SERV_PUBLICO' WHEN 'HOUSEHOLD' THEN 'DESEMPREGADO' END AS tipo_empregador,
       CASE c.c_custkey % 6 WHEN 0 THEN 'Sao Paulo' WHEN 1 THEN 'Curitiba' WHEN 2 THEN 'Recife' WHEN 3 THEN 'Salvador' ELSE n.n_name END AS cidade,
       o.data_abertura,
       CAST((c.c_custkey * 7919) % 1001 AS INT) AS score_bureau,
       CAST(c.c_custkey % 2 AS INT) AS possui_imovel,
       CAST(CASE WHEN c.c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS possui_veiculo
FROM customer c
JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS data_abertura FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "fx_contas": """
SELECT c.c_custkey AS id_cliente, c.c_acctbal AS saldo_atual,
       AVG(o.o_totalprice) / CAST(50 AS DOUBLE) AS saldo_medio_12m,
       SUM(CASE WHEN o.o_orderstatus = 'O' THEN o.o_totalprice ELSE CAST(0 AS DOUBLE) END) / CAST(100 AS DOUBLE) AS total_dividas,
       MAX(o.o_totalprice) AS total_financiado,
       MIN(o.o_totalprice) * CAST(0.03 AS DOUBLE) AS valor_parcela,
       COUNT(*) AS numero_operacoes_credito,
       (c.c_custkey % 10 <> 0) AS ativa
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_acctbal""",
    "fx_transacoes": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS id_transacao, o.o_custkey AS id_cliente,
       l.l_extendedprice AS valor, l.l_shipdate AS data_transacao,
       CASE l.l_returnflag WHEN 'A' THEN 'CREDITO' WHEN 'N' THEN 'DEBITO' ELSE 'PIX' END AS tipo,
       (l.l_linestatus = 'F' AND l.l_quantity > 45) AS atrasado,
       (l.l_discount > 0.08) AS tipo_consulta
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "fx_fraude": """
SELECT event_id AS id, user_id AS conta_id, value AS valor, ts AS data_transacao,
       CASE event_type WHEN 'purchase' THEN 'PIX' WHEN 'view' THEN 'TED' WHEN 'click' THEN 'DOC' WHEN 'signup' THEN 'SAQUE' ELSE 'DEPOSITO' END AS tipo_transacao,
       CASE WHEN event_id % 20 = 0 THEN 'PENDENTE' WHEN event_id % 7 = 0 THEN 'REJEITADA' ELSE 'APROVADA' END AS status,
       CASE WHEN event_id % 10 < 6 THEN 'MOBILE' WHEN event_id % 10 < 8 THEN 'WEB' WHEN event_id % 10 = 8 THEN 'ATM' ELSE 'AGENCIA' END AS canal,
       CASE event_id % 5 WHEN 0 THEN 'iPhone 14' WHEN 1 THEN 'Samsung Galaxy' WHEN 2 THEN 'Chrome' WHEN 3 THEN 'Android 13' END AS dispositivo,
       CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE '192.168.' || CAST(user_id % 255 AS VARCHAR(10)) || '.' || CAST(event_id % 255 AS VARCHAR(10)) END AS ip_address,
       CASE event_id % 4 WHEN 0 THEN 'Mozilla/5.0 Chrome' WHEN 1 THEN 'Mozilla/5.0 Firefox' WHEN 2 THEN 'Mozilla/5.0 Safari' END AS user_agent,
       CASE user_id % 5 WHEN 0 THEN 'Sao Paulo' WHEN 1 THEN 'Rio de Janeiro' WHEN 2 THEN 'Belo Horizonte' WHEN 3 THEN 'Salvador' ELSE 'Brasilia' END AS cidade,
       CASE user_id % 5 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' WHEN 3 THEN 'BA' ELSE 'DF' END AS estado,
       CAST((event_id * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score_risco,
       CAST(50 + (event_id * 13) % 450 AS INT) AS tempo_processamento_ms
FROM events""",
    "fx_predicoes": """
SELECT event_id, user_id AS id_cliente, ts AS momento,
       LEAST(value / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)) AS probabilidade
FROM events""",
    "fx_avaliacao": """
SELECT doc_id, quality AS y,
       CAST((doc_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.7 AS DOUBLE) + quality * CAST(0.3 AS DOUBLE) AS y_prob
FROM labels""",
    "fx_casos": """
SELECT 'CASE-' || CAST(o.o_orderkey AS VARCHAR(20)) AS case_id, o.o_orderkey AS case_key,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'pix_suspicious' ELSE 'credit_approval' END AS operation_type,
       CASE o.o_orderkey % 4 WHEN 0 THEN o.o_totalprice / CAST(100 AS DOUBLE) WHEN 1 THEN o.o_totalprice / CAST(1000 AS DOUBLE) WHEN 2 THEN o.o_totalprice * CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS amount,
       CAST((o.o_custkey * 7919) % 1001 AS INT) AS client_score,
       CASE WHEN o.o_orderkey % 4 = 2 THEN CAST(2000000 AS DOUBLE) WHEN o.o_orderkey % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1500 + (o.o_custkey % 97) * 125 AS DOUBLE) END AS income,
       CAST((o.o_orderkey * 31) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS risk_score,
       CAST((o.o_orderkey * 17) % 8 AS INT) AS meses_inadimplencia_recente,
       (o.o_orderkey % 53 = 0) AS lista_coaf,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 'order ' || o.o_orderpriority END AS description
FROM orders o""",
    "fx_candidatos": """
SELECT c.case_key, c.case_id, i.idx,
       CASE (c.case_key + i.idx) % 6
         WHEN 0 THEN '{"decision":"APPROVE","rationale":"' || r.longo || '","pro_arguments":["' || r.arg || '","' || r.arg || '"],"con_arguments":["' || r.arg || '","' || r.arg || '"],"confidence":0.9}'
         WHEN 1 THEN '{"decision":"reject","rationale":"curta","pro_arguments":["renda boa"],"con_arguments":["nenhum"]}'
         WHEN 2 THEN '```json {"decision":"DEFER","rationale":"' || r.longo || '","pro_arguments":["' || r.arg || '","' || r.arg || '"],"con_arguments":["um dois tres quatro cinco","um dois tres quatro cinco"],"confidence":0.5} ```'
         WHEN 3 THEN '{"decision":"ESCALATE","rationale":"' || r.longo || '","pro_arguments":["' || r.arg || '","' || r.arg || '",],"con_arguments":["' || r.arg || '","' || r.arg || '"],"confidence":0.7,}'
         WHEN 4 THEN 'Resposta: {"decision":"APROVADO","rationale":"curta","pro_arguments":[],"con_arguments":[],"confidence":0.2} fim'
         ELSE 'sem resposta' END AS raw
FROM fx_casos c
CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2) i
CROSS JOIN (SELECT 'um dois tres quatro cinco seis sete oito nove dez um dois tres quatro cinco seis sete oito nove dez' AS longo, 'um dois tres quatro cinco seis sete oito' AS arg) r""",
    "fx_entidades": """
SELECT event_id AS linha, user_id AS id_cliente, ts AS event_timestamp FROM events WHERE event_type = 'purchase'""",
    "fx_visao": """
SELECT user_id AS id_cliente, ts AS event_timestamp, value AS atributo FROM events WHERE event_type = 'view'""",
    "fx_metricas": """
SELECT dia, COUNT(*) AS n_amostras,
       AVG(CASE WHEN event_type <> 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS auc_roc,
       AVG(value) / CAST(500 AS DOUBLE) AS precisao,
       AVG(CASE WHEN event_type IN ('view','click','purchase') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS recall,
       MAX(value) / CAST(500 AS DOUBLE) AS f1
FROM (SELECT CAST(ts AS DATE) AS dia, event_type, value FROM events) e GROUP BY dia""",
}

FIXTURE_SQL["fx_respostas"] = FIXTURE_SQL["fx_candidatos"].replace(
    "(SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2)",
    "(SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS idx)")

_FX_ORDER = list(FIXTURE_SQL)
_FX_DEPS = {"fx_candidatos": ["fx_casos"], "fx_respostas": ["fx_casos"]}


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every ``fx_*`` view it mentions."""
    names = set(re.findall(r"\bfx_[a-z]+\b", sql))
    for n in list(names):
        names.update(_FX_DEPS.get(n, []))
    used = [n for n in _FX_ORDER if n in names]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in used)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
