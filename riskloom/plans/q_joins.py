"""Registered queries: as-of join (J3), online view (S6), latest version (W7),
SQL functions (U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sql_functions import register_functions
from ..operators.joins import latest_per_entity, point_in_time
from ..operators.windows import latest_version
from .catalog import finish, register

TTL_1D = 86400


@register("point_in_time", """
SELECT e.linha, e.id_cliente, e.event_timestamp,
  CASE WHEN v.event_timestamp IS NOT NULL AND e.event_timestamp - v.event_timestamp <= INTERVAL 1 DAY
       THEN round(v.atributo, 6) END AS atributo,
  CASE WHEN v.event_timestamp IS NOT NULL AND e.event_timestamp - v.event_timestamp <= INTERVAL 1 DAY
       THEN v.event_timestamp END AS feature_timestamp
FROM fx_entidades e ASOF LEFT JOIN fx_visao v
  ON e.id_cliente = v.id_cliente AND e.event_timestamp >= v.event_timestamp""")
def q_point_in_time(t):
    """Newest view row at or before each entity row, TTL 1 day."""
    return finish(point_in_time(t.fx_entidades, t.fx_visao, "id_cliente", "event_timestamp",
                                "event_timestamp", ["atributo"], ttl_seconds=TTL_1D))


@register("point_in_time_no_ttl", """
SELECT e.linha, e.id_cliente, e.event_timestamp, round(v.atributo, 6) AS atributo,
       v.event_timestamp AS feature_timestamp
FROM fx_entidades e ASOF LEFT JOIN fx_visao v
  ON e.id_cliente = v.id_cliente AND e.event_timestamp >= v.event_timestamp""")
def q_point_in_time_no_ttl(t):
    """J3 without TTL: carry-forward over day buckets for older features."""
    return finish(point_in_time(t.fx_entidades, t.fx_visao, "id_cliente", "event_timestamp",
                                "event_timestamp", ["atributo"], ttl_seconds=None,
                                bucket_seconds=86400))


@register("latest_per_entity", """
SELECT id_cliente, arg_max(event_timestamp, event_timestamp) AS event_timestamp,
       round(arg_max(atributo, event_timestamp), 6) AS atributo
FROM fx_visao GROUP BY id_cliente""")
def q_latest_per_entity(t):
    """Online view, newest row per entity."""
    return finish(latest_per_entity(t.fx_visao, "id_cliente", "event_timestamp"))


@register("latest_version", """
SELECT modelo, arg_max(versao, (criado_em, versao)) AS versao, max(criado_em) AS criado_em
FROM (SELECT event_type AS modelo, '1.' || CAST(event_id % 10 AS VARCHAR) AS versao, ts AS criado_em
      FROM events) v GROUP BY modelo""")
def q_latest_version(t):
    """Newest model version per model by creation time (stand-in
    version log from the events table)."""
    v = t.events.select(F.col("event_type").alias("modelo"),
                        F.concat(F.lit("1."), (F.col("event_id") % 10).cast("string")).alias("versao"),
                        F.col("ts").alias("criado_em"))
    return latest_version(v)


@register("sql_functions", """
SELECT event_id,
  CASE WHEN probabilidade IS NULL THEN NULL ELSE CAST(trunc(LEAST(GREATEST(850 - 550 * probabilidade, 300), 850)) AS INTEGER) END AS score,
  CASE WHEN probabilidade < 0.15 THEN 'A' WHEN probabilidade < 0.35 THEN 'B' WHEN probabilidade < 0.60 THEN 'C' ELSE 'D' END AS banda,
  CASE WHEN probabilidade >= 0.8 THEN 'CRITICO' WHEN probabilidade >= 0.5 THEN 'ALTO' WHEN probabilidade >= 0.2 THEN 'MEDIO' ELSE 'BAIXO' END AS fraude
FROM fx_predicoes""")
def q_sql_functions(t):
    """The scoring rules called from SQL as inlined SQL functions."""
    register_functions(t.spark)
    return t.fx_predicoes.selectExpr("event_id", "rl_to_score(probabilidade) AS score",
                                     "rl_risk_band(probabilidade) AS banda",
                                     "rl_fraud_band(probabilidade) AS fraude")
