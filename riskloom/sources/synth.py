"""Synthetic frames (S12-S15) for tests and demos.

Numpy random streams cannot be reproduced across engines, so every draw is
derived from ``xxhash64(id, seed, column)``: uniforms, then exponential,
Box-Muller normal, inverse-CDF Poisson, categorical by cumulative
probabilities.  Distributions match the reference generators, rows do not.
Generated with ``spark.range``: the work is spread over partitions and the
result does not depend on how many there are.

These generators feed tests only; no registered query runs on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _u(seed: int, salt: str) -> Column:
    h = F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt))
    return (F.pmod(h, F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)


def _exp(mean: float, seed: int, salt: str) -> Column:
    return -mean * F.log(1 - _u(seed, salt))


def _normal(mu: float, sd: float, seed: int, salt: str) -> Column:
    return mu + sd * F.sqrt(-2 * F.log(_u(seed, salt + ".a"))) * F.cos(2 * math.pi * _u(seed, salt + ".b"))


def _int(lo: int, hi: int, seed: int, salt: str) -> Column:
    """Integer in [lo, hi)."""
    return F.floor(lo + _u(seed, salt) * (hi - lo)).cast("int")


def _poisson(lam: Column, seed: int, salt: str, kmax: int = 60) -> Column:
    """Inverse-CDF Poisson draw."""
    u = _u(seed, salt)
    init = F.struct(F.exp(-lam).alias("t"), F.exp(-lam).alias("c"),
                    F.lit(0).alias("k"), (F.exp(-lam) >= u).alias("done"))
    acc = F.aggregate(F.sequence(F.lit(1), F.lit(kmax)), init, lambda s, j: F.when(
        s["done"], s).otherwise(F.struct(
            (s["t"] * lam / j).alias("t"), (s["c"] + s["t"] * lam / j).alias("c"), j.alias("k"),
            (s["c"] + s["t"] * lam / j >= u).alias("done"))))
    return acc["k"]


def _choice(values: list, probs: list | None, seed: int, salt: str) -> Column:
    u = _u(seed, salt)
    probs = probs or [1.0 / len(values)] * len(values)
    out = F.lit(values[-1])
    cum = 0.0
    thresholds = []
    for v, p in zip(values, probs):
        cum += p
        thresholds.append((cum, v))
    for c, v in reversed(thresholds[:-1]):
        out = F.when(u < c, F.lit(v)).otherwise(out)
    return out


def synth_credit(spark: SparkSession, n: int = 5000, seed: int = 42,
                 as_of: str = "2026-01-01 00:00:00") -> DataFrame:
    """Credit table with a learnable label from a latent credibility."""
    df = spark.range(1, n + 1)
    school = ["FUNDAMENTAL", "MEDIO", "SUPERIOR", "POS_GRADUACAO", "MESTRADO", "DOUTORADO"]
    cities = ["Sao Paulo", "Rio de Janeiro", "Belo Horizonte", "Salvador", "Brasilia", "Campinas",
              "Porto Alegre", "Fortaleza", "Curitiba"]
    df = df.select(
        F.col("id").alias("id_cliente"), "id",
        F.round(F.greatest(_exp(6000, seed, "renda"), F.lit(500.0)), 2).alias("renda_mensal"),
        _int(18, 80, seed, "idade").alias("idade"),
        _choice(school, [0.05, 0.30, 0.42, 0.13, 0.08, 0.02], seed, "esc").alias("escolaridade"),
        _choice(["SOLTEIRO", "CASADO", "DIVORCIADO", "VIUVO"], [0.4, 0.4, 0.15, 0.05], seed,
                "civil").alias("estado_civil"),
        _int(1, 7, seed, "pessoas").alias("pessoas_residencia"),
        _choice(["CLT", "PJ", "SERV_PUBLICO", "DESEMPREGADO"], [0.5, 0.25, 0.15, 0.1], seed,
                "emp").alias("tipo_empregador"),
        _choice(cities, None, seed, "cidade").alias("cidade"),
        F.date_add(F.lit("2020-01-01").cast("date"), _int(0, 2200, seed, "abertura"))
        .cast("timestamp_ntz").alias("data_abertura"),
        F.least(F.greatest(_normal(600, 90, seed, "score"), F.lit(0.0)), F.lit(1000.0))
        .cast("int").alias("score_bureau"))
    df = df.withColumn("tempo_conta_meses", F.floor(F.timestamp_diff(
        "SECOND", F.col("data_abertura"), F.lit(as_of).cast("timestamp_ntz")) / 86400) / 30.0)
    df = df.withColumns({
        "atrasos_hist": F.least(_poisson(F.greatest(2.0 - F.col("score_bureau") / 400.0, F.lit(0.1)),
                                         seed, "atrasos"), F.lit(30)),
        "consultas_ultimo_6m": F.least(_poisson(F.greatest(3.0 - F.col("score_bureau") / 350.0,
                                                           F.lit(0.1)), seed, "consultas"), F.lit(40)),
        "total_financiado": F.round(_exp(40000, seed, "financiado"), 2),
        "saldo_medio_12m": F.round(_exp(12000, seed, "saldo_medio"), 2),
        "numero_operacoes_credito": _int(0, 8, seed, "ops"),
        "possui_imovel": (_u(seed, "imovel") < 0.35 + F.col("score_bureau") / 2000.0).cast("int"),
        "possui_veiculo": (_u(seed, "veiculo") < 0.4 + F.col("score_bureau") / 3000.0).cast("int"),
    })
    df = df.withColumns({
        "total_dividas": F.round(_exp(18000, seed, "dividas") * (1 + F.col("atrasos_hist") / 20.0), 2),
        "valor_parcela": F.round(F.col("total_financiado") * (0.02 + 0.03 * _u(seed, "parcela")), 2),
        "saldo_atual": F.round(F.col("saldo_medio_12m") * (0.4 + 0.9 * _u(seed, "saldo")), 2),
    })
    esc = {"FUNDAMENTAL": -0.6, "MEDIO": 0.0, "SUPERIOR": 0.6, "POS_GRADUACAO": 1.2,
           "MESTRADO": 1.8, "DOUTORADO": 2.2}
    emp = {"CLT": 0.4, "PJ": 0.5, "SERV_PUBLICO": 1.0, "DESEMPREGADO": -1.5}
    m_esc = F.create_map(*[x for k, v in esc.items() for x in (F.lit(k), F.lit(v))])
    m_emp = F.create_map(*[x for k, v in emp.items() for x in (F.lit(k), F.lit(v))])
    cred = (F.col("score_bureau") / 180.0 - F.col("atrasos_hist") * 0.4
            - F.col("consultas_ultimo_6m") * 0.15
            - (F.col("total_dividas") / F.greatest(F.col("renda_mensal"), F.lit(1.0))) / 60.0
            + F.coalesce(m_esc[F.col("escolaridade")], F.lit(0.0))
            + F.coalesce(m_emp[F.col("tipo_empregador")], F.lit(0.0))
            + F.log1p("renda_mensal") / 8.0 + F.col("possui_imovel") * 0.35
            + F.col("possui_veiculo") * 0.25 - 2.3 + _normal(0, 0.8, seed, "ruido"))
    df = df.withColumn("inadimplente", (_u(seed, "label") < 1 / (1 + F.exp(cred))).cast("int"))
    return df.drop("id")


def synth_drift(spark: SparkSession, n: int = 5000, shift: float = 0.0, seed: int = 42) -> DataFrame:
    """Six numeric columns with an additive shift."""
    return spark.range(n).select(
        (_exp(6000, seed, "renda") + shift * 2000).alias("renda_mensal"),
        _int(18, 80, seed, "idade").alias("idade"),
        F.least(F.greatest(_normal(600, 90, seed, "score") + shift * 50, F.lit(0.0)), F.lit(1000.0))
        .alias("score_bureau"),
        (_exp(12000, seed, "saldo") + shift * 3000).alias("saldo_atual"),
        F.least(F.greatest(_poisson(F.lit(2.0), seed, "atrasos") + int(shift * 3), F.lit(0)), F.lit(30))
        .alias("atrasos_hist"),
        (_exp(18000, seed, "dividas") + shift * 5000).alias("total_dividas"))


def synth_default(spark: SparkSession, n: int = 2000, seed: int = 42) -> DataFrame:
    """Default-model table; label dias > 30 or pct > 0.25."""
    df = spark.range(n).select(
        F.col("id").alias("id_cliente"), "id",
        _exp(15, seed, "dias").alias("dias_atraso_medio"),
        _exp(2000, seed, "pendente").alias("valor_pendente"),
        _exp(6000, seed, "renda").alias("renda_mensal"),
        _poisson(F.lit(20.0), seed, "ops", kmax=80).alias("num_operacoes_12m"),
        (1 - F.pow(1 - _u(seed, "pct"), 1 / 5.0)).alias("pct_pagamentos_atraso"),
        _u(seed, "limite").alias("limite_utilizado"),
        _int(6, 120, seed, "tempo").alias("tempo_relacionamento_meses"),
        _int(22, 70, seed, "idade").alias("idade"))
    return df.withColumn("inadimplente", ((F.col("dias_atraso_medio") > 30)
                                          | (F.col("pct_pagamentos_atraso") > 0.25)).cast("int")).drop("id")


def synth_segmentation(spark: SparkSession, n: int = 2000, seed: int = 42) -> DataFrame:
    """Segmentation table."""
    return spark.range(n).select(
        F.col("id").alias("id_cliente"),
        _exp(5000, seed, "renda").alias("renda_mensal"),
        _poisson(F.lit(25.0), seed, "tx", kmax=90).alias("transacoes_ultimo_mes"),
        _exp(15000, seed, "valor").alias("valor_total_transacoes"),
        _exp(3000, seed, "saldo").alias("saldo_atual"),
        _int(22, 65, seed, "idade").alias("idade"))


def synth_transactions(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Fraud transactions, hourly from 2024-01-01."""
    return spark.range(1, n + 1).select(
        "id", _int(1, 100, seed, "conta").cast("long").alias("conta_id"),
        _choice(["PIX", "TED", "DOC", "SAQUE", "DEPOSITO"], None, seed, "tipo").alias("tipo_transacao"),
        _exp(500, seed, "valor").alias("valor"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), (F.col("id") - 1).cast("int"))).alias("data_transacao"),
        _choice(["APROVADA", "REJEITADA", "PENDENTE"], [0.8, 0.15, 0.05], seed, "status").alias("status"),
        _choice(["MOBILE", "WEB", "ATM", "AGENCIA"], [0.6, 0.3, 0.08, 0.02], seed, "canal").alias("canal"),
        _choice(["iPhone 14", "Samsung Galaxy", "Chrome", "Firefox"], None, seed, "disp").alias("dispositivo"),
        F.concat(F.lit("192.168."), _int(1, 255, seed, "ip1").cast("string"), F.lit("."),
                 _int(1, 255, seed, "ip2").cast("string")).alias("ip_address"),
        _choice(["Mozilla/5.0 Chrome", "Mozilla/5.0 Firefox", "Mozilla/5.0 Safari"], None, seed,
                "ua").alias("user_agent"),
        _choice(["São Paulo", "Rio de Janeiro", "Belo Horizonte", "Salvador", "Brasília"], None, seed,
                "cidade").alias("cidade"),
        _choice(["SP", "RJ", "MG", "BA", "DF"], None, seed, "estado").alias("estado"),
        _u(seed, "risco").alias("score_risco"),
        _int(50, 500, seed, "tempo").alias("tempo_processamento_ms"))
