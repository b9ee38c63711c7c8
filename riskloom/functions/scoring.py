"""Scoring and decision rules as Catalyst expressions.

Each function returns a Column; pass column names or Columns.  The same rules
are exposed to SQL by :func:`riskloom.functions.sql_functions.register_functions`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import clip, col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (labels, texts, thresholds).
# ---------------------------------------------------------------------------
RISK_BANDS = [(0.15, "A"), (0.35, "B"), (0.60, "C")]            # else "D"
POLICY_PROFILES = {
    # name: (approve score, review score, (low, medium, high levels),
    #        (approve, review, reject words))
    "rest": (700, 500, ("LOW", "MEDIUM", "HIGH"), ("APROVADO", "REVISAO", "REJEITADO")),
    "grpc": (700, 500, ("BAIXO", "MEDIO", "ALTO"), ("APROVADO", "REVISAO", "REJEITADO")),
    "gateway": (700, 400, ("LOW", "MEDIUM", "HIGH"), ("APPROVED", "REVIEW", "REJECTED")),
}
FACTOR_HISTORY = "Histórico de pagamentos superior a 24 meses"
FACTOR_UTILISATION = "Limite atual com utilização acima de 80%"
FACTOR_COMMITMENT = "Comprometimento de renda acima de 50%"
FRAUD_LEVELS = {
    "pt": ("CRITICO", "ALTO", "MEDIO", "BAIXO"),
    "en": ("CRITICAL", "HIGH", "MEDIUM", "LOW"),
}
FLAG_ANOMALY = "Comportamento anômalo detectado"
FLAG_KNOWN_PATTERN = "Padrão de fraude conhecido"
REG_COAF = "COAF – Art. 11, Lei 9.613/98"
REG_BACEN = "BACEN – Circular 3.978/2020"
REG_LGPD = "LGPD – Lei 13.709/2018"
REG_CMN = "CMN – Resolução 4.966/2021"
SEGMENT_NAMES = {0: "PREMIUM", 1: "REGULAR", 2: "RECENTE", 3: "RISCO", 4: "INATIVO"}


# --- P19 --------------------------------------------------------------------
def to_score(prob) -> Column:
    """FICO-style score: trunc(clip(850 - 550 p, 300, 850))."""
    return clip(850 - 550 * col(prob), 300, 850).cast("int")


# --- P20 --------------------------------------------------------------------
def risk_band(prob) -> Column:
    p = col(prob)
    out = F.lit("D")
    for limit, band in reversed(RISK_BANDS):
        out = F.when(p < limit, F.lit(band)).otherwise(out)
    return out


# --- P21 --------------------------------------------------------------------
def policy_decision(score, profile: str = "rest") -> Column:
    """struct(nivel_risco, decisao) by score thresholds of a serving profile."""
    hi, mid, levels, words = POLICY_PROFILES[profile]
    s = col(score)
    lvl = F.when(s >= hi, levels[0]).when(s >= mid, levels[1]).otherwise(levels[2])
    dec = F.when(s >= hi, words[0]).when(s >= mid, words[1]).otherwise(words[2])
    return F.struct(lvl.alias("nivel_risco"), dec.alias("decisao"))


# --- P22 --------------------------------------------------------------------
def suggested_limit(amount, score) -> Column:
    s = col(score)
    return F.when(s < 400, F.lit(0.0)).otherwise(col(amount) * s / 1000.0)


# --- P23 --------------------------------------------------------------------
def credit_factors(history_months, utilisation, debt, income) -> Column:
    """struct(positivos array, riscos array)."""
    inc = F.greatest(col(income).cast("double"), F.lit(1.0))
    commitment = col(debt) / inc
    pos = F.filter(F.array(F.when(col(history_months) >= 24, F.lit(FACTOR_HISTORY))),
                   lambda x: x.isNotNull())
    risk = F.filter(F.array(F.when(col(utilisation) > 0.8, F.lit(FACTOR_UTILISATION)),
                            F.when(commitment > 0.5, F.lit(FACTOR_COMMITMENT))),
                    lambda x: x.isNotNull())
    return F.struct(pos.alias("fatores_positivos"), risk.alias("fatores_risco"))


# --- P24 --------------------------------------------------------------------
def fraud_band(score, anomaly, supervised, lang: str = "pt") -> Column:
    crit, high, med, low = FRAUD_LEVELS[lang]
    s = col(score)
    level = (F.when(s >= 0.8, crit).when(s >= 0.5, high).when(s >= 0.2, med).otherwise(low))
    block = F.coalesce(s >= 0.8, F.lit(False))
    flags = F.filter(F.array(F.when(col(anomaly) > 0.7, F.lit(FLAG_ANOMALY)),
                             F.when(col(supervised) > 0.7, F.lit(FLAG_KNOWN_PATTERN))),
                     lambda x: x.isNotNull())
    return F.struct(level.alias("nivel_risco"), block.alias("bloquear"),
                    flags.alias("sinalizadores"),
                    F.when(block, "BLOQUEAR").otherwise("PERMITIR").alias("recomendacao"))


# --- P25 --------------------------------------------------------------------
def compliance_tags(amount, country) -> Column:
    a = col(amount)
    c = col(country)
    regs = F.filter(F.array(
        F.when(a > 10000, F.lit(REG_COAF)),
        F.when(c.isNotNull() & (c != "") & (F.upper(c) != "BR"), F.lit(REG_BACEN)),
        F.lit(REG_LGPD), F.lit(REG_CMN)), lambda x: x.isNotNull())
    bad = F.coalesce(a > 50000, F.lit(False))
    return F.struct(regs.alias("regulacoes"), (~bad).alias("conforme"),
                    F.when(bad, "NAO_CONFORME").otherwise("CONFORME").alias("status"),
                    F.when(bad, "HIGH").otherwise("LOW").alias("nivel_risco"))


# --- P26 --------------------------------------------------------------------
def rule_decision_fallback(amount, score) -> Column:
    s = F.when(F.coalesce(col(score), F.lit(0)) == 0, F.lit(500)).otherwise(col(score))
    return (F.when(col(amount) > 500000, "ESCALATE").when(s < 300, "REJECT")
            .when(s < 500, "REVIEW").otherwise("APPROVE"))


# --- P27 --------------------------------------------------------------------
FALLBACK_PROB = 0.15


def fallback_score(debt) -> Column:
    return clip(700 - col(debt) / 50.0, 300, 850).cast("int")


# --- P28 --------------------------------------------------------------------
def segment_name(cluster, training_side: bool = False) -> Column:
    c = col(cluster)
    if training_side:
        return F.concat(F.lit("segment_"), c.cast("string"))
    m = F.create_map(*[x for k, v in sorted(SEGMENT_NAMES.items()) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[c], F.concat(F.lit("CLUSTER_"), c.cast("string")))


# --- P29 --------------------------------------------------------------------
def label_fraud_rule(valor, p99, hour, day_of_week, score_risco) -> Column:
    return ((col(valor) > col(p99)) | (col(hour) < 6) | (col(hour) > 22)
            | (col(day_of_week) >= 5) | (col(score_risco) > 0.8)).cast("int")


# --- P30 --------------------------------------------------------------------
def label_default_rule(days_late, pct_late, pct_limit: float = 0.2) -> Column:
    return F.coalesce((col(days_late) > 30) | (col(pct_late) > pct_limit),
                      F.lit(False)).cast("int")


# --- P31 --------------------------------------------------------------------
def legacy_score_target(score_risco) -> Column:
    return F.least(F.greatest((300 + 400 * (1 - col(score_risco))).cast("int"),
                              F.lit(300)), F.lit(850))


# --- P32 --------------------------------------------------------------------
def classify(prob, threshold: float = 0.5) -> Column:
    return (col(prob) >= threshold).cast("int")
