"""Governed decisions (G1-G17, W6) as column expressions.

Provider answers are a *table* ``(case_key, idx, raw)``; per case a plain
aggregate keeps the first answer, the best of the first round and the answer
to each retry.  When a provider is asked (:func:`govern_cases`), gates and
routes come first, every call's answer is stored before it is used, and
retries are a second hop over the failing cases alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, word_count
from ..session import scratch_table
from .prompts import ask, generate_candidates, message, messages

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (decisions, gate ids, texts).
# ---------------------------------------------------------------------------
DECISIONS = ["APPROVE", "REJECT", "DEFER", "ESCALATE"]
GATE_SCORE = "G1_SCORE_MINIMO"
GATE_DTI = "G2_COMPROMETIMENTO_RENDA"
GATE_AMOUNT = "G3_VALOR_ALCADA_SUPERIOR"
GATE_RISK = "G4_RISCO_CRITICO"
GATE_DEFAULT = "G5_INADIMPLENCIA_GRAVE"
GATE_LIST = "G6_LISTA_RESTRICAO_REGULATORIA"
GATE_AMBIGUITY = "K0_11_AMBIGUITY_GATE"
TXT_SCORE = ("Score de crédito %s abaixo do mínimo operacional (300). "
             "Operação rejeitada automaticamente conforme política de crédito.")
TXT_DTI = "Comprometimento de renda %s%% excede limite máximo de 80%% (Resolução CMN nº 4.966/2021)."
TXT_AMOUNT = ("Valor R$ %s excede alçada automática (R$ 500.000). "
              "Requer aprovação de comitê de crédito.")
TXT_RISK = ("Score de risco interno %s em nível crítico (≥0.90). "
            "Operação sinalizada para revisão manual.")
TXT_DEFAULT = ("Inadimplência recente de %s meses. "
               "Política de crédito requer período de regularização mínimo de 12 meses.")
TXT_LIST = ("Cliente identificado em lista regulatória (COAF/BACEN). "
            "Operação bloqueada e escalada para compliance (COAF Resolução 36/2021).")
TXT_NO_RATIONALE = "Nenhuma justificativa válida produzida."
TXT_I6Q_MIN_PRO = "Mínimo %d argumentos favoráveis necessários."
TXT_I6Q_MIN_CON = "Mínimo %d argumentos contrários necessários."
TXT_I6Q_SHORT_PRO = "Argumento favorável %d muito curto (%d palavras, mínimo %d)."
TXT_I6Q_SHORT_CON = "Argumento contrário %d muito curto (%d palavras, mínimo %d)."
TXT_I6Q_OK = "Qualidade de argumentos OK."
PREFIX_I6Q = "[FORÇADO ESCALATE — FALHA I6Q] "
PREFIX_AMBIGUITY = "[FORÇADO %s — AMBIGUITY GATE] "
TXT_RETRY = ("Sua resposta anterior falhou no portão de qualidade de informação (I6Q):\n"
             "Erro: %s\n"
             "Por favor, reformule sua resposta fornecendo argumentos mais longos, "
             "claros e detalhados em português (mínimo 10 palavras por argumento, "
             "pelo menos 2 argumentos pró e 2 contra). Retorne APENAS o JSON estruturado.")
TXT_R3_AMOUNT = "valor R$ %s >= limite R$ %s"
TXT_R3_RISK = "score de risco %s >= limite %s"
TXT_R3_SCORE = "score de crédito %s < limite %s"
CANDIDATE_SCHEMA = ("decision STRING, rationale STRING, pro_arguments ARRAY<STRING>, "
                    "con_arguments ARRAY<STRING>, confidence DOUBLE")


@dataclass(frozen=True)
class GovernanceThresholds:
    """Rule limits of the regimes (U4); defaults equal the reference."""
    n_candidates: int = 3
    max_i6q_retries: int = 2
    theta_iota: float = 0.30
    risk_escalation_threshold: float = 0.75
    min_args: int = 2
    min_words_per_arg: int = 8
    r3_amount: float = 50_000.0
    r3_risk: float = 0.50
    r3_client_score: int = 500
    nonce_seed: str = "riskloom"


DEFAULT = GovernanceThresholds()


# --- number formatting --------------------------------------------------------
def fmt_fixed(x, digits: int, grouping: bool = False, scale: float = 1.0) -> Column:
    """``x * scale`` rounded half-up to ``digits`` decimals in double
    arithmetic (floor(x * m + 0.5) / 10^d, one IEEE multiply, so every engine
    gets the same digits) and printed, with ``,`` thousands separators when
    ``grouping``."""
    m = float(scale * 10 ** digits)
    v = F.floor(col(x).cast("double") * F.lit(m) + F.lit(0.5)) / F.lit(float(10 ** digits))
    if grouping:
        return F.format_number(v, digits)
    return F.format_string(f"%.{digits}f", v)


# --- G2 -----------------------------------------------------------------------
def debt_to_income(amount="amount", income="income") -> Column:
    """round(amount / income, 4) when both > 0, else 0."""
    a, i = col(amount), col(income)
    return F.when((i > 0) & (a > 0), F.round(a / i, 4)).otherwise(F.lit(0.0))


# --- G1 -----------------------------------------------------------------------
def build_cases(credit: DataFrame, prefix: str = "TRAIN-CRED-") -> DataFrame:
    """Credit rows -> governed cases: amount = total_financiado, score clipped
    to 0..1000 (0/absent -> 600), risk = min(1, compr/2 + late/30)."""
    compr = F.coalesce(F.col("comprometimento_renda"), F.lit(0.0)) \
        if "comprometimento_renda" in credit.columns else F.lit(0.0)
    late = F.coalesce(F.col("atrasos_hist"), F.lit(0)).cast("int")
    score = F.when(F.coalesce(F.col("score_bureau"), F.lit(0)) == 0, F.lit(600)) \
        .otherwise(F.col("score_bureau"))
    out = credit.select(
        F.concat(F.lit(prefix), F.col("id_cliente").cast("string")).alias("case_id"),
        F.col("id_cliente").alias("case_key"),
        F.lit("credit_approval").alias("operation_type"),
        F.coalesce(F.col("total_financiado"), F.lit(0.0)).cast("double").alias("amount"),
        F.least(F.greatest(score, F.lit(0)), F.lit(1000)).cast("int").alias("client_score"),
        F.coalesce(F.col("renda_mensal"), F.lit(0.0)).cast("double").alias("income"),
        F.least(F.lit(1.0), compr / 2.0 + late / 30.0).alias("risk_score"),
        late.alias("meses_inadimplencia_recente"),
        F.lit(False).alias("lista_coaf"),
        F.lit(None).cast("string").alias("description"),
        compr.alias("comprometimento_renda"),
        F.coalesce(F.col("numero_operacoes_credito"), F.lit(0)).cast("int")
        .alias("numero_operacoes_credito"),
        F.coalesce(F.col("score_bureau"), F.lit(600)).cast("int").alias("score_bureau"),
        (F.col("inadimplente") if "inadimplente" in credit.columns else F.lit(0))
        .cast("int").alias("inadimplente"))
    return out.withColumn("debt_to_income", debt_to_income())


def with_dti(cases: DataFrame) -> DataFrame:
    """The cases with debt_to_income and both regulatory list flags (absent:
    not listed)."""
    for flag in ("lista_coaf", "lista_bacen_impedidos"):
        if flag not in cases.columns:
            cases = cases.withColumn(flag, F.lit(False))
    if "debt_to_income" in cases.columns:
        return cases
    return cases.withColumn("debt_to_income", debt_to_income())


# --- G3 -----------------------------------------------------------------------
def case_prompt() -> Column:
    """Structured case text sent to the provider (money with thousands
    separators, percent with one decimal, optional description / context)."""
    lines = F.array(
        F.concat(F.lit("CASO ID: "), F.col("case_id")),
        F.concat(F.lit("TIPO DE OPERAÇÃO: "), F.col("operation_type")),
        F.concat(F.lit("VALOR: R$ "), fmt_fixed("amount", 2, grouping=True)),
        F.concat(F.lit("SCORE DE CRÉDITO: "), F.col("client_score").cast("string"), F.lit("/1000")),
        F.concat(F.lit("RENDA MENSAL: R$ "), fmt_fixed("income", 2, grouping=True)),
        F.concat(F.lit("COMPROMETIMENTO DE RENDA: "), fmt_fixed("debt_to_income", 1, scale=100.0),
                 F.lit("%")),
        F.concat(F.lit("SCORE DE RISCO INTERNO: "), fmt_fixed("risk_score", 2), F.lit("/1.00")),
        F.when(F.coalesce(F.col("description"), F.lit("")) != "",
               F.concat(F.lit("DESCRIÇÃO: "), F.col("description"))),
        F.lit("CONTEXTO ADICIONAL:"),
        F.concat(F.lit("  - meses_inadimplencia_recente: "),
                 F.col("meses_inadimplencia_recente").cast("string")),
        F.concat(F.lit("  - lista_coaf: "),
                 F.when(F.col("lista_coaf"), "True").otherwise("False")))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


# --- G4 -----------------------------------------------------------------------
def hard_gates() -> Column:
    """First matching gate as struct(gate_id, forced_decision, rationale), or
    null when no gate fires."""
    def gate(gid, dec, text):
        return F.struct(F.lit(gid).alias("gate_id"), F.lit(dec).alias("forced_decision"),
                        text.alias("rationale"))
    score, dti, amount = F.col("client_score"), F.col("debt_to_income"), F.col("amount")
    risk, late = F.col("risk_score"), F.coalesce(F.col("meses_inadimplencia_recente"), F.lit(0))
    # either regulatory list; the view decides in its plan which columns exist
    listed = F.coalesce(F.col("lista_coaf"), F.lit(False)) \
        | F.coalesce(F.col("lista_bacen_impedidos"), F.lit(False))
    return (F.when(score < 300, gate(GATE_SCORE, "REJECT",
                                     F.format_string(TXT_SCORE, score.cast("string"))))
            .when(dti > 0.80, gate(GATE_DTI, "REJECT",
                                   F.format_string(TXT_DTI, fmt_fixed(dti, 1, scale=100.0))))
            .when(amount > 500_000, gate(GATE_AMOUNT, "ESCALATE",
                                         F.format_string(TXT_AMOUNT, fmt_fixed(amount, 2, True))))
            .when(risk >= 0.90, gate(GATE_RISK, "ESCALATE",
                                     F.format_string(TXT_RISK, fmt_fixed(risk, 2))))
            .when(late.cast("int") >= 6, gate(GATE_DEFAULT, "REJECT",
                                              F.format_string(TXT_DEFAULT, late.cast("string"))))
            .when(listed, gate(GATE_LIST, "ESCALATE", F.lit(TXT_LIST))))


# --- G5 -----------------------------------------------------------------------
def commit_nonce(seed: str = DEFAULT.nonce_seed) -> Column:
    """Seeded 32-hex nonce per case (a replayable stand-in for a random
    token), committed by its sha256."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("case_id")), 256), 1, 32)


def reveal_ok(nonce, nonce_hash) -> Column:
    return F.sha2(col(nonce), 256) == col(nonce_hash)


# --- G6 / G7 ------------------------------------------------------------------
def parse_candidate(raw="raw") -> Column:
    """Tolerant JSON parse: strip a code fence, drop trailing commas, parse;
    else the first ``{...}`` block; else empty.  Returns
    struct(nonempty, decision, rationale, pro_arguments, con_arguments,
    confidence).  (Column form; :func:`parse_candidates` computes the same
    with every step materialised once per row.)"""
    s = _clean(col(raw))
    k1 = F.json_object_keys(s)
    blk = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    k2 = F.json_object_keys(blk)
    text = F.when(k1.isNotNull(), s).when((blk != "") & k2.isNotNull(), blk)
    nonempty = F.coalesce(F.size(F.when(k1.isNotNull(), k1).otherwise(k2)) > 0, F.lit(False))
    return _parsed_struct(text, nonempty)


def _clean(s: Column) -> Column:
    s = F.trim(F.coalesce(s, F.lit("")))
    s = F.regexp_replace(s, r"^```(?:json)?\s*\n?", "")
    s = F.regexp_replace(s, r"\n?```\s*$", "")
    return F.regexp_replace(s, r",\s*([}\]])", "$1")


def _parsed_struct(text: Column, nonempty: Column) -> Column:
    return _candidate_struct(F.from_json(text, CANDIDATE_SCHEMA), nonempty)


def _candidate_struct(p: Column, nonempty: Column) -> Column:
    return F.struct(nonempty.alias("nonempty"), p["decision"].alias("decision"),
                    p["rationale"].alias("rationale"), p["pro_arguments"].alias("pro_arguments"),
                    p["con_arguments"].alias("con_arguments"), p["confidence"].alias("confidence"))


def parse_candidates(cands: DataFrame, raw: str = "raw", out: str = "p") -> DataFrame:
    """DataFrame form of :func:`parse_candidate`: each intermediate is its own
    projection (regex cleanup once, the first-block regex only when the whole
    text is not an object, one JSON parse), so no step is re-evaluated."""
    d = cands.withColumn("_s", _clean(F.col(raw)))
    d = d.withColumn("_k1", F.json_object_keys("_s"))
    d = d.withColumn("_blk", F.when(F.col("_k1").isNull(), F.regexp_extract("_s", r"(?s)\{.*\}", 0)))
    d = d.withColumn("_k2", F.when(F.col("_blk") != "", F.json_object_keys("_blk")))
    d = d.withColumn("_text", F.when(F.col("_k1").isNotNull(), F.col("_s"))
                     .when(F.col("_k2").isNotNull(), F.col("_blk")))
    nonempty = F.coalesce(F.size(F.coalesce("_k1", "_k2")) > 0, F.lit(False))
    # a column of its own: field access right on from_json is split by the
    # optimizer into one parse per field
    d = d.withColumn("_j", F.from_json("_text", CANDIDATE_SCHEMA))
    d = d.withColumn(out, _candidate_struct(F.col("_j"), nonempty))
    return d.drop("_s", "_k1", "_blk", "_k2", "_text", "_j")


def _all_words(arr: Column, n: int) -> Column:
    return F.forall(arr, lambda a: word_count(a) >= n)


def score_candidate(p: Column) -> Column:
    """0.30 valid decision + 0.25 rationale >= 20 words + 0.20 per side with
    >= 2 arguments of >= 5 words + 0.05 numeric confidence (capped at 1)."""
    dec_ok = F.coalesce(F.upper(p["decision"]).isin(DECISIONS), F.lit(False))
    rat_ok = word_count(p["rationale"]) >= 20
    pro_ok = F.coalesce((F.size(p["pro_arguments"]) >= 2) & _all_words(p["pro_arguments"], 5),
                        F.lit(False))
    con_ok = F.coalesce((F.size(p["con_arguments"]) >= 2) & _all_words(p["con_arguments"], 5),
                        F.lit(False))
    conf_ok = p["confidence"].isNotNull()
    hundredths = (F.when(dec_ok, 30).otherwise(0) + F.when(rat_ok, 25).otherwise(0)
                  + F.when(pro_ok, 20).otherwise(0) + F.when(con_ok, 20).otherwise(0)
                  + F.when(conf_ok, 5).otherwise(0))
    return F.least(hundredths / 100.0, F.lit(1.0))


def estimate_tokens(text) -> Column:
    """max(1, words * 4 div 3) (offline provider estimate)."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * 4 / 3).cast("int"))


def scored_candidates(cands: DataFrame, key: str = "case_key") -> DataFrame:
    """(case_key, idx, raw) -> + parsed struct p, score, tokens (per row)."""
    out = parse_candidates(cands)
    out = out.withColumn("score", score_candidate(F.col("p")))
    if "tokens" not in out.columns:
        out = out.withColumn("tokens", estimate_tokens("raw"))
    return out


# --- G8 -----------------------------------------------------------------------
def i6q_check(pro, con, th: GovernanceThresholds = DEFAULT) -> Column:
    """struct(passed, details): >= min_args arguments per side, each with >=
    min_words words; message of the first failure in order."""
    pro, con = col(pro), col(con)
    mw = th.min_words_per_arg

    def first_short(arr):
        idx = F.transform(arr, lambda a, i: F.struct((i + 1).alias("i"), word_count(a).alias("w")))
        return F.try_element_at(F.filter(idx, lambda s: s["w"] < mw), F.lit(1))
    sp, sc = first_short(pro), first_short(con)
    details = (F.when(pro.isNull() | (F.size(pro) < th.min_args),
                      F.lit(TXT_I6Q_MIN_PRO % th.min_args))
               .when(con.isNull() | (F.size(con) < th.min_args), F.lit(TXT_I6Q_MIN_CON % th.min_args))
               .when(sp.isNotNull(), F.format_string(TXT_I6Q_SHORT_PRO, sp["i"], sp["w"], F.lit(mw)))
               .when(sc.isNotNull(), F.format_string(TXT_I6Q_SHORT_CON, sc["i"], sc["w"], F.lit(mw)))
               .otherwise(F.lit(TXT_I6Q_OK)))
    return F.struct((details == TXT_I6Q_OK).alias("passed"), details.alias("details"))


# --- G9 -----------------------------------------------------------------------
def ambiguity_gate(th: GovernanceThresholds = DEFAULT) -> Column:
    """DEFER when fewer than theta of the 6 dossier fields are filled; ESCALATE
    when risk >= threshold; else null."""
    filled = (F.when(F.col("amount") > 0, 1).otherwise(0)
              + F.when(F.col("client_score") > 0, 1).otherwise(0)
              + F.when(F.col("income") > 0, 1).otherwise(0)
              + F.when(F.col("risk_score") > 0, 1).otherwise(0)
              + F.lit(1)  # context is always present for these cases
              + F.when(F.coalesce(F.col("description"), F.lit("")) != "", 1).otherwise(0))
    return (F.when(filled / 6.0 < th.theta_iota, F.lit("DEFER"))
            .when(F.col("risk_score") >= th.risk_escalation_threshold, F.lit("ESCALATE")))


def _valid_decision(d: Column) -> Column:
    u = F.upper(F.coalesce(d, F.lit("DEFER")))
    return F.when(u.isin(DECISIONS), u).otherwise(F.lit("DEFER"))


def _empty_arr() -> Column:
    return F.array().cast("array<string>")


# --- one row of answers per case -----------------------------------------------
def answers_per_case(cands: DataFrame, key: str = "case_key",
                     th: GovernanceThresholds = DEFAULT) -> DataFrame:
    """One row per case: ``c0`` (the first answer), ``best`` of the first
    round (W6), ``tok`` (its tokens) and ``a1``, ``a2``.. (the answers to the
    retries, idx n_candidates and on).  Plain aggregates with map-side
    combine; no list of answers is gathered."""
    s = scored_candidates(cands, key)
    failed = F.coalesce(F.col("provider_failed"), F.lit(False)) \
        if "provider_failed" in s.columns else F.lit(False)
    s = s.withColumn("_c", F.struct("idx", "raw", "p", "score", "tokens", failed.alias("failed")))
    first = F.col("idx") < th.n_candidates

    def pick(cond, order):
        return F.max_by(F.when(cond, F.col("_c")), F.when(cond, order))
    # The highest score above 0 (first index on ties), else the first answer
    rank = F.struct(F.greatest(F.col("score"), F.lit(0.0)).alias("s"), (-F.col("idx")).alias("n"))
    retries = [pick(F.col("idx") == th.n_candidates - 1 + r, F.col("idx")).alias(f"a{r}")
               for r in range(1, th.max_i6q_retries + 1)]
    return s.groupBy(key).agg(
        pick(F.col("idx") == 0, F.col("idx")).alias("c0"), pick(first, rank).alias("best"),
        F.sum(F.when(first, F.col("tokens"))).cast("long").alias("tok"), *retries)


# --- G10 ----------------------------------------------------------------------
def r1_decide(cases: DataFrame, answers: DataFrame, key: str = "case_key") -> DataFrame:
    """One response (the first answer); decision upper-cased, invalid
    -> DEFER; rationale falls back to the raw text.  ``provider_failed`` marks
    the cases whose call raised."""
    j = with_dti(cases).join(answers.select(key, "c0"), key, "left")
    return j.select("*", *[c.alias(n) for n, c in _r1_columns().items()]).drop("c0")


def _r1_columns() -> dict[str, Column]:
    """R1's decision from ``c0``."""
    c0 = F.col("c0")
    p = c0["p"]
    return {
        "regime": F.lit("R1"),
        "decision": _valid_decision(p["decision"]),
        "rationale": F.coalesce(p["rationale"], c0["raw"]),
        "pro_arguments": F.coalesce(p["pro_arguments"], _empty_arr()),
        "con_arguments": F.coalesce(p["con_arguments"], _empty_arr()),
        "gates_triggered": _empty_arr(),
        "i6q_passed": F.lit(True),
        "entropy_nonce": F.lit(None).cast("string"),
        "tokens_used": F.coalesce(c0["tokens"], F.lit(0)).cast("long"),
        "i6q_retries": F.lit(0),
        "hard_gate_override": F.lit(False),
        "provider_failed": F.coalesce(c0["failed"], F.lit(False))}


# --- G11 / G12 ----------------------------------------------------------------
def _r2_fold(cases: DataFrame, answers: DataFrame, key: str, th: GovernanceThresholds,
             attempts: int) -> DataFrame:
    """Best first-round answer and the fold over the first ``attempts``
    retries: ``_dec``, ``_rat``, ``_pro``, ``_con``, ``_tok``, ``_retries``,
    ``_passed``, ``_details`` and the last answer's text ``_raw``."""
    j = with_dti(cases).join(answers, key, "left")
    p = F.col("best.p")
    j = j.withColumns({
        "_dec": _valid_decision(p["decision"]),
        "_rat": F.coalesce(p["rationale"], F.lit(TXT_NO_RATIONALE)),
        "_pro": F.coalesce(p["pro_arguments"], _empty_arr()),
        "_con": F.coalesce(p["con_arguments"], _empty_arr()),
        "_tok": F.coalesce("tok", F.lit(0).cast("long")),
        "_raw": F.coalesce(F.col("best.raw"), F.lit("")),
        "_retries": F.lit(0)})
    j = j.withColumn("_i6q", i6q_check("_pro", "_con", th))
    j = j.withColumns({"_passed": F.col("_i6q.passed"), "_details": F.col("_i6q.details")})
    for r in range(1, attempts + 1):
        a = F.col(f"a{r}")
        ap = a["p"]
        go = ~F.col("_passed")
        has = go & F.coalesce(ap["nonempty"], F.lit(False))
        apro = F.coalesce(ap["pro_arguments"], _empty_arr())
        acon = F.coalesce(ap["con_arguments"], _empty_arr())
        j = j.withColumn("_chk", i6q_check(apro, acon, th))
        adopt = has & (F.col("_chk.passed") | (F.coalesce(ap["decision"], F.lit("")) != ""))
        answered = go & F.coalesce(~a["failed"], F.lit(False))
        j = j.withColumns({
            "_dec": F.when(adopt, _valid_decision(ap["decision"])).otherwise(F.col("_dec")),
            "_rat": F.when(adopt, F.coalesce(ap["rationale"], F.col("_rat"))).otherwise(F.col("_rat")),
            "_pro": F.when(adopt, apro).otherwise(F.col("_pro")),
            "_con": F.when(adopt, acon).otherwise(F.col("_con")),
            "_tok": F.col("_tok") + F.when(go, F.coalesce(a["tokens"], F.lit(0))).otherwise(0),
            "_raw": F.when(answered, a["raw"]).otherwise(F.col("_raw")),
            "_retries": F.col("_retries") + F.when(go, 1).otherwise(0),
            "_passed": F.when(has, F.col("_chk.passed")).otherwise(F.col("_passed")),
            "_details": F.when(has, F.col("_chk.details")).otherwise(F.col("_details")),
        }).drop("_chk")
    return j


def r2_decide(cases: DataFrame, answers: DataFrame, key: str = "case_key",
              th: GovernanceThresholds = DEFAULT) -> DataFrame:
    """R2: hard gates short-circuit; else best candidate (W6), I6Q with
    retries (attempt r is the answer idx n_candidates - 1 + r), failure forces
    ESCALATE, ambiguity gate override, prefixes on the rationale, seeded
    nonce.  A failed call is an empty answer."""
    j = _r2_fold(cases, answers, key, th, th.max_i6q_retries).withColumn("_gate", hard_gates())
    return j.select(*_case_columns(j, th), *[c.alias(n) for n, c in _r2_columns(th).items()])


def _case_columns(j: DataFrame, th: GovernanceThresholds) -> list[str]:
    """Columns of the cases in a joined table of cases and answers."""
    answers = {"c0", "best", "tok", *(f"a{r}" for r in range(1, th.max_i6q_retries + 1))}
    return [c for c in j.columns if not c.startswith("_") and c not in answers]


def _r2_columns(th: GovernanceThresholds) -> dict[str, Column]:
    """R2's decision from the fold's columns and ``_gate``."""
    failed_dec = F.when(F.col("_passed"), F.col("_dec")).otherwise(F.lit("ESCALATE"))
    failed_rat = F.when(F.col("_passed"), F.col("_rat")).otherwise(
        F.concat(F.lit(PREFIX_I6Q), F.col("_rat")))
    amb = ambiguity_gate(th)
    dec = F.coalesce(amb, failed_dec)
    rat = F.when(amb.isNotNull(), F.concat(F.format_string(PREFIX_AMBIGUITY, amb), failed_rat)) \
        .otherwise(failed_rat)
    gated = F.col("_gate").isNotNull()
    free = lambda out: F.when(~gated, out)  # noqa: E731  null where a gate decides
    return {
        "regime": F.lit("R2"),
        "decision": F.when(gated, F.col("_gate.forced_decision")).otherwise(dec),
        "rationale": F.when(gated, F.col("_gate.rationale")).otherwise(rat),
        "pro_arguments": F.when(gated, _empty_arr()).otherwise(F.col("_pro")),
        "con_arguments": F.when(gated, _empty_arr()).otherwise(F.col("_con")),
        "gates_triggered": F.when(gated, F.array(F.col("_gate.gate_id")))
        .when(amb.isNotNull(), F.array(F.lit(GATE_AMBIGUITY))).otherwise(_empty_arr()),
        "i6q_passed": gated | F.col("_passed"),
        "entropy_nonce": free(commit_nonce(th.nonce_seed)),
        "tokens_used": F.when(gated, F.lit(0).cast("long")).otherwise(F.col("_tok")),
        "i6q_retries": F.when(gated, F.lit(0)).otherwise(F.col("_retries")),
        "hard_gate_override": gated,
        "i6q_details": free(F.col("_details")),
        "provider_failed": F.lit(False)}


# --- G14 ----------------------------------------------------------------------
def r3_reasons(th: GovernanceThresholds = DEFAULT) -> Column:
    a, r, s = F.col("amount"), F.col("risk_score"), F.col("client_score")
    return F.filter(F.array(
        F.when(a >= th.r3_amount, F.format_string(
            TXT_R3_AMOUNT, fmt_fixed(a, 2, True), F.lit(f"{th.r3_amount:,.2f}"))),
        F.when(r >= th.r3_risk, F.format_string(
            TXT_R3_RISK, fmt_fixed(r, 2), F.lit(f"{th.r3_risk:.2f}"))),
        F.when((s > 0) & (s < th.r3_client_score), F.format_string(
            TXT_R3_SCORE, s.cast("string"), F.lit(str(th.r3_client_score))))),
        lambda x: x.isNotNull())


def r3_split(cases: DataFrame, th: GovernanceThresholds = DEFAULT):
    """(cases for R2, cases for R1) with their routing reasons: R2 when
    amount >= 50k, risk >= 0.5 or 0 < score < 500."""
    c = with_dti(cases).withColumn("adaptive_reasons", r3_reasons(th))
    return c.filter(F.size("adaptive_reasons") > 0), c.filter(F.size("adaptive_reasons") == 0)


def r3_merge(r2: DataFrame, r1: DataFrame) -> DataFrame:
    """Both branches' results, relabelled R3."""
    r2 = r2.withColumn("adaptive_routed_to", F.lit("R2"))
    r1 = (r1.withColumn("adaptive_routed_to", F.lit("R1"))
          .withColumn("i6q_details", F.lit(None).cast("string")))
    return r2.unionByName(r1).withColumn("regime", F.lit("R3"))


def r3_decide(cases: DataFrame, answers: DataFrame, key: str = "case_key",
              th: GovernanceThresholds = DEFAULT) -> DataFrame:
    """Each case goes through R2 or R1; the result is relabelled R3 with
    the routing reasons.  One plan over one table of answers (parsed once):
    every output column is R2's or R1's, as the reasons tell."""
    j = _r2_fold(cases, answers, key, th, th.max_i6q_retries).withColumns(
        {"_gate": hard_gates(), "adaptive_reasons": r3_reasons(th)})
    to_r2 = F.size("adaptive_reasons") > 0
    r1, r2 = _r1_columns(), _r2_columns(th)
    cols = {n: F.when(to_r2, c).otherwise(r1[n] if n in r1 else F.lit(None))
            for n, c in r2.items() if n != "regime"}
    return j.select(
        *_case_columns(j, th), *[c.alias(n) for n, c in cols.items()],
        F.when(to_r2, "R2").otherwise("R1").alias("adaptive_routed_to"),
        F.lit("R3").alias("regime"))


# --- G15 / G16 ----------------------------------------------------------------
def audit_hash(case_id="case_id", nonce="entropy_nonce", decision="decision") -> Column:
    """First 32 hex of sha256('case_id:nonce:decision')."""
    return F.substring(F.sha2(F.concat(col(case_id), F.lit(":"), F.coalesce(col(nonce), F.lit("")),
                                       F.lit(":"), col(decision)), 256), 1, 32)


def audit_record(results: DataFrame) -> DataFrame:
    """Flat audit projection."""
    return results.select(
        "case_id", "regime", "decision", audit_hash().alias("audit_nonce"), "gates_triggered",
        (F.col("hard_gate_override") & (F.size("gates_triggered") > 0)).alias("hard_gate_override"),
        "i6q_passed", "tokens_used")


# --- G13 ----------------------------------------------------------------------
def retry_prompt(details="i6q_details") -> Column:
    return F.format_string(TXT_RETRY, col(details))


# --- G17 ----------------------------------------------------------------------
REGIMES = {"R1": r1_decide, "R2": r2_decide, "R3": r3_decide}


def register_regime(name: str, fn) -> None:
    """Add a regime with the same contract
    ``fn(cases, answers_per_case, key, thresholds) -> decisions``."""
    if not callable(fn):
        raise TypeError("regime must be callable")
    REGIMES[name] = fn


def decide(regime: str, cases: DataFrame, cands: DataFrame, key: str = "case_key",
           th: GovernanceThresholds = DEFAULT) -> DataFrame:
    """A regime over a given table of answers (key, idx, raw)."""
    if regime not in REGIMES:
        raise ValueError(f"unknown regime {regime}; known: {sorted(REGIMES)}")
    answers, fn = answers_per_case(cands, key, th), REGIMES[regime]
    if regime == "R1":
        return fn(cases, answers, key)
    return fn(cases, answers, key, th)


def _ask_r1(cases, responder, th, systems, key):
    """One call per case; the answers are stored, so no call is made twice."""
    cands = generate_candidates(cases, responder, 1, key, systems.get("R1"), prefix="")
    return r1_decide(cases, answers_per_case(scratch_table(cands, "answers"), key, th), key)


def _ask_r2(cases, responder, th, systems, key):
    """Only cases no gate decides are asked: ``n_candidates`` answers, then,
    once per retry, another call for the cases that still fail the argument
    check, with their last answer and the feedback on it."""
    cases = with_dti(cases)
    free = cases.filter(hard_gates().isNull())
    asked = scratch_table(generate_candidates(free, responder, th.n_candidates, key,
                                              systems.get("R2")), "answers")
    for r in range(1, th.max_i6q_retries + 1):
        fold = _r2_fold(free, answers_per_case(asked, key, th), key, th, r - 1)
        again = fold.filter(~F.col("_passed")).select(
            key, F.lit(th.n_candidates - 1 + r).alias("idx"), messages(
                message("system", F.lit(systems.get("R2")).cast("string")),
                message("user", "prompt"), message("assistant", "_raw"),
                message("user", retry_prompt("_details"))).alias("messages"))
        more = scratch_table(ask(again, responder, key), "answers")
        if not more.head(1):
            break
        asked = asked.unionByName(more)
    return r2_decide(cases, answers_per_case(asked, key, th), key, th)


def govern_cases(cases: DataFrame, regime: str, responder=None, th: GovernanceThresholds = DEFAULT,
                 systems: dict | None = None, key: str = "case_key") -> DataFrame:
    """Cases with a ``prompt`` through a regime and a pluggable provider.
    ``systems`` holds the system prompt of each regime (absent: none)."""
    systems = systems or {}
    if regime == "R1":
        return _ask_r1(with_dti(cases), responder, th, systems, key)
    if regime == "R2":
        return _ask_r2(cases, responder, th, systems, key)
    if regime == "R3":
        to_r2, to_r1 = r3_split(cases, th)
        return r3_merge(_ask_r2(to_r2, responder, th, systems, key),
                        _ask_r1(to_r1, responder, th, systems, key))
    cands = scratch_table(generate_candidates(cases, responder, th.n_candidates, key,
                                              systems.get(regime)), "answers")
    return decide(regime, cases, cands, key, th)


def govern_table(credit: DataFrame, regime: str, responder=None,
                 th: GovernanceThresholds = DEFAULT, systems: dict | None = None) -> DataFrame:
    """Credit rows -> cases (G1) -> regime with the provider's answers
    -> (id_cliente, regime, decisao, audit_nonce, score_bureau, inadimplente).
    A case whose single R1 call raised gets decision ERRO."""
    cases = scratch_table(with_dti(build_cases(credit)).withColumn("prompt", case_prompt()), "cases")
    res = govern_cases(cases, regime, responder, th, systems)
    failed = F.col("provider_failed") if "provider_failed" in res.columns else F.lit(False)
    return res.select(
        F.col("case_key").alias("id_cliente"), "regime",
        F.when(failed, F.lit("ERRO")).otherwise(F.col("decision")).alias("decisao"),
        F.when(failed, F.lit("")).otherwise(audit_hash()).alias("audit_nonce"),
        "score_bureau", "inadimplente")
