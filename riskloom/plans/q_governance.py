"""Registered queries: governance (G1-G17, W6, A14) and prompt tables.

Cases: ``fx_casos``; candidate responses: ``fx_candidatos`` (three per case) or
``fx_respostas`` (the same three and two answers to retries).  The oracle side
spells the same rules in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as gv
from ..operators import prompts as pr
from ..operators.windows import head_cases
from .catalog import finish, register
from .q_features import _DERIVED_SQL, credit_features_df


# ---- DuckDB expression helpers ------------------------------------------------
def w(x: str) -> str:
    """words of x (Python len(x.split())): number of non-space runs."""
    return f"len(regexp_extract_all(COALESCE({x}, ''), '\\S+'))"


def money(x: str) -> str:
    return f"format('{{:,.2f}}', floor(CAST({x} AS DOUBLE) * CAST(100 AS DOUBLE) + 0.5) / CAST(100 AS DOUBLE))"


def fixed(x: str, d: int, scale: int = 1) -> str:
    m = float(scale * 10 ** d)
    return (f"format('{{:.{d}f}}', floor(CAST({x} AS DOUBLE) * CAST({m} AS DOUBLE) + 0.5)"
            f" / CAST({float(10 ** d)} AS DOUBLE))")


def i6q_sql(pro: str, con: str) -> str:
    def first_short(a):
        return (f"list_filter(list_transform(range(1, len({a}) + 1), lambda i: "
                f"{{'i': i, 'w': {w(f'{a}[i]')}}}), lambda s: s.w < 8)[1]")
    sp, sc = first_short(pro), first_short(con)
    return f"""(CASE WHEN {pro} IS NULL OR len({pro}) < 2 THEN 'Mínimo 2 argumentos favoráveis necessários.'
  WHEN {con} IS NULL OR len({con}) < 2 THEN 'Mínimo 2 argumentos contrários necessários.'
  WHEN {sp} IS NOT NULL THEN 'Argumento favorável ' || {sp}.i || ' muito curto (' || {sp}.w || ' palavras, mínimo 8).'
  WHEN {sc} IS NOT NULL THEN 'Argumento contrário ' || {sc}.i || ' muito curto (' || {sc}.w || ' palavras, mínimo 8).'
  ELSE 'Qualidade de argumentos OK.' END)"""


def valid_dec(d: str) -> str:
    return (f"(CASE WHEN upper(COALESCE({d}, 'DEFER')) IN ('APPROVE','REJECT','DEFER','ESCALATE') "
            f"THEN upper(COALESCE({d}, 'DEFER')) ELSE 'DEFER' END)")


CASES_SQL = """
cases AS (SELECT *, CASE WHEN income > 0 AND amount > 0 THEN round(amount / income, 4) ELSE 0.0 END AS debt_to_income
          FROM fx_casos)"""

def parsed_sql(src: str, keys: str = "case_key, idx") -> str:
    """Parsed and scored answers ``cs`` of ``src`` (keys, raw)."""
    return f"""
cl AS (SELECT {keys}, raw,
         regexp_replace(regexp_replace(regexp_replace(trim(COALESCE(raw, '')), '^```(?:json)?\\s*\\n?', ''),
           '\\n?```\\s*$', ''), ',\\s*([}}\\]])', '\\1', 'g') AS s FROM {src}),
cb AS (SELECT *, regexp_extract(s, '(?s)\\{{.*\\}}', 0) AS blk FROM cl),
cj AS (SELECT {keys}, raw,
         CASE WHEN json_valid(s) AND json_type(s) = 'OBJECT' THEN s
              WHEN blk <> '' AND json_valid(blk) AND json_type(blk) = 'OBJECT' THEN blk END AS j FROM cb),
cp AS (SELECT {keys}, raw, COALESCE(len(json_keys(j)) > 0, false) AS nonempty,
         json_extract_string(j, '$.decision') AS decision, json_extract_string(j, '$.rationale') AS rationale,
         CAST(json_extract(j, '$.pro_arguments') AS VARCHAR[]) AS pro,
         CAST(json_extract(j, '$.con_arguments') AS VARCHAR[]) AS con,
         TRY_CAST(json_extract(j, '$.confidence') AS DOUBLE) AS confidence,
         greatest(1, CAST(floor({w('raw')} * 4 / 3) AS INTEGER)) AS tokens FROM cj),
cs AS (SELECT *, least((CASE WHEN upper(decision) IN ('APPROVE','REJECT','DEFER','ESCALATE') THEN 30 ELSE 0 END
          + CASE WHEN {w('rationale')} >= 20 THEN 25 ELSE 0 END
          + CASE WHEN len(pro) >= 2 AND list_bool_and(list_transform(pro, lambda a: {w('a')} >= 5)) THEN 20 ELSE 0 END
          + CASE WHEN len(con) >= 2 AND list_bool_and(list_transform(con, lambda a: {w('a')} >= 5)) THEN 20 ELSE 0 END
          + CASE WHEN confidence IS NOT NULL THEN 5 ELSE 0 END) / 100.0, 1.0) AS score FROM cp)"""


PARSED_SQL = parsed_sql("fx_candidatos")
ANSWERS_SQL = parsed_sql("fx_respostas")

GATE_SQL = f"""(CASE WHEN client_score < 300 THEN {{'gate_id': 'G1_SCORE_MINIMO', 'forced_decision': 'REJECT',
    'rationale': 'Score de crédito ' || client_score || ' abaixo do mínimo operacional (300). Operação rejeitada automaticamente conforme política de crédito.'}}
  WHEN debt_to_income > 0.80 THEN {{'gate_id': 'G2_COMPROMETIMENTO_RENDA', 'forced_decision': 'REJECT',
    'rationale': 'Comprometimento de renda ' || {fixed('debt_to_income', 1, 100)} || '% excede limite máximo de 80% (Resolução CMN nº 4.966/2021).'}}
  WHEN amount > 500000 THEN {{'gate_id': 'G3_VALOR_ALCADA_SUPERIOR', 'forced_decision': 'ESCALATE',
    'rationale': 'Valor R$ ' || {money('amount')} || ' excede alçada automática (R$ 500.000). Requer aprovação de comitê de crédito.'}}
  WHEN risk_score >= 0.90 THEN {{'gate_id': 'G4_RISCO_CRITICO', 'forced_decision': 'ESCALATE',
    'rationale': 'Score de risco interno ' || {fixed('risk_score', 2)} || ' em nível crítico (≥0.90). Operação sinalizada para revisão manual.'}}
  WHEN COALESCE(meses_inadimplencia_recente, 0) >= 6 THEN {{'gate_id': 'G5_INADIMPLENCIA_GRAVE', 'forced_decision': 'REJECT',
    'rationale': 'Inadimplência recente de ' || meses_inadimplencia_recente || ' meses. Política de crédito requer período de regularização mínimo de 12 meses.'}}
  WHEN COALESCE(lista_coaf, false) THEN {{'gate_id': 'G6_LISTA_RESTRICAO_REGULATORIA', 'forced_decision': 'ESCALATE',
    'rationale': 'Cliente identificado em lista regulatória (COAF/BACEN). Operação bloqueada e escalada para compliance (COAF Resolução 36/2021).'}}
  END)"""

AMB_SQL = """(CASE WHEN ((CASE WHEN amount > 0 THEN 1 ELSE 0 END) + (CASE WHEN client_score > 0 THEN 1 ELSE 0 END)
   + (CASE WHEN income > 0 THEN 1 ELSE 0 END) + (CASE WHEN risk_score > 0 THEN 1 ELSE 0 END) + 1
   + (CASE WHEN COALESCE(description, '') <> '' THEN 1 ELSE 0 END)) / 6.0 < 0.30 THEN 'DEFER'
  WHEN risk_score >= 0.75 THEN 'ESCALATE' END)"""

NONCE_SQL = "substr(sha256('riskloom:' || case_id), 1, 32)"


def _step(prev: str, r: int, src: str | None = None, on: str = "USING (case_key)") -> str:
    """One unrolled retry step over the answer to retry r (idx 2 + r, or the
    row of ``src`` that ``on`` picks)."""
    a = f"a{r}"
    src = src or f"(SELECT * FROM cs WHERE idx = {2 + r}) ans"
    chk = i6q_sql(f"COALESCE({a}.pro, [])", f"COALESCE({a}.con, [])")
    return f"""
s{r} AS (SELECT p.* EXCLUDE ({a}, has, chk, adopt) REPLACE (
    CASE WHEN adopt THEN {valid_dec(f'{a}.decision')} ELSE p.dec END AS dec,
    CASE WHEN adopt THEN COALESCE({a}.rationale, p.rat) ELSE p.rat END AS rat,
    CASE WHEN adopt THEN COALESCE({a}.pro, []) ELSE p.pro END AS pro,
    CASE WHEN adopt THEN COALESCE({a}.con, []) ELSE p.con END AS con,
    p.tok + CASE WHEN NOT p.passed THEN COALESCE({a}.tokens, 0) ELSE 0 END AS tok,
    p.retries + CASE WHEN NOT p.passed THEN 1 ELSE 0 END AS retries,
    CASE WHEN has THEN chk = 'Qualidade de argumentos OK.' ELSE p.passed END AS passed,
    CASE WHEN has THEN chk ELSE p.details END AS details)
  FROM (SELECT q.*, has AND (chk = 'Qualidade de argumentos OK.' OR COALESCE({a}.decision, '') <> '') AS adopt
        FROM (SELECT s.*, {a}, NOT s.passed AND COALESCE({a}.nonempty, false) AS has, {chk} AS chk
              FROM (SELECT s.*, struct_pack(decision := ans.decision, rationale := ans.rationale,
                      pro := ans.pro, con := ans.con, nonempty := ans.nonempty, tokens := ans.tokens) AS {a}
                    FROM {prev} s LEFT JOIN {src} {on}) s) q) p)"""


R2_SQL = f"""
best AS (SELECT * FROM (SELECT cs.*, row_number() OVER (PARTITION BY case_key ORDER BY score > 0 DESC, score DESC, idx) AS rn
                         FROM cs WHERE idx < 3) WHERE rn = 1),
tot AS (SELECT case_key, sum(tokens) AS tok FROM cs WHERE idx < 3 GROUP BY case_key),
s0 AS (SELECT c.*, {valid_dec('b.decision')} AS dec,
         COALESCE(b.rationale, 'Nenhuma justificativa válida produzida.') AS rat,
         COALESCE(b.pro, []) AS pro, COALESCE(b.con, []) AS con, CAST(t.tok AS BIGINT) AS tok, 0 AS retries,
         {i6q_sql('COALESCE(b.pro, [])', 'COALESCE(b.con, [])')} AS details
       FROM r2cases c LEFT JOIN best b USING (case_key) LEFT JOIN tot t USING (case_key)),
s0b AS (SELECT *, details = 'Qualidade de argumentos OK.' AS passed FROM s0),
{_step('s0b', 1).strip().rstrip(',')},
{_step('s1', 2).strip()},
r2 AS (SELECT *, {GATE_SQL} AS gate, {AMB_SQL} AS amb FROM s2),
r2out AS (SELECT case_id, case_key, 'R2' AS regime,
    CASE WHEN gate IS NOT NULL THEN gate.forced_decision
         ELSE COALESCE(amb, CASE WHEN passed THEN dec ELSE 'ESCALATE' END) END AS decision,
    CASE WHEN gate IS NOT NULL THEN gate.rationale
         ELSE (CASE WHEN amb IS NOT NULL THEN '[FORÇADO ' || amb || ' — AMBIGUITY GATE] ' ELSE '' END)
              || (CASE WHEN passed THEN rat ELSE '[FORÇADO ESCALATE — FALHA I6Q] ' || rat END) END AS rationale,
    CASE WHEN gate IS NOT NULL THEN [gate.gate_id] WHEN amb IS NOT NULL THEN ['K0_11_AMBIGUITY_GATE']
         ELSE CAST([] AS VARCHAR[]) END AS gates_triggered,
    CASE WHEN gate IS NOT NULL THEN true ELSE passed END AS i6q_passed,
    CASE WHEN gate IS NOT NULL THEN NULL ELSE {NONCE_SQL} END AS entropy_nonce,
    CASE WHEN gate IS NOT NULL THEN 0 ELSE tok END AS tokens_used,
    CASE WHEN gate IS NOT NULL THEN 0 ELSE retries END AS i6q_retries,
    gate IS NOT NULL AS hard_gate_override FROM r2)"""

R1_SQL = f"""
r1out AS (SELECT c.case_id, c.case_key, 'R1' AS regime, {valid_dec('p.decision')} AS decision,
    COALESCE(p.rationale, p.raw) AS rationale, CAST([] AS VARCHAR[]) AS gates_triggered, true AS i6q_passed,
    CAST(NULL AS VARCHAR) AS entropy_nonce, CAST(COALESCE(p.tokens, 0) AS BIGINT) AS tokens_used,
    0 AS i6q_retries, false AS hard_gate_override
  FROM r1cases c LEFT JOIN (SELECT * FROM cs WHERE idx = 0) p USING (case_key))"""

AUDIT_COLS = ("case_id, regime, decision, substr(sha256(case_id || ':' || COALESCE(entropy_nonce, '') || ':' "
              "|| decision), 1, 32) AS audit_nonce, gates_triggered, i6q_passed, "
              "CAST(tokens_used AS BIGINT) AS tokens_used, i6q_retries")

ROUTE_SQL = f"""(amount >= 50000 OR risk_score >= 0.5 OR (client_score > 0 AND client_score < 500))"""


_PROMPT_SQL = f"""
SELECT case_key, case_id, concat_ws(chr(10), 'CASO ID: ' || case_id, 'TIPO DE OPERAÇÃO: ' || operation_type,
  'VALOR: R$ ' || {money('amount')}, 'SCORE DE CRÉDITO: ' || client_score || '/1000',
  'RENDA MENSAL: R$ ' || {money('income')},
  'COMPROMETIMENTO DE RENDA: ' || {fixed('debt_to_income', 1, 100)} || '%',
  'SCORE DE RISCO INTERNO: ' || {fixed('risk_score', 2)} || '/1.00',
  CASE WHEN COALESCE(description, '') <> '' THEN 'DESCRIÇÃO: ' || description END,
  'CONTEXTO ADICIONAL:', '  - meses_inadimplencia_recente: ' || meses_inadimplencia_recente,
  '  - lista_coaf: ' || CASE WHEN lista_coaf THEN 'True' ELSE 'False' END) AS prompt
FROM cases"""


def _spark_audit(df, *extra):
    return df.select("case_id", "regime", "decision", gv.audit_hash().alias("audit_nonce"),
                     "gates_triggered", "i6q_passed", F.col("tokens_used").cast("long"),
                     "i6q_retries", *extra)


def _answers(t):
    return gv.answers_per_case(t.fx_respostas)


# ---- G1 / G2 ------------------------------------------------------------------------
@register("build_cases", f"""
SELECT 'TRAIN-CRED-' || CAST(id_cliente AS VARCHAR) AS case_id, id_cliente AS case_key,
  round(COALESCE(total_financiado, 0), 6) AS amount,
  CAST(least(greatest(CASE WHEN COALESCE(score_bureau, 0) = 0 THEN 600 ELSE score_bureau END, 0), 1000) AS INTEGER) AS client_score,
  round(COALESCE(renda_mensal, 0), 6) AS income,
  round(least(1.0, COALESCE(total_dividas / (renda_mensal + 1), 0) / 2.0 + CAST(COALESCE(atrasos_hist, 0) AS INTEGER) / 30.0), 6) AS risk_score,
  CAST(COALESCE(atrasos_hist, 0) AS INTEGER) AS meses_inadimplencia_recente,
  round(CASE WHEN renda_mensal > 0 AND total_financiado > 0 THEN round(total_financiado / renda_mensal, 4) ELSE 0.0 END, 6) AS debt_to_income
FROM ({_DERIVED_SQL}) c""")
def q_build_cases(t):
    """G1 + G2: credit rows to governed cases with debt-to-income."""
    c = gv.build_cases(credit_features_df(t))
    return finish(c.select("case_id", "case_key", "amount", "client_score", "income", "risk_score",
                           "meses_inadimplencia_recente", "debt_to_income"))


# ---- G4 -------------------------------------------------------------------------------
@register("hard_gates", f"""
WITH {CASES_SQL.strip()}
SELECT case_id, g.gate_id AS gate_id, g.forced_decision AS forced_decision, g.rationale AS rationale
FROM (SELECT case_id, {GATE_SQL} AS g FROM cases) x""")
def q_hard_gates(t):
    """First matching hard gate per case (null columns when none)."""
    c = gv.with_dti(t.fx_casos).withColumn("g", gv.hard_gates())
    return c.select("case_id", F.col("g.gate_id").alias("gate_id"),
                    F.col("g.forced_decision").alias("forced_decision"),
                    F.col("g.rationale").alias("rationale"))


# ---- G5 -------------------------------------------------------------------------------
@register("commit_reveal", f"""
SELECT case_id, {NONCE_SQL} AS nonce, sha256({NONCE_SQL}) AS nonce_hash,
       sha256({NONCE_SQL}) = sha256({NONCE_SQL}) AS verified FROM fx_casos""")
def q_commit_reveal(t):
    """Seeded nonce, its sha256 commitment and the reveal check."""
    c = t.fx_casos.withColumn("nonce", gv.commit_nonce())
    c = c.withColumn("nonce_hash", F.sha2("nonce", 256))
    return c.select("case_id", "nonce", "nonce_hash", gv.reveal_ok("nonce", "nonce_hash").alias("verified"))


# ---- G6 / G7 / G8 ---------------------------------------------------------------------
@register("parse_candidate", f"""
WITH {PARSED_SQL.strip()}
SELECT case_key, idx, nonempty, decision, rationale, pro AS pro_arguments, con AS con_arguments,
       confidence, round(score, 6) AS score, tokens FROM cs""")
def q_parse_candidate(t):
    """G6 + G7: tolerant JSON parse of each response and its quality score."""
    s = gv.scored_candidates(t.fx_candidatos)
    return finish(s.select("case_key", "idx", F.col("p.nonempty").alias("nonempty"),
                           F.col("p.decision").alias("decision"),
                           F.col("p.rationale").alias("rationale"),
                           F.col("p.pro_arguments").alias("pro_arguments"),
                           F.col("p.con_arguments").alias("con_arguments"),
                           F.col("p.confidence").alias("confidence"), "score", "tokens"))


@register("i6q_check", f"""
WITH {PARSED_SQL.strip()}
SELECT case_key, idx, {i6q_sql('pro', 'con')} = 'Qualidade de argumentos OK.' AS passed,
       {i6q_sql('pro', 'con')} AS details FROM cs""")
def q_i6q_check(t):
    """Argument quality gate per candidate."""
    s = gv.scored_candidates(t.fx_candidatos)
    chk = gv.i6q_check(F.col("p.pro_arguments"), F.col("p.con_arguments"))
    return s.select("case_key", "idx", chk["passed"].alias("passed"), chk["details"].alias("details"))


@register("best_candidate", f"""
WITH {PARSED_SQL.strip()}
SELECT case_key, idx AS best_idx FROM (
  SELECT case_key, idx, row_number() OVER (PARTITION BY case_key ORDER BY score > 0 DESC, score DESC, idx) AS rn
  FROM cs) WHERE rn = 1""")
def q_best_candidate(t):
    """Highest-scoring candidate (> 0), first index on ties, else 0."""
    from ..operators.windows import best_candidate
    return best_candidate(gv.scored_candidates(t.fx_candidatos))


# ---- G9 -------------------------------------------------------------------------------
@register("ambiguity_gate", f"SELECT case_id, {AMB_SQL} AS override FROM fx_casos")
def q_ambiguity_gate(t):
    """Completeness / risk override after the model call."""
    return t.fx_casos.select("case_id", gv.ambiguity_gate().alias("override"))


# ---- G10 / G11 / G14 / G15 / G16 ------------------------------------------------------
@register("r1_decide", f"""
WITH {CASES_SQL.strip()}, {ANSWERS_SQL.strip()}, r1cases AS (SELECT * FROM cases), {R1_SQL.strip()}
SELECT {AUDIT_COLS}, rationale FROM r1out""")
def q_r1_decide(t):
    """Text-only regime over every case."""
    r = gv.r1_decide(t.fx_casos, _answers(t))
    return _spark_audit(r, "rationale")


@register("r2_decide", f"""
WITH {CASES_SQL.strip()}, {ANSWERS_SQL.strip()}, r2cases AS (SELECT * FROM cases), {R2_SQL.strip()}
SELECT {AUDIT_COLS}, rationale, hard_gate_override FROM r2out""")
def q_r2_decide(t):
    """G11 + G12 + W6 + G15: mechanical regime with gates, candidates,
    I6Q retries and the ambiguity override."""
    r = gv.r2_decide(t.fx_casos, _answers(t))
    return _spark_audit(r, "rationale", "hard_gate_override")


_R3_SQL = f"""
WITH {CASES_SQL.strip()}, {ANSWERS_SQL.strip()},
r2cases AS (SELECT * FROM cases WHERE {ROUTE_SQL}),
r1cases AS (SELECT * FROM cases WHERE NOT {ROUTE_SQL}),
{R2_SQL.strip()}, {R1_SQL.strip()},
r3 AS (SELECT * REPLACE ('R3' AS regime), 'R2' AS routed FROM r2out
       UNION ALL SELECT * REPLACE ('R3' AS regime), 'R1' AS routed FROM r1out)"""


def _r3(t):
    return gv.r3_decide(t.fx_casos, _answers(t))


@register("r3_route", _R3_SQL + f"""
SELECT {AUDIT_COLS}, routed AS adaptive_routed_to FROM r3""")
def q_r3_route(t):
    """Adaptive routing to R2 / R1, relabelled R3."""
    return _spark_audit(_r3(t), "adaptive_routed_to")


@register("r3_reasons", f"""
WITH {CASES_SQL.strip()}
SELECT case_id, list_filter([
  CASE WHEN amount >= 50000 THEN 'valor R$ ' || {money('amount')} || ' >= limite R$ 50,000.00' END,
  CASE WHEN risk_score >= 0.5 THEN 'score de risco ' || {fixed('risk_score', 2)} || ' >= limite 0.50' END,
  CASE WHEN client_score > 0 AND client_score < 500 THEN 'score de crédito ' || client_score || ' < limite 500' END],
  lambda x: x IS NOT NULL) AS adaptive_reasons FROM cases""")
def q_r3_reasons(t):
    """Routing reason texts."""
    return t.fx_casos.select("case_id", gv.r3_reasons().alias("adaptive_reasons"))


@register("audit_record", _R3_SQL + """
SELECT case_id, regime, decision, substr(sha256(case_id || ':' || COALESCE(entropy_nonce, '') || ':' || decision), 1, 32) AS audit_nonce,
       gates_triggered, hard_gate_override AND len(gates_triggered) > 0 AS hard_gate_override, i6q_passed,
       CAST(tokens_used AS BIGINT) AS tokens_used FROM r3""")
def q_audit_record(t):
    """G15 + G16: flat audit projection of the R3 results."""
    return gv.audit_record(_r3(t))


@register("decision_distribution", _R3_SQL + """
SELECT decision, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM r3 GROUP BY decision""")
def q_decision_distribution(t):
    """Decisions per kind and total."""
    from pyspark.sql import Window
    d = _r3(t).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    # at most 4 decision kinds: a window over this tiny result is safe
    return d.withColumn("total", F.sum("n").over(Window.partitionBy()).cast("long"))


@register("head_cases", """
SELECT case_id, case_key, amount FROM fx_casos ORDER BY case_key LIMIT 200""")
def q_head_cases(t):
    """K3: first 200 cases by key (the governed-sample feature; a top-k)."""
    return finish(head_cases(t.fx_casos.select("case_id", "case_key", "amount"), "case_key", 200))


@register("case_prompt", f"""
WITH {CASES_SQL.strip()}
SELECT case_id, prompt FROM ({_PROMPT_SQL}) p""")
def q_case_prompt(t):
    """Structured case text."""
    return gv.with_dti(t.fx_casos).select("case_id", gv.case_prompt().alias("prompt"))


def _feedback(details: str) -> str:
    head, tail = gv.TXT_RETRY.split("%s")
    q = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"({q(head)} || {details} || {q(tail)})"


@register("retry_prompt", f"""
WITH {CASES_SQL.strip()}, {ANSWERS_SQL.strip()}, r2cases AS (SELECT * FROM cases), {R2_SQL.strip()}
SELECT case_id, {_feedback('details')} AS feedback FROM r2 WHERE gate IS NULL AND retries > 0""")
def q_retry_prompt(t):
    """I6Q feedback message for R2 cases that needed a retry."""
    r = gv.r2_decide(t.fx_casos, _answers(t))
    return r.filter(F.col("i6q_retries") > 0).select(
        "case_id", gv.retry_prompt("i6q_details").alias("feedback"))


# a credit input whose cases reach every gate and route: most amounts and
# commitments are scaled down, by client
_GOVERNED = {
    "total_financiado": "total_financiado * CASE id_cliente % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 ELSE 0.02 END",
    "comprometimento_renda": "comprometimento_renda * CASE id_cliente % 3 WHEN 0 THEN 0.2 ELSE 0.05 END",
    "renda_mensal": "renda_mensal * CASE WHEN id_cliente % 5 < 2 THEN 40.0 ELSE 1.0 END",
}


def governed_input(t):
    return credit_features_df(t).withColumns({c: F.expr(e) for c, e in _GOVERNED.items()})


def canned_responder(texts: list[str]):
    """A deterministic provider: the answer depends on how long the last
    message is."""
    return lambda messages: texts[len(messages[-1]["content"]) % len(texts)]


def _shape(text: str) -> str:
    return f"length({text}) % 6"


def _govern_sql() -> str:
    from ..operators.prompts import CEFL_USER_PREFIX
    from ..sources.fixtures import answer_texts
    shapes = ", ".join("({}, '{}')".format(i, x.replace("'", "''"))
                       for i, x in enumerate(answer_texts()))
    prefix = "'" + CEFL_USER_PREFIX.replace("\n", "' || chr(10) || '") + "'"
    rep = ", ".join(f"{e} AS {c}" for c, e in _GOVERNED.items())
    retry = {r: (f"csh ans", f"ON ans.sh = {_shape(_feedback('s.details'))}") for r in (1, 2)}
    r2 = R2_SQL.replace(_step("s0b", 1).strip().rstrip(","), _step("s0b", 1, *retry[1]).strip()) \
        .replace(_step("s1", 2).strip(), _step("s1", 2, *retry[2]).strip())
    return f"""
WITH cred AS (SELECT * REPLACE ({rep}) FROM ({_DERIVED_SQL}) c),
base AS (SELECT 'TRAIN-CRED-' || CAST(id_cliente AS VARCHAR) AS case_id, id_cliente AS case_key,
  'credit_approval' AS operation_type, CAST(COALESCE(total_financiado, 0) AS DOUBLE) AS amount,
  CAST(least(greatest(CASE WHEN COALESCE(score_bureau, 0) = 0 THEN 600 ELSE score_bureau END, 0), 1000) AS INTEGER) AS client_score,
  CAST(COALESCE(renda_mensal, 0) AS DOUBLE) AS income,
  least(1.0, COALESCE(comprometimento_renda, 0) / 2.0 + CAST(COALESCE(atrasos_hist, 0) AS INTEGER) / 30.0) AS risk_score,
  CAST(COALESCE(atrasos_hist, 0) AS INTEGER) AS meses_inadimplencia_recente, false AS lista_coaf,
  CAST(NULL AS VARCHAR) AS description, CAST(COALESCE(score_bureau, 600) AS INTEGER) AS score_bureau FROM cred),
cases AS (SELECT *, CASE WHEN income > 0 AND amount > 0 THEN round(amount / income, 4) ELSE 0.0 END AS debt_to_income
          FROM base),
prompts AS ({_PROMPT_SQL.strip()}),
shapes(sh, raw) AS (VALUES {shapes}),
{parsed_sql('shapes', 'sh').strip().replace('cs AS (', 'csh AS (')},
r1cases AS (SELECT * FROM cases WHERE NOT {ROUTE_SQL}),
r2cases AS (SELECT * FROM cases WHERE {ROUTE_SQL}),
cs AS (SELECT case_key, CAST(i AS INTEGER) AS idx, csh.* FROM (
         SELECT case_key, i, CASE WHEN {ROUTE_SQL} THEN {_shape(prefix + ' || prompt')}
                             ELSE {_shape('prompt')} END AS k
         FROM cases JOIN prompts USING (case_key), (SELECT unnest(range(0, 3)) AS i) n) q
       JOIN csh ON csh.sh = q.k),
{r2.strip()}, {R1_SQL.strip()},
r3 AS (SELECT case_key, decision, entropy_nonce, case_id FROM r2out
       UNION ALL SELECT case_key, decision, entropy_nonce, case_id FROM r1out)
SELECT case_key AS id_cliente, 'R3' AS regime, decision AS decisao,
       substr(sha256(case_id || ':' || COALESCE(entropy_nonce, '') || ':' || decision), 1, 32) AS audit_nonce,
       score_bureau, 0 AS inadimplente
FROM r3 JOIN (SELECT case_key, score_bureau FROM base) b USING (case_key)"""


@register("govern_table", _govern_sql())
def q_govern_table(t):
    """G17 + G18 + G1 + G13: the credit table governed by R3 with a canned
    provider; gated cases are not asked, failing ones are asked again with
    the feedback."""
    from ..sources.fixtures import answer_texts
    return gv.govern_table(governed_input(t), "R3", canned_responder(answer_texts()))


# ---- L1 - L6 -----------------------------------------------------------------------
@register("split_system", """
SELECT c.conv_id, s.system_text FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system_text
           FROM conversations WHERE role = 'system' AND COALESCE(text, '') <> '' GROUP BY conv_id) s
USING (conv_id)""")
def q_split_system(t):
    """L1: system parts per conversation (blank-line joined, null if none)."""
    system, _ = pr.split_system(t.conversations)
    return system


@register("split_turns", """
SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'""")
def q_split_turns(t):
    """L1: the non-system turns, kept as rows in order."""
    _, turns = pr.split_system(t.conversations)
    return turns


@register("last_user_echo", """
SELECT conv_id, '[mock] ' || COALESCE(arg_max(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn), '') AS content
FROM conversations GROUP BY conv_id""")
def q_last_user_echo(t):
    """L3: offline echo response per conversation."""
    return pr.last_user_echo(t.conversations)


_TOK = "greatest(1, CAST(floor({x} * 4 / 3) AS INTEGER))"


@register("token_estimate", f"""
WITH p AS (SELECT conv_id, sum({w('text')}) AS words FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, '[mock] ' || COALESCE(arg_max(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn), '') AS content
      FROM conversations GROUP BY conv_id)
SELECT conv_id, {_TOK.format(x='words')} AS prompt_tokens, {_TOK.format(x=w('content'))} AS completion_tokens,
       {_TOK.format(x='words')} + {_TOK.format(x=w('content'))} AS total_tokens
FROM p JOIN e USING (conv_id)""")
def q_token_estimate(t):
    """L4: prompt / completion / total token estimates per conversation."""
    c = t.conversations
    words = c.groupBy("conv_id").agg(F.sum(pr.word_count("text")).alias("words"))
    e = pr.last_user_echo(c)
    j = words.join(e, "conv_id")
    pt = F.greatest(F.lit(1), F.floor(F.col("words") * 4 / 3).cast("int"))
    ct = pr.token_estimate("content")
    return j.select("conv_id", pt.alias("prompt_tokens"), ct.alias("completion_tokens"),
                    (pt + ct).alias("total_tokens"))


@register("token_cost", f"""
WITH p AS (SELECT conv_id, sum({w('text')}) AS words FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, '[mock] ' || COALESCE(arg_max(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn), '') AS content
      FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, {_TOK.format(x='words')} AS prompt_tokens, {_TOK.format(x=w('content'))} AS completion_tokens,
        ['gpt-4o', 'gpt-4o-mini', 'gpt-4-turbo', 'gpt-3.5-turbo', 'local-model'][conv_id % 5 + 1] AS model
      FROM p JOIN e USING (conv_id)),
pr AS (SELECT * FROM (VALUES ('gpt-4o', 2.50, 10.00), ('gpt-4o-mini', 0.15, 0.60), ('gpt-4-turbo', 10.00, 30.00),
                      ('gpt-3.5-turbo', 0.50, 1.50)) v(model, usd_in, usd_out))
SELECT conv_id, model, prompt_tokens, completion_tokens,
       round(COALESCE(prompt_tokens / 1e6 * usd_in + completion_tokens / 1e6 * usd_out, 0.0), 9) AS cost_usd
FROM x LEFT JOIN pr USING (model)""")
def q_token_cost(t):
    """USD cost per conversation from the model price table."""
    tok = q_token_estimate(t)
    models = F.array(*[F.lit(m) for m, _, _ in pr.PRICE_PER_MILLION], F.lit("local-model"))
    tok = tok.withColumn("model", F.element_at(models, (F.col("conv_id") % 5 + 1).cast("int")))
    out = pr.token_cost(tok).select("conv_id", "model", "prompt_tokens", "completion_tokens",
                                    F.round("cost_usd", 9).alias("cost_usd"))
    return out


@register("build_messages", """
WITH s AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system
           FROM conversations WHERE role = 'system' AND COALESCE(text, '') <> '' GROUP BY conv_id),
u AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS prompt,
             CASE WHEN count(*) FILTER (WHERE role = 'user') > 1 THEN arg_min(text, turn) FILTER (WHERE role = 'user') END AS context
      FROM conversations GROUP BY conv_id)
SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS name,
  list_filter([CASE WHEN COALESCE(system, '') <> '' THEN {'role': 'system', 'content': system} END,
               {'role': 'user', 'content': CASE WHEN COALESCE(context, '') <> ''
                  THEN '## Contexto' || chr(10) || context || chr(10) || chr(10) || '## Tarefa' || chr(10) || prompt
                  ELSE prompt END}], lambda m: m IS NOT NULL) AS messages
FROM u LEFT JOIN s USING (conv_id)""")
def q_build_messages(t):
    """L2: messages of prompt tasks built from conversations (stand-in tasks:
    last user text as prompt, first user text as context when there are
    several, system parts as system)."""
    return task_table(t).select("name", "messages")


def task_table(t):
    c = t.conversations
    system, _ = pr.split_system(c)
    u = c.filter(F.col("role") == "user").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("prompt"),
        F.when(F.count(F.lit(1)) > 1, F.min_by("text", "turn")).alias("context"))
    tasks = u.join(system, "conv_id", "left").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("name"), "prompt",
        F.col("system_text").alias("system"), "context",
        F.array(F.lit("conversations")).alias("tags"))
    return pr.build_messages(tasks)


@register("run_prompts", f"""
WITH s AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system
           FROM conversations WHERE role = 'system' AND COALESCE(text, '') <> '' GROUP BY conv_id),
u AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS prompt,
             CASE WHEN count(*) FILTER (WHERE role = 'user') > 1 THEN arg_min(text, turn) FILTER (WHERE role = 'user') END AS context
      FROM conversations WHERE role = 'user' GROUP BY conv_id),
m AS (SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS name, COALESCE(system, '') AS system,
        CASE WHEN COALESCE(context, '') <> ''
             THEN '## Contexto' || chr(10) || context || chr(10) || chr(10) || '## Tarefa' || chr(10) || prompt
             ELSE prompt END AS usr FROM u LEFT JOIN s USING (conv_id))
SELECT name, '[mock] ' || usr AS content, true AS success,
  CAST({_TOK.format(x='(' + w('system') + ' + ' + w('usr') + ')')}
       + {_TOK.format(x='(1 + ' + w('usr') + ')')} AS BIGINT) AS total_tokens,
  0 AS retries, CAST(NULL AS VARCHAR) AS error, ['conversations'] AS tags FROM m""")
def q_run_prompts(t):
    """L6 + U1: every task through the registered offline provider with
    retries (partition-parallel mapInPandas)."""
    tasks = task_table(t).drop("messages")
    return pr.run_prompts(tasks, pr.create({"provider": "mock"}), max_retries=2)
