"""The scoring rules as SQL functions.

``CREATE TEMPORARY FUNCTION ... RETURN <expr>`` functions are SQL UDFs that
Catalyst inlines (they constant-fold and stay inside whole-stage codegen), so
SQL users get the same plans as the DataFrame builders in
:mod:`riskloom.functions.scoring`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scoring import FRAUD_LEVELS, POLICY_PROFILES, RISK_BANDS



def _steps(column: str, cases, rest: str, op: str) -> str:
    """CASE text over (limit, label) pairs of the rules in ``scoring``."""
    when = " ".join(f"WHEN {column} {op} {limit} THEN '{label}'" for limit, label in cases)
    return f"CASE {when} ELSE '{rest}' END"


def _policy(profile: str) -> str:
    hi, mid, _, words = POLICY_PROFILES[profile]
    return _steps("score", [(hi, words[0]), (mid, words[1])], words[2], ">=")


_CRIT, _HIGH, _MED, _LOW = FRAUD_LEVELS["pt"]

#: name -> (arguments, result type, body); limits and labels are scoring's own
SQL_FUNCTIONS = {
    # P19
    "rl_to_score": ("p DOUBLE", "INT",
                    "CASE WHEN p IS NULL THEN NULL ELSE CAST(LEAST(GREATEST(850 - 550 * p, 300), 850) AS INT) END"),
    # P20
    "rl_risk_band": ("p DOUBLE", "STRING", _steps("p", RISK_BANDS, "D", "<")),
    # P21 (REST profile)
    "rl_policy_decision": ("score INT", "STRING", _policy("rest")),
    # P22
    "rl_suggested_limit": ("amount DOUBLE, score INT", "DOUBLE",
                           "CASE WHEN score < 400 THEN 0.0 ELSE amount * score / 1000.0 END"),
    # P24
    "rl_fraud_band": ("s DOUBLE", "STRING", _steps(
        "s", [(0.8, _CRIT), (0.5, _HIGH), (0.2, _MED)], _LOW, ">=")),
}


def register_functions(spark: SparkSession, replace: bool = True) -> list[str]:
    """Create the temporary SQL functions in this session; returns names."""
    names = []
    for name, (args, ret, body) in SQL_FUNCTIONS.items():
        verb = "CREATE OR REPLACE TEMPORARY FUNCTION" if replace else "CREATE TEMPORARY FUNCTION"
        spark.sql(f"{verb} {name}({args}) RETURNS {ret} RETURN {body}")
        names.append(name)
    return names
