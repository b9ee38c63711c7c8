"""Registered queries: statistics and drift reports (A2-A21, J4, J5, D1-D12,
W3, S9).

Drift sides (FIXTURES.md): reference = lineitem shipped before 1998-06-01,
current = on/after.  Numeric l_extendedprice, l_quantity, l_discount;
categorical l_returnflag, l_linestatus (2 levels: the Yates case).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import stats as st
from ..operators.windows import metric_decay
from ..session import scratch_path
from ..sources.fixtures import AS_OF_FRAUDE
from .catalog import finish, register

SPLIT = "1998-06-01 00:00:00"
NUM = ["l_extendedprice", "l_quantity", "l_discount"]
CAT = ["l_returnflag", "l_linestatus"]


def sides(t):
    li = t.lineitem.select(*NUM, *CAT, "l_shipdate")
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    return li.filter(F.col("l_shipdate") < cut), li.filter(F.col("l_shipdate") >= cut)


# ---- shared DuckDB text ------------------------------------------------------
_PROBS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
_LONG = f"""
src AS (SELECT @IS_REF@ AS is_ref, l_extendedprice, l_quantity, l_discount,
               l_returnflag, l_linestatus FROM lineitem),
lng AS (SELECT is_ref, feature, value FROM (UNPIVOT (SELECT is_ref, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
          CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount FROM src)
        ON l_extendedprice, l_quantity, l_discount INTO NAME feature VALUE value) u WHERE NOT isnan(value)),
lcat AS (SELECT is_ref, feature, category FROM (UNPIVOT (SELECT is_ref, l_returnflag, l_linestatus FROM src)
        ON l_returnflag, l_linestatus INTO NAME feature VALUE category) u),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_PROBS}))) AS e
          FROM lng WHERE is_ref GROUP BY feature),
binned AS (SELECT l.is_ref, l.feature,
             CAST(CASE WHEN l.value = e[len(e)] THEN len(e) - 2
                  ELSE len(list_filter(e, lambda x: x <= l.value)) - 1 END AS INTEGER) AS bin
           FROM lng l JOIN edges USING (feature)
           WHERE len(e) >= 2 AND l.value >= e[1] AND l.value <= e[len(e)]),
allbins AS (SELECT feature, CAST(unnest(range(0, len(e) - 1)) AS INTEGER) AS bin FROM edges WHERE len(e) >= 2),
bc AS (SELECT a.feature, a.bin,
         (SELECT count(*) FROM binned b WHERE b.is_ref AND b.feature = a.feature AND b.bin = a.bin) AS n_ref,
         (SELECT count(*) FROM binned b WHERE NOT b.is_ref AND b.feature = a.feature AND b.bin = a.bin) AS n_cur
       FROM allbins a),
psi AS (SELECT feature,
          sum((greatest(n_cur / t_cur, 1e-6) - greatest(n_ref / t_ref, 1e-6))
              * ln(greatest(n_cur / t_cur, 1e-6) / greatest(n_ref / t_ref, 1e-6))) AS psi
        FROM bc JOIN (SELECT feature, sum(n_ref) AS t_ref, sum(n_cur) AS t_cur FROM bc GROUP BY feature) t
        USING (feature) GROUP BY feature),
ksg AS (SELECT feature, value, sum(CASE WHEN is_ref THEN 1 ELSE 0 END) AS a,
               sum(CASE WHEN is_ref THEN 0 ELSE 1 END) AS b FROM lng GROUP BY feature, value),
ks AS (SELECT feature, max(abs(ca / ta - cb / tb)) AS ks_statistic FROM (
         SELECT feature, sum(a) OVER w AS ca, sum(a) OVER (PARTITION BY feature) AS ta,
                sum(b) OVER w AS cb, sum(b) OVER (PARTITION BY feature) AS tb
         FROM ksg WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)) x
       GROUP BY feature),
cc AS (SELECT feature, category, CAST(sum(CASE WHEN is_ref THEN 1 ELSE 0 END) AS BIGINT) AS n_ref,
              CAST(sum(CASE WHEN is_ref THEN 0 ELSE 1 END) AS BIGINT) AS n_cur FROM lcat GROUP BY feature, category),
chi AS (SELECT feature,
          sum(CASE WHEN k = 2 THEN
                (n_ref + sign(e0 - n_ref) * least(0.5, abs(e0 - n_ref)) - e0) ** 2 / e0
              + (n_cur + sign(e1 - n_cur) * least(0.5, abs(e1 - n_cur)) - e1) ** 2 / e1
              ELSE (n_ref - e0) ** 2 / e0 + (n_cur - e1) ** 2 / e1 END) AS chi2_statistic
        FROM (SELECT cc.*, t.k, t.r0 * (n_ref + n_cur) / (t.r0 + t.r1) AS e0,
                     t.r1 * (n_ref + n_cur) / (t.r0 + t.r1) AS e1
              FROM cc JOIN (SELECT feature, sum(n_ref) AS r0, sum(n_cur) AS r1, count(*) AS k
                            FROM cc GROUP BY feature) t USING (feature)) z
        GROUP BY feature)"""


BY_DATE = f"l_shipdate < TIMESTAMP '{SPLIT}'"
BY_QUANTITY = "l_quantity <= 30"


def _with_long(body: str, is_ref: str = BY_DATE) -> str:
    return f"WITH {_LONG.strip()}\n{body}".replace("@IS_REF@", is_ref)


# KS p-value (limiting distribution, Stephens' factor) of d, n, m in SQL
def _ks_p(d: str, n: str, m: str) -> str:
    en = f"sqrt(CAST({n} AS DOUBLE) * {m} / ({n} + {m}))"
    x = f"(({en} + 0.12 + 0.11 / {en}) * {d})"
    low = (f"1.0 - sqrt(2 * pi()) / {x} * list_sum(list_transform(range(1, 21), lambda k: "
           f"exp(-((2 * k - 1) * (2 * k - 1)) * pi() * pi() / (8 * {x} * {x}))))")
    high = (f"list_sum(list_transform(range(1, 21), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 "
            f"ELSE -2.0 END) * exp(-2.0 * k * k * {x} * {x})))")
    return (f"CASE WHEN {x} <= 1e-17 THEN 1.0 WHEN {x} < 1.18 THEN greatest({low}, 0.0) "
            f"ELSE least(greatest({high}, 0.0), 1.0) END")


#: the reports whose SQL states the limit form at every size
LIMIT_P = dr.DriftThresholds(ks_exact_rows=0)


def _level(psi: str, p: str) -> str:
    return (f"CASE WHEN {psi} IS NULL OR {psi} > 0.5 THEN 'critico' WHEN {psi} > 0.2 THEN 'alerta' "
            f"WHEN {p} < 0.05 THEN 'atencao' ELSE 'ok' END")


# chi-square p with 1 degree of freedom: the series of the incomplete gamma
_CHI2_P1 = ("1 - sqrt(chi2_statistic / 2) * exp(-chi2_statistic / 2) * list_sum(list_transform("
            "range(0, 150), lambda i: exp(i * ln(chi2_statistic / 2) - lgamma(i + 1.5))))")

# the report rows of D1: psi and ks from above, chi-square p for 2 degrees of
# freedom (closed form) and 1 degree (series)
_REPORT_SQL = f"""
sz AS (SELECT feature, count(*) FILTER (is_ref) AS n, count(*) FILTER (NOT is_ref) AS m FROM lng GROUP BY feature),
nrep AS (SELECT feature, round(psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic,
           round({_ks_p('ks_statistic', 'n', 'm')}, 6) AS ks_p_value, psi AS psi_exact,
           {_ks_p('ks_statistic', 'n', 'm')} AS p_exact
         FROM psi JOIN ks USING (feature) JOIN sz USING (feature)),
nlev AS (SELECT *, {_level('psi_exact', 'p_exact')} AS nivel FROM nrep),
crep AS (SELECT feature, chi2_statistic AS x,
           CASE WHEN k = 3 THEN exp(-chi2_statistic / 2) WHEN chi2_statistic > 60 THEN 0.0
                WHEN chi2_statistic <= 0 THEN 1.0 ELSE {_CHI2_P1} END AS p
         FROM chi JOIN (SELECT feature, count(*) AS k FROM cc GROUP BY feature) kk USING (feature)),
summ AS (SELECT round(avg(psi), 6) AS psi, round(avg(psi), 6) > 0.2 AS drift_detectado,
           CASE max(CASE nivel WHEN 'critico' THEN 3 WHEN 'alerta' THEN 2 ELSE 0 END)
             WHEN 3 THEN 'critico' WHEN 2 THEN 'alerta' ELSE 'ok' END AS nivel FROM nlev),
report AS (
SELECT feature, 'numerica' AS tipo, psi, ks_statistic, ks_p_value, CAST(NULL AS DOUBLE) AS chi2_statistic,
       CAST(NULL AS DOUBLE) AS chi2_p_value, CAST(NULL AS BOOLEAN) AS drift_detectado, nivel FROM nlev
UNION ALL
SELECT feature, 'categorica', NULL, NULL, NULL, round(x, 6), round(p, 6), p < 0.05,
       CASE WHEN p < 0.05 THEN 'critico' ELSE 'ok' END FROM crep
UNION ALL
SELECT '__resumo__', 'resumo', psi, NULL, NULL, NULL, NULL, drift_detectado, nivel FROM summ)"""


# ---- A2 / A3 / A4 / A5 -------------------------------------------------------
@register("value_shares", _with_long("""
SELECT feature, category, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6) AS share
FROM lcat WHERE is_ref GROUP BY feature, category"""))
def q_value_shares(t):
    """A2: category shares of non-null values (reference side)."""
    ref, _ = sides(t)
    return finish(st.value_shares(st.to_long_cat(ref, CAT)))


@register("quantile_bins", _with_long("""
SELECT feature, list_transform(e, lambda x: round(x, 6)) AS edges FROM edges"""))
def q_quantile_bins(t):
    """A3: de-duplicated decile edges per feature (exact, distributed)."""
    ref, _ = sides(t)
    return finish(st.quantile_edges(st.to_long(ref, NUM)))


@register("histogram", _with_long("""
SELECT feature, bin, count(*) AS n FROM binned WHERE NOT is_ref GROUP BY feature, bin"""))
def q_histogram(t):
    """A4: current values binned by reference edges (outside dropped)."""
    ref, cur = sides(t)
    return st.histogram(st.to_long(cur, NUM), st.quantile_edges(st.to_long(ref, NUM)))


@register("baseline_stats", _with_long("""
SELECT feature, 'numerica' AS tipo, bin AS pos, round(e[bin + 1], 6) AS lo, round(e[bin + 2], 6) AS hi,
       CAST(NULL AS VARCHAR) AS categoria, round(n_ref / t, 6) AS proporcao, round(mean, 6) AS mean,
       round(CASE WHEN sd > 0 THEN sd ELSE 1e-6 END, 6) AS std
FROM edges JOIN bc USING (feature)
JOIN (SELECT feature, sum(n_ref) AS t FROM bc GROUP BY feature) tt USING (feature)
JOIN (SELECT feature, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM lng WHERE is_ref
      GROUP BY feature) m USING (feature)
WHERE len(e) >= 2 AND n >= 10
UNION ALL
SELECT feature, 'categorica', NULL, NULL, NULL, category,
       round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6), NULL, NULL
FROM lcat WHERE is_ref GROUP BY feature, category"""))
def q_baseline_stats(t):
    """A5: reference statistics in long form (bins with shares, mean, std;
    categories with shares)."""
    ref, _ = sides(t)
    return finish(st.baseline_stats(ref, NUM, CAT))


# ---- A6 / A8 / A9 / J4 / J5 / D1 ---------------------------------------------
@register("psi_raw", _with_long("SELECT feature, round(psi, 6) AS psi FROM psi"))
def q_psi_raw(t):
    """Raw PSI per numeric feature (reference deciles, no renormalising)."""
    ref, cur = sides(t)
    return finish(st.psi_raw(st.to_long(ref, NUM), st.to_long(cur, NUM)).select("feature", "psi"))


@register("ks_two_sample", _with_long(
    "SELECT feature, round(ks_statistic, 6) AS ks_statistic FROM ks"))
def q_ks_two_sample(t):
    """Two-sample KS statistic per feature via distributed running sums."""
    ref, cur = sides(t)
    return finish(st.ks_two_sample(st.to_long(ref, NUM), st.to_long(cur, NUM))
                  .select("feature", "ks_statistic"))


@register("chi2_two_sample", _with_long(
    "SELECT feature, round(chi2_statistic, 6) AS chi2_statistic FROM chi"))
def q_chi2(t):
    """Chi-square statistic of the 2 x k table (Yates when k = 2)."""
    ref, cur = sides(t)
    return finish(st.chi2_two_sample(st.to_long_cat(ref, CAT), st.to_long_cat(cur, CAT))
                  .select("feature", "chi2_statistic"))


@register("category_align", _with_long("SELECT feature, category, n_ref, n_cur FROM cc"))
def q_category_align(t):
    """Full outer join of category counts, missing -> 0."""
    ref, cur = sides(t)
    return st.category_align(st.to_long_cat(ref, CAT), st.to_long_cat(cur, CAT))


@register("feature_drift", _with_long("""
SELECT feature, round(psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic
FROM psi JOIN ks USING (feature)"""))
def q_feature_drift(t):
    """D1 numeric part without p-values (oracle-checkable)."""
    ref, cur = sides(t)
    return finish(dr.numeric_drift(ref, cur, NUM, with_p=False).select("feature", "psi",
                                                                      "ks_statistic"))


@register("feature_drift_report", _with_long(f",{_REPORT_SQL}\nSELECT * FROM report".lstrip("\n")))
def q_feature_drift_report(t):
    """D1 + D2 + A18: full feature drift report with p-values and levels."""
    ref, cur = sides(t)
    return dr.feature_drift(ref, cur, NUM, CAT, LIMIT_P)


@register("drift_summary", _with_long(f""",{_REPORT_SQL}
SELECT feature, psi, drift_detectado, nivel FROM report WHERE feature = '__resumo__'"""))
def q_drift_summary(t):
    """A18 + D2: mean PSI over numeric features, drift flag, worst level."""
    ref, cur = sides(t)
    rows = dr.numeric_drift(ref, cur, NUM, LIMIT_P).withColumn("psi", F.round("psi", 6))
    return dr.drift_summary(rows).select("feature", "psi", "drift_detectado", "nivel")


# ---- A8 exact p-value, approximate A3 / A5 / A8 ------------------------------
@register("ks_exact_p", """
WITH RECURSIVE v AS (SELECT CAST(c_nationkey AS VARCHAR) AS feature, c_acctbal AS x,
    CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS a, CAST(c_mktsegment <> 'BUILDING' AS INTEGER) AS b
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_acctbal IS NOT NULL),
g AS (SELECT feature, x, sum(a) AS a, sum(b) AS b FROM v GROUP BY ALL),
c AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS n, sum(b) OVER p AS m
  FROM g WINDOW w AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING),
                p AS (PARTITION BY feature)),
f AS (SELECT feature, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m,
        CAST(max(abs(ca * m - cb * n)) AS BIGINT) AS h FROM c GROUP BY feature
      HAVING max(n) >= 5 AND max(m) >= 5),
u AS (SELECT feature, n, m, h, CAST(0 AS BIGINT) AS i, list_transform(range(0, m + 1),
        lambda j: CASE WHEN j * n < h THEN 1.0::DOUBLE ELSE 0 END) AS u FROM f
  UNION ALL
  SELECT feature, n, m, h, i + 1, list_transform(range(0, m + 1), lambda j:
    CASE WHEN abs((i + 1) * m - j * n) >= h THEN 0.0::DOUBLE ELSE (i + 1) / (i + 1 + m) *
      list_sum(list_transform(range(0, j + 1), lambda k:
        CASE WHEN abs((i + 1) * m - k * n) < h THEN u[k + 1] ELSE 0 END)) END)
  FROM u WHERE i < n)
SELECT feature, n AS n_ref, m AS n_cur, round(h / (n * m), 6) AS ks_statistic,
       round(1 - u[m + 1], 6) AS ks_p_value, 1 - u[m + 1] < 0.05 AS drift
FROM u WHERE i = n""")
def q_ks_exact_p(t):
    """A8 with exact p-values: account balances of two market segments, one
    test per nation, samples small enough for the lattice count."""
    c = t.customer.select(F.col("c_nationkey").cast("string").alias("feature"),
                          F.col("c_acctbal").cast("double").alias("value"), "c_mktsegment")
    side = lambda s: c.filter(F.col("c_mktsegment") == s).drop("c_mktsegment")
    ks = st.ks_two_sample(side("BUILDING"), side("AUTOMOBILE")).filter(~F.col("_small"))
    out = st.with_ks_pvalue(ks)
    return finish(out.select("feature", "n_ref", "n_cur", "ks_statistic", "ks_p_value",
                             (F.col("ks_p_value") < 0.05).alias("drift")))


_SKETCH_PROBS = [i / 10 for i in range(11)]


@register("sketch_quantiles", _with_long("""
SELECT feature, p AS prob, count(*) AS n, true AS dentro_do_erro
FROM lng, (SELECT unnest([0.0::DOUBLE, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS p) q
WHERE is_ref GROUP BY feature, p"""))
def q_sketch_quantiles(t):
    """A3 / A5, approximate: deciles of a baseline merged from the sketches of
    its years, each within the stated rank error of the exact one."""
    from ..operators import sketches as sk
    ref, _ = sides(t)
    ref = ref.withColumn("_y", F.year("l_shipdate"))
    base = scratch_path(t.spark, "sketches")
    (sk.sketched(st.to_long(ref, NUM, ["_y"]).withColumn(
        "feature", F.struct("feature", "_y"))).select("feature.*", "n", "lo", "hi", "sketch")
     .write.partitionBy("_y").parquet(base))  # one snapshot per year
    q = sk.quantiles(sk.stored_baseline(t.spark, base), _SKETCH_PROBS)
    at = st.to_long(ref, NUM).join(q.select("feature", "quantiles"), "feature")
    exact = at.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.count_if(F.col("value") < F.col("quantiles")[i]) for i in range(11)]).alias("lt"),
        F.array(*[F.count_if(F.col("value") <= F.col("quantiles")[i]) for i in range(11)]).alias("le"))
    rows = q.join(exact, "feature").select("feature", "n", "rows", F.posexplode(F.arrays_zip(
        "lt", "le")).alias("i", "c"))
    p, e = F.col("i") / 10, 2 * sk.rank_error()
    inside = (F.col("c.lt") / F.col("rows") <= p + e) & (F.col("c.le") / F.col("rows") >= p - e)
    return rows.select("feature", p.alias("prob"), "n",
                       (inside & (F.col("n") == F.col("rows"))).alias("dentro_do_erro"))


@register("sketch_ks", _with_long("""
SELECT feature, count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_cur,
       true AS dentro_do_erro FROM lng GROUP BY feature"""))
def q_sketch_ks(t):
    """A8, approximate: the KS statistic of two sketches is within its stated
    error of the exact one."""
    from ..operators import sketches as sk
    ref, cur = sides(t)
    a, b = st.to_long(ref, NUM), st.to_long(cur, NUM)
    near = sk.ks_two_sample(sk.sketched(a), sk.sketched(b))
    exact = st.ks_two_sample(a, b).select("feature", F.col("ks_statistic").alias("exact"))
    return near.join(exact, "feature").select(
        "feature", "n_ref", "n_cur",
        (F.abs(F.col("ks_statistic") - F.col("exact")) <= F.col("erro")).alias("dentro_do_erro"))


# ---- D6 / A7 / J5 ------------------------------------------------------------
_BASE_SQL = """
base_num AS (SELECT feature, e, list(CAST(n_ref AS DOUBLE) / t ORDER BY bin) AS p
             FROM edges JOIN bc USING (feature)
             JOIN (SELECT feature, sum(n_ref) AS t FROM bc GROUP BY feature) tt USING (feature)
             WHERE len(e) >= 2 GROUP BY feature, e),
cur_num AS (SELECT l.feature, CASE WHEN least(greatest(l.value, e[1]), e[len(e)]) = e[len(e)] THEN len(e) - 2
                 ELSE len(list_filter(e, lambda x: x <= least(greatest(l.value, e[1]), e[len(e)]))) - 1 END AS bin
            FROM lng l JOIN base_num USING (feature) WHERE NOT l.is_ref),
cur_counts AS (SELECT b.feature, b.p, list(CAST(COALESCE(c.n, 0) AS DOUBLE) ORDER BY a.bin) AS a
               FROM base_num b JOIN allbins a USING (feature)
               LEFT JOIN (SELECT feature, bin, count(*) AS n FROM cur_num GROUP BY feature, bin) c
                 ON c.feature = a.feature AND c.bin = a.bin
               GROUP BY b.feature, b.p),
base_cat AS (SELECT feature, category, n / sum(n) OVER (PARTITION BY feature) AS share
             FROM (SELECT feature, category, count(*) AS n FROM lcat WHERE is_ref GROUP BY feature, category) q),
cur_cat AS (SELECT feature, category, count(*) AS n FROM lcat WHERE NOT is_ref GROUP BY feature, category),
cat_arr AS (SELECT b.feature,
              list(b.share ORDER BY b.share DESC, b.category) || [0.0] AS p,
              list(CAST(COALESCE(c.n, 0) AS DOUBLE) ORDER BY b.share DESC, b.category)
                || [CAST(COALESCE((SELECT sum(n) FROM cur_cat x WHERE x.feature = b.feature
                     AND x.category NOT IN (SELECT category FROM base_cat y WHERE y.feature = b.feature)), 0) AS DOUBLE)] AS a
            FROM base_cat b LEFT JOIN cur_cat c USING (feature, category) GROUP BY b.feature),
arrs AS (SELECT feature, p, a FROM cur_counts UNION ALL SELECT feature, p, a FROM cat_arr),
norm AS (SELECT feature,
           list_transform(p, lambda x: greatest(x, 1e-6) / list_sum(list_transform(p, lambda y: greatest(y, 1e-6)))) AS pn,
           list_transform(a, lambda x: greatest(x, 1e-6) / list_sum(list_transform(a, lambda y: greatest(y, 1e-6)))) AS an
         FROM arrs),
psin AS (SELECT feature, list_sum(list_transform(range(1, len(pn) + 1),
                 lambda i: (an[i] - pn[i]) * ln(an[i] / pn[i]))) AS psi FROM norm)"""


@register("baseline_drift", _with_long(f""",
{_BASE_SQL.strip()}
SELECT feature, round(least(1.0, psi / 0.25), 4) AS drift_score, round(psi, 4) AS psi,
       round(least(1.0, psi / 0.25), 4) >= 0.15 AS drifted FROM psin
UNION ALL
SELECT '__overall__', round(max(round(least(1.0, psi / 0.25), 4)), 4), CAST(NULL AS DOUBLE),
       round(max(round(least(1.0, psi / 0.25), 4)), 4) >= 0.15 FROM psin""".replace("WITH ,", "WITH ")))
def q_baseline_drift(t):
    """D6 (A5 baseline + A7 normalised PSI + J5): per-feature drift score."""
    ref, cur = sides(t)
    base = st.baseline_stats(ref, NUM, CAT)
    return finish(dr.baseline_drift(base, cur.drop("l_shipdate")))


@register("category_vs_baseline", _with_long(f""",
{_BASE_SQL.strip()}
SELECT feature, category, round(share, 6) AS expected, CAST(COALESCE(c.n, 0) AS BIGINT) AS actual
FROM base_cat LEFT JOIN cur_cat c USING (feature, category)
UNION ALL
SELECT b.feature, NULL, 0.0, CAST(COALESCE((SELECT sum(n) FROM cur_cat x WHERE x.feature = b.feature
         AND x.category NOT IN (SELECT category FROM base_cat y WHERE y.feature = b.feature)), 0) AS BIGINT)
FROM (SELECT DISTINCT feature FROM base_cat) b"""))
def q_category_vs_baseline(t):
    """Baseline categories vs current counts plus the unseen part."""
    ref, cur = sides(t)
    base = st.baseline_stats(ref, [], CAT)
    return finish(st.category_vs_baseline(base, st.to_long_cat(cur, CAT)))


# ---- A10 - A13 on fx_avaliacao ------------------------------------------------
_METRICS_SQL = """
SELECT {by} round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0
             THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0 END, 6) AS f1,
       round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, CAST(tp + fp + fn + tn AS BIGINT) AS n
FROM (SELECT {by} CAST(sum(CASE WHEN y_prob >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
             CAST(sum(CASE WHEN y_prob >= 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
             CAST(sum(CASE WHEN y_prob < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
             CAST(sum(CASE WHEN y_prob < 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
      FROM {src} {group}) c"""


@register("binary_metrics", _METRICS_SQL.format(by="", src="fx_avaliacao", group=""))
def q_binary_metrics(t):
    """A10: precision / recall / F1 / accuracy at 0.5 with zero_division = 0."""
    return finish(st.binary_metrics(t.fx_avaliacao).withColumn("n", F.col("n").cast("long")))


@register("confusion_report", """
SELECT classe, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, CAST(tp + fn AS BIGINT) AS support
FROM (SELECT c.classe,
        sum(CASE WHEN y = c.classe AND pred = c.classe THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN y <> c.classe AND pred = c.classe THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN y = c.classe AND pred <> c.classe THEN 1 ELSE 0 END) AS fn
      FROM (SELECT y, CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM fx_avaliacao) a,
           (SELECT 0 AS classe UNION ALL SELECT 1) c GROUP BY c.classe) z""")
def q_confusion_report(t):
    """Confusion counts and per-class report."""
    return finish(st.confusion_report(t.fx_avaliacao))


_AUC_SQL = """
WITH g AS (SELECT y_prob AS s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM fx_avaliacao GROUP BY y_prob),
c AS (SELECT s, pos, neg, sum(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cneg,
             sum(pos) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cpos,
             sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM g)"""


@register("auc_exact", _AUC_SQL + """
SELECT round(sum(pos * (cneg - neg + 0.5 * neg)) / (max(tp) * max(tn)), 6) AS auc FROM c""")
def q_auc_exact(t):
    """Exact ROC AUC (ties half weight) without a global window."""
    return finish(st.auc_exact(t.fx_avaliacao))


@register("ks_separation", _AUC_SQL + """
SELECT round(max(abs(cpos / tp - cneg / tn)), 6) AS ks FROM c""")
def q_ks_separation(t):
    """KS between class score distributions."""
    return finish(st.ks_separation(t.fx_avaliacao))


# ---- A15 / A17 / A20 / D9 / W3 -----------------------------------------------
@register("prediction_distribution", f"""
WITH w AS (SELECT probabilidade,
             CASE WHEN probabilidade < 0.15 THEN 'A' WHEN probabilidade < 0.35 THEN 'B'
                  WHEN probabilidade < 0.60 THEN 'C' ELSE 'D' END AS nivel_risco
           FROM fx_predicoes WHERE momento >= TIMESTAMP '{AS_OF_FRAUDE}' - INTERVAL 24 HOUR)
SELECT (SELECT count(*) FROM w) AS n_predicoes,
       (SELECT round(avg(probabilidade), 4) FROM w) AS probabilidade_media,
       (SELECT round(stddev_pop(probabilidade), 4) FROM w) AS probabilidade_std,
       (SELECT round(min(probabilidade), 4) FROM w) AS probabilidade_min,
       (SELECT round(max(probabilidade), 4) FROM w) AS probabilidade_max,
       nivel_risco, round(count(*) / (SELECT count(*) FROM w), 6) AS share
FROM w GROUP BY nivel_risco""")
def q_prediction_distribution(t):
    """24 h prediction distribution and risk-level shares."""
    from ..functions.scoring import risk_band
    p = t.fx_predicoes.withColumn("nivel_risco", risk_band("probabilidade"))
    return finish(st.prediction_distribution(p, AS_OF_FRAUDE, 24))


@register("error_rate", """
SELECT date_trunc('hour', ts) AS hora, count(*) AS predictions_count,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
       round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*), 4) AS error_rate
FROM events GROUP BY 1""")
def q_error_rate(t):
    """A17 (and the hourly metrics file of X4): error rate per hour."""
    e = t.events.withColumn("hora", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return st.error_rate(e, ["hora"], F.when(F.col("event_type") == "error", 1).otherwise(0)) \
        .withColumn("error_count", F.col("error_count").cast("long"))


@register("fraud_summary", """
WITH q AS (SELECT quantile_cont(valor, 0.99) AS p99 FROM fx_fraude)
SELECT CAST(sum(CASE WHEN valor > (SELECT p99 FROM q) OR hour(data_transacao) < 6 OR hour(data_transacao) > 22
        OR isodow(data_transacao) - 1 >= 5 OR score_risco > 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS count_fraud,
       count(*) AS count_total FROM fx_fraude""")
def q_fraud_summary(t):
    """Fraud count and total over the rule labels."""
    from ..functions.scoring import label_fraud_rule
    from ..operators.prep import fit_fraud
    f = t.fx_fraude
    fit = fit_fraud(f)
    lab = f.select(label_fraud_rule("valor", F.lit(fit.p99), F.hour("data_transacao"),
                                    F.weekday("data_transacao"), "score_risco").alias("is_fraud"))
    return st.fraud_summary(lab)


@register("metric_alerts", """
SELECT dia, list_filter([
  CASE WHEN auc_roc < 0.8 THEN printf('AUC-ROC %.4f < 0.8', auc_roc) END,
  CASE WHEN precisao < 0.7 THEN printf('Precision %.4f < 0.7', precisao) END,
  CASE WHEN recall < 0.6 THEN printf('Recall %.4f < 0.6', recall) END,
  CASE WHEN f1 < 0.65 THEN printf('F1 %.4f < 0.65', f1) END], lambda x: x IS NOT NULL) AS alertas,
  (auc_roc < 0.8 OR precisao < 0.7 OR recall < 0.6 OR f1 < 0.65) AS alerta_ativo
FROM fx_metricas""")
def q_metric_alerts(t):
    """Alert texts per metric row and the active flag."""
    m = t.fx_metricas
    return dr.metric_alerts(m, names={"precision": "precisao"}).select("dia", "alertas",
                                                                      "alerta_ativo")


_DECAY_SQL = """
SELECT {days} AS window_days, n AS n_amostras_janela, metrica, round(baseline, 6) AS baseline,
       round(atual, 6) AS atual, delta_percentual,
       bool_or(delta_percentual < -10) OVER () AS degradacao
FROM (SELECT n, unnest([
        {{'metrica': 'auc_roc', 'baseline': f.auc_roc, 'atual': l.auc_roc}},
        {{'metrica': 'precisao', 'baseline': f.precisao, 'atual': l.precisao}},
        {{'metrica': 'recall', 'baseline': f.recall, 'atual': l.recall}},
        {{'metrica': 'f1', 'baseline': f.f1, 'atual': l.f1}}], recursive := true)
      FROM (SELECT count(*) AS n, arg_min(m, dia) AS f, arg_max(m, dia) AS l
            FROM (SELECT dia, {{'auc_roc': auc_roc, 'precisao': precisao, 'recall': recall, 'f1': f1}} AS m
                  FROM fx_metricas WHERE dia >= TIMESTAMP '{as_of}' - INTERVAL {days} DAY) w) e
      WHERE n >= 2) x
CROSS JOIN LATERAL (SELECT round((atual - baseline) / baseline * 100, 2) AS delta_percentual) d
WHERE baseline > 0"""


@register("metric_decay", _DECAY_SQL.format(days=7, as_of=AS_OF_FRAUDE) + "\nUNION ALL\n"
          + _DECAY_SQL.format(days=30, as_of=AS_OF_FRAUDE))
def q_metric_decay(t):
    """First vs last metric row in 7- and 30-day windows."""
    m = t.fx_metricas.withColumn("timestamp", F.col("dia").cast("timestamp_ntz"))
    cols = ["auc_roc", "precisao", "recall", "f1"]
    out = metric_decay(m, AS_OF_FRAUDE, 7, metric_cols=cols).unionByName(
        metric_decay(m, AS_OF_FRAUDE, 30, metric_cols=cols))
    return finish(out)


# ---- D3 / D4 / D5 / D7 / D12 / S9 / A21 ---------------------------------------
def _pred_sides(t):
    p = t.fx_predicoes
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return p.filter(F.col("momento") < cut), p.filter(F.col("momento") >= cut)


def _eval_sides(t):
    a = t.fx_avaliacao
    return a.filter(F.col("doc_id") % 2 == 0), a.filter(F.col("doc_id") % 2 == 1)


def _one_feature_sql(src_ref: str, src_cur: str) -> str:
    return f"""
WITH lng AS (SELECT true AS is_ref, v AS value FROM ({src_ref}) r UNION ALL
             SELECT false, v FROM ({src_cur}) c),
e AS (SELECT list_sort(list_distinct(quantile_cont(value, {_PROBS}))) AS e FROM lng WHERE is_ref),
binned AS (SELECT is_ref, CASE WHEN value = e[len(e)] THEN len(e) - 2
                  ELSE len(list_filter(e, lambda x: x <= value)) - 1 END AS bin
           FROM lng, e WHERE value >= e[1] AND value <= e[len(e)]),
bc AS (SELECT b.bin, (SELECT count(*) FROM binned x WHERE x.is_ref AND x.bin = b.bin) AS n_ref,
              (SELECT count(*) FROM binned x WHERE NOT x.is_ref AND x.bin = b.bin) AS n_cur
       FROM (SELECT unnest(range(0, len(e) - 1)) AS bin FROM e) b),
psi AS (SELECT sum((greatest(n_cur / t_cur, 1e-6) - greatest(n_ref / t_ref, 1e-6))
                   * ln(greatest(n_cur / t_cur, 1e-6) / greatest(n_ref / t_ref, 1e-6))) AS psi
        FROM bc, (SELECT sum(n_ref) AS t_ref, sum(n_cur) AS t_cur FROM bc) t),
g AS (SELECT value, sum(CASE WHEN is_ref THEN 1 ELSE 0 END) AS a, sum(CASE WHEN is_ref THEN 0 ELSE 1 END) AS b
      FROM lng GROUP BY value),
ks AS (SELECT max(abs(ca / ta - cb / tb)) AS ks FROM (
         SELECT sum(a) OVER w AS ca, sum(a) OVER () AS ta, sum(b) OVER w AS cb, sum(b) OVER () AS tb
         FROM g WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING)) x)
SELECT round(psi, 6) AS psi, round(ks, 6) AS ks_statistic, psi > 0.2 AS drift_detectado,
       psi AS psi_exact, ks AS ks_exact FROM psi, ks"""


def _shown(sql: str) -> str:
    return f"SELECT psi, ks_statistic, drift_detectado FROM ({sql}) s"


@register("prediction_drift", _shown(_one_feature_sql(
    "SELECT probabilidade AS v FROM fx_predicoes WHERE momento < TIMESTAMP '2024-01-16 00:00:00'",
    "SELECT probabilidade AS v FROM fx_predicoes WHERE momento >= TIMESTAMP '2024-01-16 00:00:00'")))
def q_prediction_drift(t):
    """D3: PSI + KS between first-half and second-half predictions."""
    r, c = _pred_sides(t)
    return finish(dr.prediction_drift(r, c, with_p=False))


@register("concept_drift", _shown(_one_feature_sql(
    "SELECT abs(y - y_prob) AS v FROM fx_avaliacao WHERE doc_id % 2 = 0",
    "SELECT abs(y - y_prob) AS v FROM fx_avaliacao WHERE doc_id % 2 = 1")))
def q_concept_drift(t):
    """PSI + KS of absolute errors between two label samples."""
    r, c = _eval_sides(t)
    return finish(dr.concept_drift(r, c, with_p=False))


_PRED = [f"SELECT probabilidade AS v FROM fx_predicoes WHERE momento {op} TIMESTAMP '2024-01-16 00:00:00'"
         for op in ("<", ">=")]
_EVAL = [f"SELECT abs(y - y_prob) AS v FROM fx_avaliacao WHERE doc_id % 2 = {r}" for r in (0, 1)]


def _part_sql(name: str, ref: str, cur: str) -> str:
    """Level and flag of a one-feature drift."""
    n, m = f"(SELECT count(v) FROM ({ref}) a)", f"(SELECT count(v) FROM ({cur}) b)"
    p = _ks_p("ks_exact", "n", "m")
    return f"""
SELECT '{name}' AS parte, {_level('psi_exact', p)} AS nivel, psi_exact > 0.2 AS drift_detectado
FROM (SELECT *, {n} AS n, {m} AS m FROM ({_one_feature_sql(ref, cur)}) o) z"""


@register("full_drift_report", _with_long(f""",{_REPORT_SQL},
parts AS (SELECT 'feature_drift' AS parte, nivel, drift_detectado FROM summ
  UNION ALL {_part_sql('prediction_drift', *_PRED)}
  UNION ALL {_part_sql('concept_drift', *_EVAL)}),
r AS (SELECT max(CASE nivel WHEN 'critico' THEN 3 WHEN 'alerta' THEN 2 WHEN 'atencao' THEN 1 ELSE 0 END) AS r FROM parts)
SELECT parte, nivel, drift_detectado FROM parts
UNION ALL SELECT 'geral', ['ok', 'atencao', 'alerta', 'critico'][r + 1], r >= 2 FROM r"""))
def q_full_drift_report(t):
    """Feature + prediction + concept drift and the overall level."""
    ref, cur = sides(t)
    fr = dr.feature_drift(ref, cur, NUM, CAT, LIMIT_P)
    pr, pc = _pred_sides(t)
    er, ec = _eval_sides(t)
    return dr.full_drift_report(fr, dr.prediction_drift(pr, pc, th=LIMIT_P),
                                dr.concept_drift(er, ec, th=LIMIT_P))


def _window_metrics(df):
    """auc, precisao, recall, f1, acuracia of one evaluation frame."""
    m = st.binary_metrics(df)
    a = st.auc_exact(df)
    # both are one-row aggregates: stack them into one row without a join
    cols = ["auc", "precisao", "recall", "f1", "acuracia"]
    left = m.select(F.lit(None).cast("double").alias("auc"), F.col("precision").alias("precisao"),
                    "recall", "f1", F.col("accuracy").alias("acuracia"))
    right = a.select("auc", *[F.lit(None).cast("double").alias(c) for c in cols[1:]])
    return left.unionByName(right).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


_DECAY_MODEL_SQL = """
WITH m AS (
  SELECT doc_id % 2 AS side,
    CAST(sum(CASE WHEN y_prob >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN y_prob >= 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN y_prob < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
    CAST(sum(CASE WHEN y_prob < 0.5 AND y <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM fx_avaliacao GROUP BY 1),
g AS (SELECT doc_id % 2 AS side, y_prob AS s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM fx_avaliacao GROUP BY 1, 2),
a AS (SELECT side, sum(pos * (cneg - neg + 0.5 * neg)) / (max(tp) * max(tn)) AS auc FROM (
        SELECT side, s, pos, neg, sum(neg) OVER (PARTITION BY side ORDER BY s ROWS UNBOUNDED PRECEDING) AS cneg,
               sum(pos) OVER (PARTITION BY side) AS tp, sum(neg) OVER (PARTITION BY side) AS tn FROM g) x
      GROUP BY side),
v AS (SELECT side, auc,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precisao,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
        CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
        (tp + tn) / (tp + fp + fn + tn) AS acuracia FROM m JOIN a USING (side)),
l AS (SELECT b.name AS metrica, b.val AS base, c.val AS atual FROM
        (UNPIVOT (SELECT auc, precisao, recall, f1, acuracia FROM v WHERE side = 0)
           ON auc, precisao, recall, f1, acuracia INTO NAME name VALUE val) b
        JOIN (UNPIVOT (SELECT auc, precisao, recall, f1, acuracia FROM v WHERE side = 1)
           ON auc, precisao, recall, f1, acuracia INTO NAME name VALUE val) c USING (name)),
d AS (SELECT metrica, base, atual, CASE WHEN base <= 0 THEN 0.0
        ELSE least(1.0, greatest(0.0, (base - atual) / base)) END AS dg FROM l)"""


@register("model_decay", _DECAY_MODEL_SQL + """
SELECT metrica, round(base, 4) AS baseline, round(atual, 4) AS atual, round(dg, 4) AS degradacao,
       dg >= 0.1 AS drifted FROM d
UNION ALL
SELECT '__overall__', NULL, NULL, round(avg(dg), 4), round(avg(dg), 4) >= 0.1 FROM d""")
def q_model_decay(t):
    """D7 (with A10 + A12 per window): relative metric degradation."""
    b, c = _eval_sides(t)
    return finish(dr.model_decay(_window_metrics(b), _window_metrics(c)))


def _reports(t):
    ref, cur = sides(t)
    data = dr.baseline_drift(st.baseline_stats(ref, NUM, CAT), cur.drop("l_shipdate"))
    b, c = _eval_sides(t)
    model = dr.model_decay(_window_metrics(b), _window_metrics(c))
    return data, model


@register("retrain_decision", _with_long(f""",
{_BASE_SQL.strip()},
{_DECAY_MODEL_SQL.strip()[5:]},
d6 AS (SELECT round(max(round(least(1.0, psi / 0.25), 4)), 4) >= 0.15 AS drift FROM psin),
d7 AS (SELECT round(avg(dg), 4) >= 0.1 AS drift FROM d)
SELECT (d6.drift OR d7.drift) AS retrain_triggered, 'fraud_detection' AS modelo,
       CASE WHEN d6.drift OR d7.drift THEN 'drift' ELSE 'none' END AS motivo
FROM d6, d7""".replace("WITH ,", "WITH ")))
def q_retrain_decision(t):
    """D12 + A21: retrain when the data or model report drifted."""
    data, model = _reports(t)
    flags = data.select(F.col("feature").alias("k"), "drifted").unionByName(
        model.select(F.col("metrica").alias("k"), "drifted"))
    return dr.retrain_decision(flags, key="k")


# data and model report rows in SQL: (name, score, psi, drifted)
def _report_rows(is_ref: str = BY_DATE) -> str:
    return _with_long(f""",
{_BASE_SQL.strip()},
{_DECAY_MODEL_SQL.strip()[5:]},
dd AS (SELECT feature AS name, round(least(1.0, psi / 0.25), 4) AS s FROM psin),
dall AS (SELECT name, s, s >= 0.15 AS drifted FROM dd
         UNION ALL SELECT '__overall__', round(max(s), 4), round(max(s), 4) >= 0.15 FROM dd),
mm AS (SELECT metrica AS name, round(dg, 4) AS s, dg >= 0.1 AS drifted FROM d
       UNION ALL SELECT '__overall__', round(avg(dg), 4), round(avg(dg), 4) >= 0.1 FROM d)
""", is_ref)


@register("prometheus_lines", _report_rows() + """,
lin AS (SELECT CASE WHEN name = '__overall__' THEN 'ml_data_drift_score'
               ELSE 'ml_feature_drift_score{feature="' || name || '"}' END AS metric, s AS value FROM dall
      UNION ALL SELECT 'ml_data_drift_detected', CAST(drifted AS DOUBLE) FROM dall WHERE name = '__overall__'
      UNION ALL SELECT CASE WHEN name = '__overall__' THEN 'ml_model_degradation'
               ELSE 'ml_metric_degradation{metrica="' || name || '"}' END, s FROM mm
      UNION ALL SELECT 'ml_model_drift_detected', CAST(drifted AS DOUBLE) FROM mm WHERE name = '__overall__')
SELECT metric, value, metric || ' ' || CAST(CAST(value AS DECIMAL(18, 4)) AS VARCHAR) AS line FROM lin""")
def q_prometheus_lines(t):
    """Textfile gauge lines of the data and model drift reports."""
    data, model = _reports(t)
    return finish(dr.prometheus_lines(data, model))


@register("alert_text", _report_rows(BY_QUANTITY) + """,
af AS (SELECT string_agg(printf('%s (%.2f)', name, round_even(s, 2)), ', ' ORDER BY name) AS t
      FROM dall WHERE name <> '__overall__' AND drifted),
ag AS (SELECT string_agg(printf('%s (%.2f)', name, round_even(s, 2)), ', ' ORDER BY name) AS t
      FROM mm WHERE name <> '__overall__' AND drifted),
ao AS (SELECT (SELECT s FROM dall WHERE name = '__overall__') AS ds, (SELECT drifted FROM dall WHERE name = '__overall__') AS dd,
             (SELECT s FROM mm WHERE name = '__overall__') AS ms, (SELECT drifted FROM mm WHERE name = '__overall__') AS md)
SELECT concat_ws(chr(10), ':rotating_light: *Drift detectado nos modelos*',
  CASE WHEN dd THEN printf('- *Data drift*: score %.4f (threshold 0.15)', ds) END,
  CASE WHEN dd AND af.t <> '' THEN '  - Features com drift: ' || af.t END,
  CASE WHEN md THEN printf('- *Model drift*: degradação %.4f (threshold 0.1)', ms) END,
  CASE WHEN md AND ag.t <> '' THEN '  - Métricas degradadas: ' || ag.t END,
  '- Retreino automático acionado.') AS texto
FROM ao, af, ag WHERE dd OR md""")
def q_alert_text(t):
    """Alert message text; the sides are low and high quantities, which
    drift."""
    li = t.lineitem.select(*NUM, *CAT)
    data = dr.baseline_drift(st.baseline_stats(li.filter(BY_QUANTITY), NUM, CAT),
                             li.filter(f"NOT ({BY_QUANTITY})"))
    b, c = _eval_sides(t)
    return dr.alert_text(data, dr.model_decay(_window_metrics(b), _window_metrics(c)), retrain=True)


@register("any_drift", _with_long(""",
x AS (SELECT 1)
SELECT bool_or(psi > 0.2) AS any_drift FROM psi""".replace("WITH ,", "")))
def q_any_drift(t):
    """OR of per-feature drift flags (psi > 0.2)."""
    ref, cur = sides(t)
    rows = dr.numeric_drift(ref, cur, NUM, with_p=False).withColumn(
        "drift_detected", F.col("psi") > 0.2)
    return st.any_drift(rows)


# ---- W4 / F5 / D11 -------------------------------------------------------------
@register("last_metrics", """
SELECT dia, n_amostras, round(auc_roc, 6) AS auc_roc, round(precisao, 6) AS precisao
FROM fx_metricas ORDER BY dia DESC LIMIT 24""")
def q_last_metrics(t):
    """The newest 24 metric rows (top-k: per-partition top-n, one merge)."""
    from ..operators.windows import last_n
    m = t.fx_metricas.select("dia", "n_amostras", "auc_roc", "precisao")
    return finish(last_n(m, "dia", 24))


@register("window_filter", f"""
SELECT event_id, id_cliente, momento FROM fx_predicoes
WHERE momento >= TIMESTAMP '{AS_OF_FRAUDE}' - INTERVAL 72 HOUR""")
def q_window_filter(t):
    """prediction rows of the last 72 hours before as_of."""
    from ..operators.windows import window_filter
    return window_filter(t.fx_predicoes, "momento", AS_OF_FRAUDE, hours=72) \
        .select("event_id", "id_cliente", "momento")


@register("monitoring_report", f"""
WITH d7 AS ({_DECAY_SQL.format(days=7, as_of=AS_OF_FRAUDE)}),
d30 AS ({_DECAY_SQL.format(days=30, as_of=AS_OF_FRAUDE)}),
p AS (SELECT count(*) AS n, round(avg(probabilidade), 4) AS m FROM fx_predicoes
      WHERE momento >= TIMESTAMP '{AS_OF_FRAUDE}' - INTERVAL 24 HOUR)
SELECT (SELECT count(*) FROM fx_metricas) AS total_metricas_registradas,
       (SELECT count(*) FROM fx_predicoes) AS total_predicoes_registradas,
       COALESCE((SELECT bool_or(degradacao) FROM d7), false) AS degradacao_7d,
       COALESCE((SELECT bool_or(degradacao) FROM d30), false) AS degradacao_30d,
       (SELECT n FROM p) AS n_predicoes_24h, (SELECT m FROM p) AS probabilidade_media_24h,
       (SELECT max(dia) FROM fx_metricas) AS ultima_metrica""")
def q_monitoring_report(t):
    """Totals, 7 d / 30 d decay flags, 24 h distribution, last metric
    (one row composed from W3, A15 and W4 aggregates, no join)."""
    m = t.fx_metricas.withColumn("timestamp", F.col("dia").cast("timestamp_ntz"))
    cols = ["auc_roc", "precisao", "recall", "f1"]
    d7 = metric_decay(m, AS_OF_FRAUDE, 7, metric_cols=cols).agg(
        F.coalesce(F.bool_or("degradacao"), F.lit(False)).alias("degradacao_7d"))
    d30 = metric_decay(m, AS_OF_FRAUDE, 30, metric_cols=cols).agg(
        F.coalesce(F.bool_or("degradacao"), F.lit(False)).alias("degradacao_30d"))
    from ..operators.windows import window_filter
    p24 = window_filter(t.fx_predicoes, "momento", AS_OF_FRAUDE, hours=24).agg(
        F.count(F.lit(1)).alias("n_predicoes_24h"),
        F.round(F.avg("probabilidade"), 4).alias("probabilidade_media_24h"))
    tm = t.fx_metricas.agg(F.count(F.lit(1)).alias("total_metricas_registradas"),
                           F.max("dia").alias("ultima_metrica"))
    tp = t.fx_predicoes.agg(F.count(F.lit(1)).alias("total_predicoes_registradas"))
    parts = [tm, tp, d7, d30, p24]
    names = ["total_metricas_registradas", "total_predicoes_registradas", "degradacao_7d",
             "degradacao_30d", "n_predicoes_24h", "probabilidade_media_24h", "ultima_metrica"]
    # five one-row aggregates stacked and folded into one row
    stacked = None
    for df in parts:
        full = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names])
        stacked = full if stacked is None else stacked.unionByName(full, allowMissingColumns=True)
    return finish(stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names]))
