"""Registered queries: streaming jobs X1-X5, drained to the end of the input
(``availableNow``) and read back as batch DataFrames.  X2-X4 also have SQL
oracles: a drained stream must equal the batch computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as st
from ..sources import fixtures as fx
from ..streaming import jobs, sinks, trailing
from . import catalog
from .catalog import finish, register
from .q_stats import CAT, NUM, SPLIT


#: the event table is not in the order of time: lateness that covers its days
LATENESS = "60 days"


class _StreamTables:
    """Just enough of :class:`Tables` for the fixture builders over a stream."""

    def __init__(self, t, name="events"):
        self.spark = t.spark
        self.events = jobs.table_stream(t.spark, t.sf_dir, name)


def _ntz(df, cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


@register("stream_prediction_distribution", """
WITH p AS (SELECT momento, probabilidade,
             CASE WHEN probabilidade < 0.15 THEN 'A' WHEN probabilidade < 0.35 THEN 'B'
                  WHEN probabilidade < 0.60 THEN 'C' ELSE 'D' END AS b FROM fx_predicoes),
w AS (SELECT date_trunc('hour', momento) - to_hours(k) AS inicio, probabilidade, b
      FROM p, (SELECT unnest(range(0, 24)) AS k) r)
SELECT inicio, inicio + INTERVAL 24 HOUR AS fim, count(*) AS n_predicoes,
  round(sum(probabilidade) / count(*), 4) AS probabilidade_media,
  round(sqrt(greatest(sum(probabilidade * probabilidade) / count(*) - (sum(probabilidade) / count(*)) ** 2, 0.0)), 4) AS probabilidade_std,
  round(min(probabilidade), 4) AS probabilidade_min, round(max(probabilidade), 4) AS probabilidade_max,
  count(*) FILTER (WHERE b = 'A') AS n_A, count(*) FILTER (WHERE b = 'B') AS n_B,
  count(*) FILTER (WHERE b = 'C') AS n_C, count(*) FILTER (WHERE b = 'D') AS n_D
FROM w GROUP BY inicio""")
def q_stream_prediction_distribution(t):
    """24 h sliding prediction distribution over the event stream."""
    s = fx.fx_predicoes(_StreamTables(t))
    agg = jobs.prediction_distribution(s, watermark=LATENESS)
    return finish(_ntz(jobs.drain(agg, ["inicio", "fim"], "x2"), ["inicio", "fim"]))


@register("stream_velocity", """
SELECT conta_id, date_trunc('hour', data_transacao) AS inicio,
       date_trunc('hour', data_transacao) + INTERVAL 1 HOUR AS fim, count(*) AS n
FROM fx_fraude GROUP BY ALL""")
def q_stream_velocity(t):
    """Transactions per account per hour over the event stream."""
    s = fx.fx_fraude(_StreamTables(t))
    return _ntz(jobs.drain(jobs.velocity(s, watermark=LATENESS), ["conta_id", "inicio", "fim"], "x3"), ["inicio", "fim"])


@register("stream_trailing_counts", """
SELECT id, conta_id,
  COUNT(*) OVER (PARTITION BY conta_id ORDER BY data_transacao RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS transactions_last_hour,
  COUNT(*) OVER (PARTITION BY conta_id ORDER BY data_transacao RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS transactions_last_day
FROM fx_fraude""")
def q_stream_trailing_counts(t):
    """X3 with W2: exact 1 h / 24 h trailing counts per account, kept in keyed
    state with event-time timers over the event stream."""
    s = fx.fx_fraude(_StreamTables(t))
    return jobs.drain(trailing.trailing_counts_stream(s, watermark=LATENESS),
                      ["id", "conta_id"], "x3-trailing")


@register("stream_metrics_hourly", """
SELECT date_trunc('hour', ts) AS hora, count(*) AS predictions_count,
       count(*) FILTER (WHERE event_type = 'error') AS error_count,
       round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate
FROM events GROUP BY 1""")
def q_stream_metrics_hourly(t):
    """Hourly predictions / errors / error rate over the event stream."""
    s = _StreamTables(t).events
    return _ntz(jobs.drain(jobs.metrics_hourly(s, watermark=LATENESS), ["hora"], "x4"), ["hora"])


@register("stream_prediction_log", """
SELECT CAST(momento AS DATE) AS date, count(*) AS n, round(avg(probabilidade), 6) AS media
FROM fx_predicoes GROUP BY 1""")
def q_stream_prediction_log(t):
    """The prediction stream appended to date-partitioned files; read
    back as rows per date."""
    s = fx.fx_predicoes(_StreamTables(t))
    base = jobs.scratch_dir(t.spark, "x1")
    jobs.prediction_log_sink(s, f"{base}/out", f"{base}/ck", drain=True).awaitTermination()
    return (t.spark.read.parquet(f"{base}/out").groupBy("date")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probabilidade"), 6).alias("media")))


@register("stream_baseline_drift",
          f"SELECT *, 0 AS batch_id FROM ({catalog._ORACLE['baseline_drift']}) b")
def q_stream_baseline_drift(t):
    """D6 baseline drift per micro-batch of the current lineitem rows (no
    limit of files a trigger: whatever is there is one batch, number 0)."""
    li = t.lineitem.select(*NUM, *CAT, "l_shipdate")
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    base = st.baseline_stats(li.filter(F.col("l_shipdate") < cut), NUM, CAT)
    stream = (jobs.table_stream(t.spark, t.sf_dir, "lineitem")
              .filter(F.col("l_shipdate") >= cut).select(*NUM, *CAT))
    d = jobs.scratch_dir(t.spark, "x5")
    jobs.baseline_drift_stream(stream, base, f"{d}/out", f"{d}/ck", drain=True).awaitTermination()
    return finish(sinks.read_batches(t.spark, f"{d}/out"))
