"""Structured Streaming re-aims of the append-only logs.

Sources are file streams with an explicit schema.  Aggregations are
event-time windows over a watermarked column, so windows older than the
watermark leave the state, append mode is possible, and rows later than the
given lateness are dropped.  Sinks are partitioned files with a checkpoint in
the shared folder the cluster names in ``spark.checkpoint.dir``: a restarted or
re-scheduled query resumes from its offsets.

``drain`` runs a query with ``trigger(availableNow=True)`` and keeps, per
result key, the last version written (a log of updates by batch, see ``sinks``).  The
drained result equals the batch computation over the same rows if the lateness
covers the disorder of the input across its micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scoring import risk_band
from ..operators import drift as dr
from ..session import scratch_path, scratch_table
from . import sinks


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, f"stream-{name}")


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Stream over one parquet table of a scale-factor folder (glob path, so
    the file itself is the source)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return file_stream(spark, f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet", schema)


def _event_time(events: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Event time as TIMESTAMP (watermarks need it; the files hold
    timestamp_ntz, read in the UTC session zone) plus the watermark."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, watermark) if events.isStreaming else events


# --- X1 -----------------------------------------------------------------------
def prediction_log_sink(stream: DataFrame, out_path: str, checkpoint: str,
                        ts_col: str = "momento", drain: bool = False) -> StreamingQuery:
    """Append the prediction stream to files partitioned by date; ``drain``
    ends the query when the input that is there now has been read."""
    out = stream.withColumn("date", F.to_date(F.col(ts_col)))
    w = (out.writeStream.format("parquet").partitionBy("date")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    return (w.trigger(availableNow=True) if drain else w).start()


# --- X2 -----------------------------------------------------------------------
def prediction_distribution(events: DataFrame, ts: str = "momento", prob: str = "probabilidade",
                            window: str = "24 hours", slide: str = "1 hour",
                            watermark: str = "1 hour") -> DataFrame:
    """Sliding 24 h windows (1 h slide): n, mean, population std, min, max
    (4 decimals) and the count of each risk band.  Works on batch or stream
    frames; on a stream the watermark bounds the state."""
    events = _event_time(events, ts, watermark)
    lv = risk_band(prob)
    agg = events.groupBy(F.window(F.col(ts), window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n_predicoes"), F.sum(prob).alias("s1"),
        F.sum(F.col(prob) * F.col(prob)).alias("s2"), F.min(prob).alias("mn"),
        F.max(prob).alias("mx"),
        *[F.count(F.when(lv == b, 1)).alias(f"n_{b}") for b in "ABCD"])
    mean = F.col("s1") / F.col("n_predicoes")
    var = F.greatest(F.col("s2") / F.col("n_predicoes") - mean * mean, F.lit(0.0))
    return agg.select(F.col("w.start").alias("inicio"), F.col("w.end").alias("fim"), "n_predicoes",
                      F.round(mean, 4).alias("probabilidade_media"),
                      F.round(F.sqrt(var), 4).alias("probabilidade_std"),
                      F.round("mn", 4).alias("probabilidade_min"),
                      F.round("mx", 4).alias("probabilidade_max"),
                      *[F.col(f"n_{b}") for b in "ABCD"])


# --- X3 -----------------------------------------------------------------------
def velocity(events: DataFrame, key: str = "conta_id", ts: str = "data_transacao",
             window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Transactions per account per tumbling window (the exact trailing counts
    of every row are :func:`trailing.trailing_counts_stream`)."""
    events = _event_time(events, ts, watermark)
    return (events.groupBy(F.window(F.col(ts), window).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("w.start").alias("inicio"), F.col("w.end").alias("fim"), "n"))


# --- X4 -----------------------------------------------------------------------
def metrics_hourly(events: DataFrame, ts: str = "ts", is_error=None,
                   watermark: str = "1 hour") -> DataFrame:
    """Hourly predictions, errors and error rate (4 decimals)."""
    events = _event_time(events, ts, watermark)
    err = is_error if is_error is not None else (F.col("event_type") == "error")
    g = (events.groupBy(F.window(F.col(ts), "1 hour").alias("w"))
         .agg(F.count(F.lit(1)).alias("predictions_count"),
              F.count(F.when(err, 1)).alias("error_count")))
    return g.select(F.col("w.start").alias("hora"), "predictions_count", "error_count",
                    F.round(F.col("error_count") / F.col("predictions_count"), 4).alias("error_rate"))


# --- X5 -----------------------------------------------------------------------
def baseline_drift_stream(stream: DataFrame, baseline: DataFrame, out_path: str,
                          checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Per micro-batch, D6 against the stored baseline (one row per bin or
    category), kept under the batch id: a replayed batch takes the place of its
    first attempt (:func:`sinks.read_batches` reads the reports)."""
    base = scratch_table(baseline, "baseline")
    w = stream.writeStream.foreachBatch(
        sinks.batch_writer(out_path, lambda batch: dr.baseline_drift(base, batch))) \
        .option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if drain else w).start()


# --- drain helper ---------------------------------------------------------------
def drain(agg: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a streaming aggregation to the end of its input (availableNow) in
    update mode; every micro-batch keeps its updated rows under the batch id,
    once however often it is replayed; the result keeps the newest version of
    each key."""
    spark = agg.sparkSession
    base = scratch_dir(spark, name)
    q = (agg.writeStream.outputMode("update").foreachBatch(sinks.batch_writer(f"{base}/out"))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return newest(sinks.read_batches(spark, f"{base}/out"), keys)


def newest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key in a log of updates by batch."""
    cols = [c for c in log.columns if c not in keys and c != "batch_id"]
    return (log.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols]))
