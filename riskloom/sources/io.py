"""Readers and writers.

Every reader takes an explicit schema where the format allows it (no
inference pass over 100 TB) and every writer is a distributed Spark write:
partitioned by date / snapshot so later reads prune partitions.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

CORRUPT = "_corrupt_record"

PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("id_cliente", T.LongType()),
    T.StructField("probabilidade", T.DoubleType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("nivel_risco", T.StringType()),
    T.StructField("modelo_versao", T.StringType()),
])
METRIC_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("auc_roc", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("ks_statistic", T.DoubleType()),
    T.StructField("n_amostras", T.LongType()),
    T.StructField("modelo_versao", T.StringType()),
    T.StructField("alertas", T.ArrayType(T.StringType())),
    T.StructField("alerta_ativo", T.BooleanType()),
])


# --- S1 -----------------------------------------------------------------------
def read_table(spark: SparkSession, name: str, source: str | None,
               schema: T.StructType | None = None, partition_column: str | None = None,
               lower: int | None = None, upper: int | None = None,
               num_partitions: int = 64, properties: dict | None = None) -> DataFrame:
    """A core table from a JDBC URL (range-partitioned read: ``num_partitions``
    parallel queries on ``partition_column``) or from a parquet folder.  No
    source -> an empty frame with ``schema`` (the reference returns an empty
    frame when no connection string is given)."""
    if not source:
        log.warning("read_table(%s): no source given, returning an empty frame", name)
        return spark.createDataFrame([], schema or T.StructType([]))
    if source.startswith("jdbc:"):
        r = spark.read.format("jdbc").option("url", source).option("dbtable", name)
        for k, v in (properties or {}).items():
            r = r.option(k, v)
        if partition_column:
            r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
                 .option("upperBound", upper).option("numPartitions", num_partitions))
        return r.load()
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(f"{source.rstrip('/')}/{name}.parquet" if not source.endswith(".parquet")
                     else source)


# --- S2 -----------------------------------------------------------------------
def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV (with header) when the path ends in .csv, else parquet."""
    r = spark.read if schema is None else spark.read.schema(schema)
    if path.lower().endswith(".csv"):
        return r.option("header", True).csv(path) if schema is not None else \
            r.option("header", True).option("inferSchema", True).csv(path)
    return r.parquet(path)


# --- S3 -----------------------------------------------------------------------
def read_transactions_json(spark: SparkSession, path: str,
                           schema: T.StructType | None = None) -> DataFrame:
    """A JSON array of transactions, an object with a ``transactions`` list,
    or one object per file -> one row per transaction."""
    r = spark.read.option("multiLine", True)
    df = r.json(path)
    if "transactions" in df.columns and isinstance(df.schema["transactions"].dataType, T.ArrayType):
        df = df.select(F.explode_outer("transactions").alias("t")).select("t.*")
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


# --- S4 -----------------------------------------------------------------------
def read_metric_log(spark: SparkSession, path: str, schema: T.StructType = METRIC_LOG_SCHEMA) \
        -> DataFrame:
    """JSON-lines log without its malformed lines (lazy; see
    :func:`bad_lines`), ordered by time."""
    df = _permissive(spark, path, schema)
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT).orderBy("timestamp")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType = METRIC_LOG_SCHEMA) \
        -> DataFrame:
    """The malformed lines of a log, for a report on what a reader skips."""
    # a query on the corrupt column alone is refused: keep a data column beside it
    df = _permissive(spark, path, schema)
    none = F.substring(F.coalesce(F.col(schema.fields[0].name).cast("string"), F.lit("")), 1, 0)
    return df.filter(F.col(CORRUPT).isNotNull()).select(
        F.concat(F.col(CORRUPT), none).alias("line"))


def _permissive(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    s = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(s).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def append_log(df: DataFrame, path: str, ts_col: str = "timestamp", unit: str = "day") -> None:
    """Append rows to a JSON log partitioned by day (or day and hour)."""
    ts = F.col(ts_col).cast("timestamp")
    out = df.withColumn("date", F.date_format(ts, "yyyyMMdd"))
    parts = ["date"]
    if unit == "hour":
        out = out.withColumn("hour", F.date_format(ts, "HH"))
        parts.append("hour")
    out.write.mode("append").partitionBy(*parts).json(path)


# --- S5 -----------------------------------------------------------------------
def write_feature_view(df: DataFrame, path: str, snapshot_date: str,
                       ts_col: str = "event_timestamp") -> None:
    """Dated snapshot of a feature view with ``event_timestamp``; dynamic
    partition overwrite replaces only this snapshot's partition."""
    out = df.withColumn(ts_col, F.coalesce(F.col(ts_col), F.lit(snapshot_date).cast("timestamp_ntz"))
                        if ts_col in df.columns else F.lit(snapshot_date).cast("timestamp_ntz"))
    out = out.withColumn("snapshot_date", F.lit(snapshot_date))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date").parquet(path))


# --- S7 -----------------------------------------------------------------------
def write_decisions_csv(df: DataFrame, path: str) -> None:
    """Governed decisions to CSV with a header; arrays become '|'-joined text."""
    cols = [F.array_join(F.col(f.name), "|").alias(f.name)
            if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


# --- S8 -----------------------------------------------------------------------
def write_report_json(df: DataFrame, path: str) -> None:
    """Report rows (summary + per-feature rows) as JSON lines; reports are a
    handful of rows, written as one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


# --- S10 ----------------------------------------------------------------------
def save_baseline(df: DataFrame, path: str) -> None:
    """Persist reference statistics (array columns) once."""
    df.write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_or_build_baseline(spark: SparkSession, path: str, build) -> DataFrame:
    """Reuse a stored baseline; only if there is none at ``path``, build it
    with ``build()`` and store it.  Any other read error is raised and leaves
    the stored baseline alone."""
    try:
        return load_baseline(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    save_baseline(build(), path)
    return load_baseline(spark, path)
