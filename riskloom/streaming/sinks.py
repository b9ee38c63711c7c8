"""Idempotent ``foreachBatch`` sinks.

A micro-batch that is replayed (the query died after its write and before
Spark's own commit) must not count twice.  Every batch owns one folder,
``batch_id=N``, which a replay overwrites, and one row of a log, ``commits``,
which is written after the folder is complete.  Readers join the two, so a
batch is seen whole and once, or not at all.

``baseline_drift_stream`` and ``drain`` write through this module; the
prediction log (X1) uses Spark's file sink, whose metadata log does the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA, COMMITS = "data", "commits"


def _commit(spark: SparkSession, path: str, batch_id: int) -> None:
    """The batch's row in the log; a replay writes the same row again."""
    spark.range(1).select(F.lit(True).alias("committed")).write.mode("overwrite") \
        .parquet(f"{path}/{COMMITS}/batch_id={batch_id}")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One batch's rows, in place of what an earlier attempt left there."""
    df.write.mode("overwrite").parquet(f"{path}/{DATA}/batch_id={batch_id}")
    _commit(df.sparkSession, path, batch_id)


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """A ``foreachBatch`` function.  ``transform`` may read the batch several
    times, so the batch is kept while it runs; empty batches are left out."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                write_batch(transform(batch) if transform else batch, path, batch_id)
        finally:
            batch.unpersist()
    return run


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of committed batches with their ``batch_id``.  The log has one row
    a batch; its join prunes the folders of other batches."""
    data = spark.read.parquet(f"{path}/{DATA}")
    done = spark.read.parquet(f"{path}/{COMMITS}").select("batch_id")
    return data.join(done, "batch_id", "left_semi").select(
        *[c for c in data.columns if c != "batch_id"], "batch_id")
