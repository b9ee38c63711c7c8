"""Small shared helpers of the corpus operators: scratch tables in the shared
folder, Arrow batch slicing, column names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in
    ``spark.checkpoint.dir``.  Only on a single-machine ``local[..]`` master
    (tests), where nothing is configured, a temporary folder stands in; on a
    cluster an unset folder is an error, never a machine-local path."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = sc.master or ""
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _LOCAL_DIRS.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="riskloom-llm-"))
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` set to ``value`` in this block."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


#: shuffle files of a finished write go at once, not when the driver's garbage
#: collector finds their plan: the written table is what later readers need
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the
    lineage ends there and a lost executor costs a re-read, not a re-run.
    ``codec`` is for wide tables: the session's unless given."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with setting(spark, _DROP_SHUFFLES, "true"):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: bytes of rows for which a task is worth its start and the file it writes
TASK_BYTES = 4 << 20
#: bytes that a row of a few longs counts as
NARROW = 64


def in_tasks(df: DataFrame, size: int) -> DataFrame:
    """``df``, whose rows hold about ``size`` bytes, in a task per TASK_BYTES of
    them and one per core at least: a small table is not dealt over as many
    tasks and files as the session has shuffle partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-int(size) // TASK_BYTES)))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Plans made and run in this block hand at most ``rows`` rows at a time
    to Python: for wide cells (whole sets), whose batches would else be large."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


#: bytes of rows that go to Python at a time where rows hold whole texts
TEXT_BATCH = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: what a session has that says nothing, 64 MB
_BATCH_UNSET = 64 << 20


def text_batches(spark: SparkSession) -> None:
    """From now on the session hands at most about TEXT_BATCH bytes of rows at
    a time to Python, unless it has a value of its own: else a task's batch is
    10,000 texts, held by the executor and by its worker.  For results that are
    run later than their operator returns."""
    if int(spark.conf.get(_BATCH_BYTES).rstrip("bB")) == _BATCH_UNSET:
        spark.conf.set(_BATCH_BYTES, str(TEXT_BATCH))


@contextmanager
def text_batched(spark: SparkSession):
    """The same for plans made and run in this block."""
    old = spark.conf.get(_BATCH_BYTES)
    text_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, old)


def fresh_name(columns, base: str) -> str:
    """``base``, or ``base_1``, ``base_2``.. if a column of that name exists
    (names compare without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    name, i = base, 0
    while name.lower() in taken:
        i += 1
        name = f"{base}_{i}"
    return name


def column(batch: pa.RecordBatch, i: int) -> pa.Array:
    a = batch.column(i)
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def byte_offsets(texts: pa.Array) -> np.ndarray:
    """Offsets of a string / binary array into its data buffer."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(
        texts.type) else np.int32
    buf = texts.buffers()[1]
    if buf is None or len(texts) == 0:
        return np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(buf, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def slices(batch: pa.RecordBatch, text: int, max_bytes: int = 8 << 20):
    """Cut a record batch so that no slice holds more than ``max_bytes`` of
    text, unless one document alone is larger: memory stays bounded by
    ``max_bytes`` plus the longest document."""
    n = batch.num_rows
    if not n:
        return
    offs = byte_offsets(column(batch, text))
    start = 0
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + max_bytes, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end
