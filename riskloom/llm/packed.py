"""Numpy columns dealt over buckets as binary cells.

A shuffle row is one bucket's share of what a task made: a few binary cells
with the packed columns.  Millions of (hash, key, place) triples thus cross
the shuffle as thousands of rows, and the tasks on either side stay in numpy.
The number of buckets follows the size of the input, so that a bucket stays
small whatever the size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed_rows(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per distinct bucket: ``bucket`` and the binary share of every
    column, in a stable order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else \
        np.zeros(0, dtype=np.int64)
    ends = np.append(starts, len(b))
    cells = [pa.array(b[starts])]
    for v in columns.values():
        data = np.ascontiguousarray(v[order])
        cells.append(pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts),
            [None, pa.py_buffer((ends * data.itemsize).astype(np.int64)),
             pa.py_buffer(data.tobytes())]).cast(pa.binary()))
    return pa.RecordBatch.from_arrays(cells, ["bucket", *columns])


def unpacked(table: pa.Table, name: str, kind) -> np.ndarray:
    """All rows' share of a column, one after another (null: nothing)."""
    return np.frombuffer(b"".join(x for x in table[name].to_pylist() if x), dtype=kind)


def groups(*keys: np.ndarray):
    """(order, start of each run, run index of each sorted row) of rows with
    equal keys, the first key being the main one."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one narrow aggregate."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def bucket_count(spark, total: int, each: int) -> int:
    """Enough buckets of at most about ``each``, and one for every shuffle
    partition.  Stages hand their rows on by bucket of the next stage, so their
    number can reach the square of this one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each))
