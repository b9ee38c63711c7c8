"""Exact trailing counts per account on a stream (W2's numbers).

State is kept per (bucket of keys, segment of time).  A row stands in its own
segment and is told to the later segments whose frames reach back to it; those
copies are plain columns, made before the shuffle.  A segment's state is one
list, a packed entry per micro-batch, which an event-time timer clears when the
watermark has passed the segment's end, so a task never holds more than a
segment of one bucket (and what the frames of that segment reach), however long
the stream runs.  Calls to the state store follow buckets and segments, not keys.

Counts are given at once and corrected: a batch emits every row that is new
and every row whose counts an out-of-order row has changed (update mode).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_US = 3600 * 1_000_000
DAY_US = 24 * HOUR_US
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: what a row is to a segment: its own; a time the 1 h frame may reach; a time
#: the 24 h frame may reach; a time every 24 h frame of the segment reaches
OWN, LAST_HOUR, LAST_DAY, WHOLE = 0, 1, 2, 3


def _counts(code: np.ndarray, kind: np.ndarray, us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 h, 24 h) counts of the own rows, in the order they stand, each among
    the rows with its key's ``code``."""
    low = us.min() - DAY_US  # a frame's start stays in its key's stretch
    stretch = us.max() - low + 1
    at = code * stretch + (us - low)
    own, whose = at[kind == OWN], code[kind == OWN]
    inside = np.sort(own)
    upto = np.searchsorted(inside, own, "right")

    def reached(k: int, span: int) -> np.ndarray:
        older = np.sort(at[kind == k])
        return (upto - np.searchsorted(inside, own - span, "left")
                + np.searchsorted(older, (whose + 1) * stretch, "left")
                - np.searchsorted(older, own - span, "left"))
    whole = np.bincount(code[kind == WHOLE], minlength=int(code.max()) + 1)
    return reached(LAST_HOUR, HOUR_US), reached(LAST_DAY, DAY_US) + whole[whose]


class TrailingCounts(StatefulProcessor):
    """One (bucket, segment): the list of its rows, an entry a micro-batch,
    cleared by a timer at its end."""

    def __init__(self, key_type: str, id_type: str, width_us: int):
        self.key_type, self.id_type, self.width_us = key_type, id_type, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState(
            "rows", f"keys array<{self.key_type}>, ids array<{self.id_type}>, "
                    "code binary, kind binary, us binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        if not held:
            # a timer fires once the watermark is past it
            self.handle.registerTimer((int(key[1]) + 1) * self.width_us // 1000)
        code, keys = pd.factorize(new["key"], use_na_sentinel=False)
        fresh = (keys.tolist(), new["id"].astype(object)[new["kind"] == OWN].tolist(),
                 code.astype(np.int64).tobytes(), new["kind"].to_numpy(np.int64).tobytes(),
                 new["us"].to_numpy(np.int64).tobytes())
        self.rows.appendValue(fresh)
        known, codes, ids = {}, [], []
        for keys, own, code, _, _ in [*held, fresh]:
            here = np.array([known.setdefault(k, len(known)) for k in keys], dtype=np.int64)
            codes.append(here[np.frombuffer(code, np.int64)])
            ids += own
        code = np.concatenate(codes)
        kind, us = (np.concatenate([np.frombuffer(e[i], np.int64) for e in [*held, fresh]])
                    for i in (3, 4))
        hour, day = _counts(code, kind, us)
        n = len(code) - len(new)
        n_old = int((kind[:n] == OWN).sum())
        changed = np.ones(len(hour), dtype=bool)
        if n_old:
            was_hour, was_day = _counts(code[:n], kind[:n], us[:n])
            changed[:n_old] = (was_hour != hour[:n_old]) | (was_day != day[:n_old])
        if changed.any():
            names = list(known)
            yield pd.DataFrame({"key": pd.Series([names[c] for c in code[kind == OWN][changed]]),
                                "id": [ids[i] for i in np.flatnonzero(changed).tolist()],
                                "hour": hour[changed], "day": day[changed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.rows.clear()
        yield from ()

    def close(self) -> None:
        pass


def trailing_counts_stream(events: DataFrame, key: str = "conta_id", ts: str = "data_transacao",
                           row_id: str = "id", hour_col: str = "transactions_last_hour",
                           day_col: str = "transactions_last_day", watermark: str = "1 hour",
                           segment_hours: int = 24, buckets: int = 64) -> DataFrame:
    """Per event of a stream the events of its key in [t - 1 h, t] and
    [t - 24 h, t], peers included: (row_id, key, hour_col, day_col), to be
    written in update mode, the newest row of a ``row_id`` (unique) holding.
    Rows without a key or a time take no part; rows later than ``watermark``
    are dropped.  ``segment_hours`` divides 24: shorter segments spread a hot
    key over more tasks and free state sooner, for 24 / segment_hours copies
    of a row.  Keys (values that Python can hash) are dealt over ``buckets``: more
    of them make a task's share of a segment smaller and the calls to the state
    store more.  Sets the session's state store to RocksDB, which keyed state
    of this kind needs."""
    if segment_hours < 1 or 24 % segment_hours:
        raise ValueError("segment_hours must divide 24")
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    width, m = segment_hours * HOUR_US, 24 // segment_hours
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    flat = events.select(F.col(key).alias("key"), F.col(row_id).alias("id"),
                         F.col(ts).cast("timestamp").alias("ts"), us.alias("us"),
                         F.floor(us / F.lit(width)).cast("long").alias("own"))
    flat = flat.filter(F.col("key").isNotNull() & F.col("us").isNotNull()) \
        .withWatermark("ts", watermark)
    told = lambda ahead, kind: F.struct((F.col("own") + ahead).alias("segment"),
                                        F.lit(kind).alias("kind"))
    last = F.floor((F.col("us") + F.lit(HOUR_US)) / F.lit(width)) > F.col("own")
    copies = F.array(told(0, OWN), F.when(last, told(1, LAST_HOUR)), told(m, LAST_DAY),
                     *[told(i, WHOLE) for i in range(1, m)])
    parts = flat.select("key", "id", "ts", "us", F.explode(copies).alias("c")) \
        .filter(F.col("c").isNotNull()) \
        .select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"),
                F.col("c.segment").alias("segment"), "key", "ts", "us", "id",
                F.col("c.kind").alias("kind"))
    of = {f.name: f.dataType for f in flat.schema.fields}
    out = T.StructType([T.StructField("key", of["key"]), T.StructField("id", of["id"]),
                        T.StructField("hour", T.LongType()), T.StructField("day", T.LongType())])
    counted = parts.groupBy("bucket", "segment").transformWithStateInPandas(
        TrailingCounts(of["key"].simpleString(), of["id"].simpleString(), width), out, "Update", "EventTime")
    return counted.select(F.col("id").alias(row_id), F.col("key").alias(key),
                          F.col("hour").alias(hour_col), F.col("day").alias(day_col))
