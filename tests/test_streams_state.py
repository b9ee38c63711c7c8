"""X3 on keyed state and the idempotent sinks."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators.windows import trailing_counts
from riskloom.streaming import jobs, sinks, trailing


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="riskloom-streams-")


SCHEMA = "id long, conta_id string, data_transacao timestamp"


def _files(spark, tmp, batches):
    """One parquet file a batch, read in this order."""
    src = f"{tmp}/src"
    os.makedirs(src)
    for i, rows in enumerate(batches):
        (spark.createDataFrame(rows, "id long, conta_id string, us long")
         .select("id", "conta_id", F.timestamp_micros("us").alias("data_transacao"))
         .coalesce(1).write.parquet(f"{tmp}/in/{i}"))
        name = next(n for n in os.listdir(f"{tmp}/in/{i}") if n.startswith("part-"))
        os.link(f"{tmp}/in/{i}/{name}", f"{src}/{i:03d}.parquet")
        os.utime(f"{src}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return src


@pytest.mark.parametrize("segment_hours", [24, 6, 1])
def test_trailing_counts_stream_equals_batch(spark, tmp, segment_hours):
    """Rows in disorder over several batches, a hot key, peers, times on the
    frames' edges, a null key and a null time."""
    rng = random.Random(segment_hours)
    hour, start = 3_600_000_000, 1_704_067_200_000_000
    rows = []
    for i in range(240):
        key = "hot" if i % 3 == 0 else rng.choice("abcd")
        us = start + rng.randrange(0, 72) * hour // 2
        rows.append((i, key, us + rng.choice([0, 0, 1, -1])))
    rows += [(900, None, start), (901, "a", None)]
    rng.shuffle(rows)
    src = _files(spark, tmp, [rows[i::4] for i in range(4)])
    stream = jobs.file_stream(spark, src, SCHEMA, max_files_per_trigger=1)
    got = jobs.drain(trailing.trailing_counts_stream(
        stream, watermark="10 days", segment_hours=segment_hours), ["id", "conta_id"], "t-x3")
    batch = trailing_counts(spark.read.parquet(src).dropna())
    cols = ["id", "conta_id", "transactions_last_hour", "transactions_last_day"]
    assert sorted(map(tuple, got.select(*cols).collect())) == \
        sorted(map(tuple, batch.select(*cols).collect()))
    assert got.count() == 240


def test_trailing_state_expires(spark, tmp):
    """In order of time: the state holds the last day or two, not the stream."""
    hour, start = 3_600_000_000, 1_704_067_200_000_000
    days = [[(d * 24 + h, "a", start + (d * 24 + h) * hour) for h in range(24)] for d in range(8)]
    src = _files(spark, tmp, days)
    stream = jobs.file_stream(spark, src, SCHEMA, max_files_per_trigger=1)
    q = (trailing.trailing_counts_stream(stream, watermark="1 hour", segment_hours=6)
         .writeStream.outputMode("update").foreachBatch(sinks.batch_writer(f"{tmp}/out"))
         .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    got = jobs.newest(sinks.read_batches(spark, f"{tmp}/out"), ["id", "conta_id"])
    last = {r["id"]: (r[2], r[3]) for r in got.collect()}
    assert last[0] == (1, 1) and last[30] == (2, 25) and last[191] == (2, 25)
    assert len(last) == 192 and held[-1] <= max(held[:3])


def test_state_follows_buckets_not_keys(spark, tmp):
    """Many accounts share a state entry and the counts stay their own."""
    rng = random.Random(5)
    hour, start = 3_600_000_000, 1_704_067_200_000_000
    rows = [(i, f"k{rng.randrange(120)}", start + rng.randrange(0, 96) * hour // 2) for i in range(600)]
    src = _files(spark, tmp, [rows[:300], rows[300:]])
    stream = jobs.file_stream(spark, src, SCHEMA, max_files_per_trigger=1)
    q = (trailing.trailing_counts_stream(stream, watermark="10 days", buckets=4)
         .writeStream.outputMode("update").foreachBatch(sinks.batch_writer(f"{tmp}/out"))
         .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    got = jobs.newest(sinks.read_batches(spark, f"{tmp}/out"), ["id", "conta_id"])
    batch = trailing_counts(spark.read.parquet(src))
    cols = ["id", "conta_id", "transactions_last_hour", "transactions_last_day"]
    assert sorted(map(tuple, got.select(*cols).collect())) == \
        sorted(map(tuple, batch.select(*cols).collect()))
    assert max(held) < 200  # of about 700 pairs of account and day


def test_segment_hours_must_divide_a_day(spark, tmp):
    src = _files(spark, tmp, [[(1, "a", 0)]])
    with pytest.raises(ValueError):
        trailing.trailing_counts_stream(jobs.file_stream(spark, src, SCHEMA), segment_hours=7)


def test_replayed_batch_counts_once(spark, tmp, monkeypatch):
    """Killed between a batch's write and the commit, then restarted: every
    batch is there once, and the half-done one was not visible before."""
    src = _files(spark, tmp, [[(b * 10 + i, "a", b * 1_000_000) for i in range(5)]
                              for b in range(3)])
    stream = jobs.file_stream(spark, src, SCHEMA, max_files_per_trigger=1)
    real, seen = sinks._commit, []

    def dies_once(session, path, batch_id):
        seen.append(batch_id)
        if seen == [0, 1]:
            raise RuntimeError("killed")
        real(session, path, batch_id)
    monkeypatch.setattr(sinks, "_commit", dies_once)

    def run():
        q = (stream.writeStream.foreachBatch(sinks.batch_writer(f"{tmp}/out"))
             .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    with pytest.raises(Exception, match="killed"):
        run()
    assert spark.read.parquet(f"{tmp}/out/{sinks.DATA}").count() == 10
    assert sinks.read_batches(spark, f"{tmp}/out").count() == 5
    run()
    got = sinks.read_batches(spark, f"{tmp}/out")
    assert sorted(r["id"] for r in got.collect()) == sorted(b * 10 + i for b in range(3)
                                                            for i in range(5))
    assert [r["batch_id"] for r in got.select("batch_id").distinct().sort("batch_id").collect()] \
        == [0, 1, 2]
    assert seen == [0, 1, 1, 2]
