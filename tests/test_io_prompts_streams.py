"""Readers / writers, prompt tables and streaming (drained == batch)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators import prompts as pr
from riskloom.sources import io
from riskloom.streaming import jobs


@pytest.fixture()
def tmp(spark):
    return tempfile.mkdtemp(prefix="riskloom-test-", dir="/tmp")


def test_transactions_json_shapes(spark, tmp):
    tx = [{"id": 1, "valor": 10.0}, {"id": 2, "valor": 20.0}]
    for name, payload in (("arr.json", tx), ("obj.json", {"transactions": tx}),
                          ("one.json", tx[0])):
        with open(os.path.join(tmp, name), "w") as f:
            json.dump(payload, f)
    assert io.read_transactions_json(spark, f"{tmp}/arr.json").count() == 2
    assert io.read_transactions_json(spark, f"{tmp}/obj.json").count() == 2
    one = io.read_transactions_json(spark, f"{tmp}/one.json").collect()
    assert len(one) == 1 and one[0]["valor"] == 10.0


def test_metric_log_skips_bad_lines_and_appends(spark, tmp):
    path = f"{tmp}/metrics"
    os.makedirs(path)
    with open(f"{path}/metrics_20240101_00.jsonl", "w") as f:
        f.write(json.dumps({"timestamp": "2024-01-01T00:00:00", "auc_roc": 0.9}) + "\n")
        f.write("{not json\n")
        f.write(json.dumps({"timestamp": "2024-01-01T01:00:00", "auc_roc": 0.8}) + "\n")
    df = io.read_metric_log(spark, path)
    assert [r["auc_roc"] for r in df.collect()] == [0.9, 0.8]
    assert [r["line"] for r in io.bad_lines(spark, path).collect()] == ["{not json"]
    io.append_log(df, f"{tmp}/log", unit="hour")
    back = spark.read.json(f"{tmp}/log")
    assert back.count() == 2 and {"date", "hour"} <= set(back.columns)


def test_feature_view_and_sinks(spark, tmp, tables_small):
    from riskloom.plans.q_features import credit_features_df
    feats = credit_features_df(tables_small)
    io.write_feature_view(feats, f"{tmp}/fv", "2024-01-01")
    io.write_feature_view(feats.limit(5), f"{tmp}/fv", "2024-01-02")
    back = spark.read.parquet(f"{tmp}/fv")
    assert back.filter("snapshot_date = '2024-01-01'").count() == feats.count()
    assert back.filter("snapshot_date = '2024-01-02'").count() == 5
    io.write_decisions_csv(spark.createDataFrame([("c", ["a", "b"])], "id string, g array<string>"),
                           f"{tmp}/csv")
    assert spark.read.option("header", True).csv(f"{tmp}/csv").first()["g"] == "a|b"
    base = spark.createDataFrame([("x", [1.0, 2.0])], "feature string, bins array<double>")
    b2 = io.load_or_build_baseline(spark, f"{tmp}/base", lambda: base)
    assert b2.first()["bins"] == [1.0, 2.0]
    # an unreadable baseline is an error, not a reason to overwrite it
    os.makedirs(f"{tmp}/broken")
    with open(f"{tmp}/broken/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        io.load_or_build_baseline(spark, f"{tmp}/broken", lambda: base).collect()
    assert os.listdir(f"{tmp}/broken") == ["part-0.parquet"]
    assert io.read_by_suffix(spark, "/root/testdata/sf0.001/region.parquet").count() == 5


def test_split_system_and_echo(spark):
    conv = spark.createDataFrame([
        (1, 0, "system", "A"), (1, 1, "user", "oi"), (1, 2, "system", "B"),
        (1, 3, "assistant", "ola"), (2, 0, "user", "primeiro"), (2, 1, "assistant", "fim")],
        "conv_id long, turn long, role string, text string")
    system, turns = pr.split_system(conv)
    s = {r["conv_id"]: r["system_text"] for r in system.collect()}
    assert s == {1: "A\n\nB", 2: None}
    assert turns.count() == 4
    echo = {r["conv_id"]: r["content"] for r in pr.last_user_echo(conv).collect()}
    assert echo == {1: "[mock] oi", 2: "[mock] primeiro"}


def test_registry_and_run_prompts(spark):
    with pytest.raises(ValueError):
        pr.create({"provider": "nao-existe"})
    with pytest.raises(ValueError):
        pr.create({})
    calls = {"n": 0}

    def flaky(messages):
        calls["n"] += 1
        if "falha" in messages[-1]["content"]:
            raise RuntimeError("provider down")
        return "ok " + messages[-1]["content"]
    pr.register_provider("flaky", lambda cfg: flaky)
    tasks = spark.createDataFrame([("t1", "pergunta", "sis", "ctx", ["a"]),
                                   ("t2", "falha", None, None, None)],
                                  "name string, prompt string, system string, context string, "
                                  "tags array<string>")
    out = {r["name"]: r for r in pr.run_prompts(tasks, pr.create({"provider": "flaky"}),
                                                max_retries=2, backoff_seconds=0).collect()}
    assert out["t1"]["success"] and out["t1"]["content"].startswith("ok ## Contexto\nctx")
    assert not out["t2"]["success"] and out["t2"]["retries"] == 2
    assert out["t2"]["error"] == "provider down"
    msgs = pr.build_messages(tasks).filter("name = 't1'").first()["messages"]
    assert [m["role"] for m in msgs] == ["system", "user"]


def test_stream_equals_batch(spark, tables_small):
    from riskloom.sources import fixtures as fx

    class T:
        pass
    t = T()
    t.events = jobs.table_stream(spark, tables_small.sf_dir, "events")
    drained = jobs.drain(jobs.metrics_hourly(t.events), ["hora"], "test-x4")
    batch = jobs.metrics_hourly(tables_small.events)
    a = sorted(tuple(r) for r in drained.select("hora", "predictions_count", "error_count").collect())
    b = sorted(tuple(r) for r in batch.select("hora", "predictions_count", "error_count").collect())
    assert a == b
    s = fx.fx_fraude(t)
    v = jobs.drain(jobs.velocity(s), ["conta_id", "inicio", "fim"], "test-x3")
    assert v.agg(F.sum("n")).first()[0] == tables_small.events.count()


def test_stream_over_shuffled_files(spark, tables_small, tmp):
    """Several files in no order of time, one a batch: with a lateness that
    covers the disorder the drained stream equals the batch."""
    ev = tables_small.events.withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(6, "event_id").write.parquet(f"{tmp}/ev")
    src = jobs.file_stream(spark, f"{tmp}/ev", ev.schema, max_files_per_trigger=1)
    got = jobs.drain(jobs.metrics_hourly(src, watermark="60 days"), ["hora"], "test-files")
    cols = ["hora", "predictions_count", "error_count"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(
        map(tuple, jobs.metrics_hourly(ev).select(*cols).collect()))


def test_watermark_bounds_the_state(spark, tables_small, tmp):
    """In order of time, one file a batch: append mode is accepted and old
    windows leave the state."""
    ev = tables_small.events.withColumn("ts", F.col("ts").cast("timestamp"))
    for i, lo in enumerate(range(0, 30, 5)):
        day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
        ev.filter((day >= lo) & (day < lo + 5)).coalesce(1).write.parquet(f"{tmp}/in/b{i}")
        for name in os.listdir(f"{tmp}/in/b{i}"):
            if name.startswith("part-"):
                os.makedirs(f"{tmp}/src", exist_ok=True)
                os.link(f"{tmp}/in/b{i}/{name}", f"{tmp}/src/{i}-{name}")
    src = jobs.file_stream(spark, f"{tmp}/src", ev.schema, max_files_per_trigger=1)
    q = (jobs.metrics_hourly(src, watermark="1 hour").writeStream.outputMode("append")
         .format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    hours = jobs.metrics_hourly(ev).count()
    assert rows and rows[-1] < hours / 3
    assert spark.read.parquet(f"{tmp}/out").count() > hours / 2
