"""Cases of the second review outside the corpus operators."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import ml


def test_tuning_judges_on_all_rows(spark, monkeypatch):
    """The reported AUC is the one of the final model's learner over more
    validation rows than any sample held."""
    trials = [dict(maxIter=2, maxDepth=1), dict(maxIter=3, maxDepth=3)]
    monkeypatch.setattr(ml, "trial_params", lambda n, seed: trials)
    df = spark.range(24_000).select(
        "id", (F.col("id") % 601).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    # one feature vector, of one class, holds a third of the validation rows
    df = df.withColumns({"a": F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("a")),
                         "b": F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("b"))})
    noise = F.pmod(F.xxhash64("id"), F.lit(400))
    df = df.withColumn("y", F.when(F.col("id") % 3 == 0, 0).otherwise(
        (F.col("a") + noise > 500).cast("int")))
    train = df.filter("id < 2000")
    best = ml.tune(train, df, ["a", "b"], "y", n_trials=2)
    want = []
    for params in trials:
        model = ml.train_gbt(train, ["a", "b"], "y", {**ml.CREDIT_GBT, **params}, 42)
        p, y = map(np.array, zip(*ml.positive_prob(model.transform(df)).select("p", "y").collect()))
        _, at, n = np.unique(p, return_inverse=True, return_counts=True)
        rank = (np.cumsum(n) - (n - 1) / 2)[at]
        pos = int((y == 1).sum())
        want.append((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))
    assert abs(best["auc"] - max(want)) < 1e-9
    assert best["params"] == trials[int(np.argmax(want))]


def test_json_documents_do_not_grow_with_the_table(spark, monkeypatch):
    """Rows of far more orders than 64 documents should hold."""
    from types import SimpleNamespace
    from riskloom.plans import q_io
    sizes, read = [], q_io.io.read_transactions_json

    def counted(session, path):
        sizes.extend(r["n"] for r in session.read.text(path).select(
            F.size(F.from_json("value", "transactions array<struct<id: long>>")["transactions"])
            .alias("n")).collect())
        return read(session, path)
    monkeypatch.setattr(q_io.io, "read_transactions_json", counted)
    n = 400_000
    lines = spark.range(n).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
                                  F.lit(2.5).alias("l_extendedprice"))
    out = q_io.q_read_transactions_json(SimpleNamespace(spark=spark, lineitem=lines))
    assert out.count() == n and sum(sizes) == n
    assert max(sizes) <= 4096
