"""How many texts Python gets at a time."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import frames, jaccard

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _docs(spark, n):
    """Texts of about 5 KB in one partition, none like another."""
    return spark.range(0, n, 1, 1).select(
        F.col("id").alias("doc_id"), F.expr(
            "concat_ws(' ', transform(sequence(1, 500), x -> concat('w', id * 1000 + x)))").alias("text"))


def _spying(real, at):
    def made(*args):
        kernel = real(*args)

        def run(batches):
            def seen():
                for b in batches:
                    with open(f"{at}/{os.getpid()}", "a") as f:
                        f.write(f"{b.nbytes}\n")
                    yield b
            yield from kernel(seen())
        return run
    return made


def test_texts_of_the_join_come_in_small_batches(spark, tmp_path, monkeypatch):
    before = spark.conf.get(BYTES)
    monkeypatch.setattr(jaccard, "_sign", _spying(jaccard._sign, str(tmp_path)))
    got = jaccard.components_of_similar(_docs(spark, 3000), num=9, den=10, shingle=3)
    assert got.where("id = component_id").count() == 3000
    sizes = [int(x) for p in tmp_path.iterdir() for x in p.read_text().split()]
    assert sum(sizes) > 2 * frames.TEXT_BATCH and max(sizes) < 1.1 * frames.TEXT_BATCH
    assert spark.conf.get(BYTES) == before


def test_stages_of_the_pipeline_bound_batches_unless_the_session_does(spark):
    before = spark.conf.get(BYTES)
    try:
        corpus_pipeline.near_duplicates(spark, _docs(spark, 3), "")
        assert int(spark.conf.get(BYTES).rstrip("b")) == frames.TEXT_BATCH
        spark.conf.set(BYTES, "1000000")
        corpus_pipeline.near_duplicates(spark, _docs(spark, 3), "")
        assert int(spark.conf.get(BYTES).rstrip("b")) == 1_000_000
    finally:
        spark.conf.set(BYTES, before)
