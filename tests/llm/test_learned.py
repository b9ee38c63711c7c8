"""The quality classifier on held-out rows, and the pipeline's stages."""

import binascii

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    from riskloom.llm.queries import queries
    got = queries()["op2_quality_classifier"](spark, "/root/testdata/sf0.1")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    rows = [r for r in rows if r["held_out"]]
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([np.mean(np.array(good) > b) for b in bad])
    assert auc > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_gradients_match_differences():
    from riskloom.llm import quality as Q
    p = {k: v.astype(np.float64) for k, v in Q.init_weights(3).items()}
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    data, first = Q.laid_out(pa.array(["abc def " * 60, "", "XYZ!! " * 90]))
    y = np.array([1.0, 0.0, 0.0])
    s, g = Q.gradients(p32, data, first, y, np.ones(3))

    def loss(w):
        s = Q.forward({k: v.astype(np.float32) for k, v in w.items()}, data, first)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))
    for k in ("w2", "b2", "w1", "w"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        eps = 2e-3
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += eps
        down[k][i] -= eps
        diff = (loss(up) - loss(down)) / (2 * eps)
        assert abs(diff - g[k][i]) < 0.05 * abs(diff) + 2e-3


def test_scores_cover_whole_texts(spark):
    """A score depends on bytes anywhere, not on the slice or batch."""
    from riskloom.llm import quality as Q
    p = Q.init_weights(1)
    texts = pa.array(["a" * 50_000, "a" * 49_000 + "Zq!!" * 250, "", None, "x"])
    s = Q.score_texts(p, texts)
    assert s[0] != s[1] and s[2] == s[3]
    assert np.allclose(s, [Q.score_texts(p, texts[i:i + 1])[0] for i in range(5)], atol=1e-6)


def test_quality_cases(spark):
    from riskloom.llm.quality import good_documents, quality_scores
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "z")],
                                 "doc_id long, text string").withColumn("score", F.lit(1))
    none = spark.createDataFrame([(3, None), (3, 1)], "doc_id long, quality int")
    out, name = quality_scores(docs, none, carry=("score",))
    assert name == "score_1" and {r[name] for r in out.collect()} == {0.5}
    assert good_documents(docs, none).columns == docs.columns
    assert good_documents(docs.limit(0), none).count() == 0


def test_pipeline(spark):
    """Stage by stage on the small table, each against brute force on its own
    input."""
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    from riskloom.llm.frames import staged
    from riskloom.llm.pii import detect
    from .test_exact import brute_components, brute_hits
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "t")
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        kept.append({r["doc_id"]: r for r in docs.collect()})
    all_docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept[0] for i in clean]) > 0.97
    assert np.mean([i in kept[0] for i, q in labels.items() if q == 0]) < 0.4
    rows = [(i, r["text"]) for i, r in sorted(kept[0].items())]
    assert set(kept[1]) == {i for i, _, c in brute_components(rows, 4, 5, 5) if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet")
             .select("item_id", "text").collect()]
    rows = [(i, r["text"]) for i, r in sorted(kept[1].items())]
    assert set(kept[2]) == {i for i, _, n, _ in brute_hits(rows, items) if not n}
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        t = all_docs[i]["text"]
        assert len(r["text"]) == r["n_chars"]
        assert (r["text"] == t) == (not detect(t))
        assert not any(t[a:b] in r["text"] for a, b, k in detect(t) if b - a > 8)
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {}
    for r in packed:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["length"]
    assert size == {i: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
                    for i, r in kept[3].items()}
