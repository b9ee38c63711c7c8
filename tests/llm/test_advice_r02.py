"""Cases of the second review: each failed (or never ended) before its change."""

from pyspark.sql import functions as F


def test_every_shape_gets_surrogates(spark):
    """Values without letters or digits, and shapes with more entities than
    values, end with distinct surrogates."""
    from riskloom.llm.pii import surrogate, surrogate_attempts
    low = "abcdefghijklmnopqrstuvwxyz"
    values = [("secret", "********"), ("secret", "________"), ("secret", "xoxb--------")]
    values += [("secret", f"{c}*****") for c in low + "é"]
    values += [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)]
    # unlike detected ones, so short that all values of the shape are entities
    values += [(k, f"{i}") for k in ("ssn", "phone", "number") for i in range(10)]
    ents = spark.createDataFrame(values, "kind string, value string")
    got = surrogate_attempts(ents, b"k").collect()
    assert sorted((r["kind"], r["value"]) for r in got) == sorted(values)
    assert len({(r["kind"], r["made"]) for r in got}) == len(values)
    assert not {(r["kind"], r["made"]) for r in got} & set(values)
    for kind, value in (("ip", "1.1.1.1"), ("iban", "DE00 0000 0000 0000"), ("email", "a@b.de"),
                        ("surname", "Li"), ("given_u", "Li"), ("secret", "******"), ("ssn", "1")):
        assert len({surrogate(b"k", kind, value, n) for n in range(40, 200)}) > 155, kind


def test_a_starred_password_ends(spark):
    from riskloom.llm.pii import private_documents
    df = spark.createDataFrame([(1, "Password: ********, token=______"), (2, "none")],
                               "doc_id long, text string")
    got = dict(private_documents(df, b"k").collect())
    assert got[2] == "none" and got[1].startswith("Password: ")
    assert "********" not in got[1] and "______" not in got[1]


def test_names_and_digits_of_all_scripts(spark):
    from riskloom.llm.pii import _candidates, detect, private_documents
    import pyarrow as pa

    def found(text):
        return [(text[a:b], k) for a, b, k in detect(text)]
    assert found("Mr McDonald left") == [("McDonald", "surname")]
    assert found("Mr O'Neil's and Mr D’Angelo") == [("O'Neil", "surname"), ("D’Angelo", "surname")]
    assert found("Anna Wałęsa") == [("Anna", "given_f"), ("Wałęsa", "surname")]
    assert found("Frau Müller-Lüdenscheidt.") == [("Müller-Lüdenscheidt", "surname")]
    # bare mentions, before and after, alone and as a part
    assert found("Schmidt and Frau Schmidt; Schmidt-Bau, Schmidts, PeterSchmidt") == \
        [("Schmidt", "surname")] * 3
    assert found("Schmidt and Bau") == []
    texts = ["+٩٧١ ٥٠ ١٢٣ ٤٥٦٧", "+123456", "１２３４５６７８９", "GB८२ WEST 1234 5698 7654", "१.१.१.१",
             "paſſword: abcdefg", "toKen=abcdefg", "Mr Łoś", "x@y.zz", "123-45-6789"]
    assert all(detect(t) for t in texts)
    assert _candidates(pa.array(texts)) == list(range(len(texts)))
    df = spark.createDataFrame([(0, texts[0]), (1, f"x@y.zz {texts[0]}"),
                                (2, "Frau Müller-Lüdenscheidt, Müller-Lüdenscheidt")],
                               "doc_id long, text string")
    got = dict(private_documents(df, b"k").collect())
    assert got[0] != texts[0] and got[1].endswith(" " + got[0])
    assert all(c.isdecimal() == d.isdecimal() and c.isascii() == d.isascii()
               for c, d in zip(got[0], texts[0]))
    a, b = got[2].removeprefix("Frau ").split(", ")
    assert a == b and a.count("-") == 1 and "Müller" not in a


def test_prefilter_rejects_no_entity():
    """Texts drawn from the patterns' alphabets: no hit is rejected."""
    import random
    from riskloom.llm.pii import _candidates, detect
    import pyarrow as pa
    r = random.Random(1)
    bits = ["+", "1", "23", "4567", " ", ".", "-", "(", ")", "٣", "٤٥", "७८", "@", "a.b", "x.de",
            "token", "PASSWD", "Api-Key", "=", ": ", "Mr", "Anna", "Łoś", "O'Neil", "DE", "AB12"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(2, 14))) for _ in range(60_000)]
    kept = set(_candidates(pa.array(texts)))
    hits = [i for i, t in enumerate(texts) if detect(t)]
    assert len(hits) > 3000 and kept.issuperset(hits)


def test_rows_with_one_narrow_key_stay_apart(spark):
    """Two ids whose 48-bit hashes with this text are equal: the second is a
    copy of the first, which keeps its words."""
    from riskloom.llm.substring import without_repeats
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1730911, text), (38680842, text)], "doc_id long, text string")
    low = df.select(F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 48) - 1)).alias("k"))
    assert low.distinct().count() == 1
    got = {r["doc_id"]: r["n_removed"] for r in without_repeats(df).collect()}
    assert got == {1730911: 0, 38680842: 25}


def test_row_numbers():
    """One number for equal rows, another for all others, in any order."""
    import pyarrow as pa
    from riskloom.llm.substring import _numbers
    rows = [(7, 1, "a"), (7, 1, "a"), (7, 1, "b"), (7, 1, None), (7, 2, "a"), (17, 1, "a"), (7, 1, "")]
    want = None
    for turn in range(len(rows)):
        mine = rows[turn:] + rows[:turn]
        key, doc, text = zip(*mine)
        got = _numbers(pa.table({"key": pa.array(key, pa.int64()), "ord": pa.array(doc, pa.int64()),
                                 "text": pa.array(text, pa.string())}), 10)
        assert (got % 10 == 7).all()
        pairs = dict(zip(mine, got.tolist()))
        assert len(set(pairs.values())) == len(set(rows)) and want in (None, pairs)
        want = pairs


def test_one_row_of_each_component(spark):
    """Repeated rows, one id with linked or unlinked texts, null ids."""
    from riskloom.llm.jaccard import one_of_each

    def text(c, n=40):
        return " ".join(f"{c}{i}" for i in range(n))
    rows = ([(1, text("a"))] * 5 + [(2, text("a"))] * 3 + [(None, text("a"))]  # one component
            + [(3, text("b")), (3, text("b") + " x"), (3, text("c"))]  # two of one id
            + [(None, text("d"))] * 4 + [(None, text("d") + " x")]  # no id at all
            + [(4, ""), (4, ""), (5, "")] + [(6, text("e"))] * 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"row": F.monotonically_increasing_id(), "first": F.lit(1), "n": F.lit(2)}).repartition(4)
    got = one_of_each(df)
    assert got.columns == df.columns
    got = got.collect()
    groups = sorted((r["doc_id"] or 0, (r["text"] or "-")[:1]) for r in got)
    assert groups == [(0, "d"), (1, "a"), (3, "b"), (3, "c"), (4, "-"), (5, "-"), (6, "e")]
    given = {(r["row"], r["doc_id"], r["text"]) for r in df.collect()}
    assert {(r["row"], r["doc_id"], r["text"]) for r in got} <= given


def test_items_without_an_id_count(spark):
    """Against the registered SQL: a null id is one more item without a name."""
    import duckdb
    import pandas as pd
    from riskloom.llm.decontam import contamination, decontaminated
    from riskloom.llm.queries import oracle_sql
    a, b = (" ".join(f"{c}{i}" for i in range(14)) for c in "ab")
    rows = [(1, f"x {a} y"), (2, f"{b} {a}"), (3, b), (4, "clean"), (5, None)]
    items = [(None, a), (7, b), (None, "clean not"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    benchmark = pd.DataFrame({"item_id": pd.array([i for i, _ in items], "Int64"),  # noqa: F841
                              "text": [t for _, t in items]})
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    want = sorted(con.execute(oracle_sql()["op9_benchmark_decontamination"]).fetchall())
    for block_words in (1_000_000, 2):
        got, name = contamination(docs, bench, block_words=block_words)
        r = F.col(name)
        n_hit = F.aggregate(r["spans"], F.lit(0).cast("long"), lambda x, s: x + s["end"] - s["start"])
        got = got.select("doc_id", r["n_words"], n_hit, F.size(r["items"]), F.sha2(
            F.array_join(r["items"], ",").cast("binary"), 256), F.size(r["spans"]) > 0)
        assert sorted(map(tuple, got.collect())) == want
    assert [r[5] for r in want] == [True, True, True, False, False]
    assert sorted(r["doc_id"] for r in decontaminated(docs, bench).collect()) == [4, 5]


def test_pipeline_ends_with_token_ids(spark):
    """The last stage's result gives the sequences without tokenising again."""
    import corpus_pipeline as P
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer
    from riskloom.llm.packing import packed_sequences
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, f"document {i} " + "some words here " * (i * 17 % 900)) for i in range(60)]
    rows += [(7, rows[7][1]), (60, None)]
    out = P.packing(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").persist()
    got = {}
    for r in out.collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        got.setdefault(r["doc_id"], []).append((r["start"], ids))
    for i, t in rows:
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(got[i])[::2 if i == 7 else 1]
        assert [x for _, ids in mine for x in ids] == want
    seqs = [len(r["ids"]) // 4 for r in packed_sequences(out).collect()]
    assert max(seqs) <= 2048 and sum(seqs) == sum(r["length"] for r in out.collect())
    out.unpersist()


def test_identical_pieces_are_dealt_over_parts(spark):
    """A third of the rows being one row makes no part larger."""
    from riskloom.llm.packing import pack
    rows = [(1, 700)] * 3000 + [(i, 300 + i % 900) for i in range(2, 6002)]
    out = pack(spark.createDataFrame(rows, "id long, length long"), part_pieces=500).collect()
    assert sorted((r["id"], r["length"]) for r in out) == sorted(rows)
    parts = {}
    for r in out:
        at = r["sequence_id"] >> 24
        parts[at] = parts.get(at, 0) + 1
    assert max(parts.values()) < 1000


def test_training_rows_are_cut_before_the_driver(spark, monkeypatch):
    """A labelled id in many document rows: the driver gets ``max_rows``."""
    from pyspark.sql import DataFrame
    from riskloom.llm.quality import held_out, training_rows
    sent, was = [], type(spark.range(1)).toPandas

    def counted(df: DataFrame):
        got = was(df)
        sent.append(len(got))
        return got
    monkeypatch.setattr(type(spark.range(1)), "toPandas", counted)
    ids = [r["id"] for r in spark.range(40).where(~held_out("id")).collect()][:4]
    docs = spark.createDataFrame([(ids[0], f"text {i:03}") for i in range(300)]
                                 + [(i, "one") for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int")
    how = dict(id_col="doc_id", text_col="text", label_col="quality", max_chars=100)
    texts, y = training_rows(docs, labels, max_rows=10, **how)
    assert texts == [f"text {i:03}" for i in range(10)] and y == [0] * 10 and sent == [10]
