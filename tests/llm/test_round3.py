"""Centroid clustering, Merkle manifests and certified quality rules against
brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SPACE = re.compile("[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# -------------------------------------------------------------------- centroids

def brute_clusters(rows, dims, k, rounds, seed=2):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    order = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, sha(f"{seed}:{r[0]}")),
                                        r[1]))
    cents = [v for _, v in order[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c
                 for j, c in enumerate(cents)]
    return sorted(((i, best(v)[1], best(v)[0]) for i, v in kept), key=str), cents


def vectors(seed=1, n=300, dims=8):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [m + r.gauss(0, .1) for m in r.choice(middles)]) for i in range(n)]
    rows += [(5, rows[9][1])] * 40 + [(None, rows[3][1]), (None, None), (n, None), (n + 1, []),
                                      (n + 2, [0.5] * (dims - 1)), (n + 3, [None] * dims),
                                      (n + 4, [float("nan")] * dims), (n + 5, [math.inf] * dims),
                                      (n + 6, [0.0] * dims), (n + 7, [-0.25] * dims)]
    return rows


@pytest.mark.parametrize("k", [1, 7, 2000])
def test_clusters_equal_brute_force(spark, k):
    from riskloom.llm.centroids import cluster, with_inertia
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>") \
        .withColumns({"cluster": F.lit("x"), "id": F.lit(0), "v": F.lit(1)}).repartition(4)
    got = cluster(df, dims=8, k=k, rounds=3)
    want, cents = brute_clusters(rows, 8, k, 3)
    assert got.centroids.tolist() == cents
    out = with_inertia(got).collect()
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in out), key=str) == want
    assert {r["inertia"] for r in out} == {sum(d for _, _, d in want)}
    for r in out:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == sha(",".join(map(str, cents[r["cluster"]])))


def test_clusters_bounds_save_distances(spark):
    from riskloom.llm.centroids import cluster
    df = spark.createDataFrame(vectors(n=600), "vec_id long, embedding array<double>")
    got = cluster(df, dims=8, k=20, rounds=4)
    rows = got.rows.count()
    assert len(got.tried) == 4 and all(rows <= t < 20 * rows for t in got.tried)


def test_nearest_keeps_ties_and_large_values():
    from riskloom.llm.centroids import far_apart, nearest, pivot_distances
    r = np.random.default_rng(0)
    x = r.integers(-3, 4, (500, 4)).astype(np.int64)
    cents = r.integers(-3, 4, (30, 4)).astype(np.int64)
    for scale in (1, 1 << 24):
        pivots = far_apart(x * scale, 5)
        who, d, _ = nearest(x * scale, pivot_distances(x * scale, pivots), cents * scale,
                            pivot_distances(cents * scale, pivots))
        full = (((x[:, None] - cents) * scale) ** 2).sum(axis=2)
        assert (who == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()


def test_clusters_of_nothing(spark):
    from riskloom.llm.centroids import cluster, with_inertia
    for rows in ([], [(1, None), (2, [1.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert with_inertia(cluster(df)).count() == 0


# ----------------------------------------------------------------------- merkle

def brute_manifest(leaves, fan=16):
    """{(group, key, leaf): [(subroot, root, segments)]} of (group, key, leaf) rows."""
    def tree(nodes):
        """root and per node the [(left, right)] segments"""
        paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, own = [], []
            for s in range(0, len(nodes), fan):
                run = nodes[s:s + fan]
                for j in range(len(run)):
                    for i in owners[s + j]:
                        paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
                up.append(sha("".join(run)))
                own.append(sum(owners[s:s + fan], []))
            nodes, owners = up, own
        return nodes[0], paths
    groups = {}
    for g, k, leaf in leaves:
        groups.setdefault(g, []).append((k, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subs.append(tree([leaf for _, leaf in groups[g]]))
    root, above = tree([s for s, _ in subs])
    out = []
    for g, (sub, paths), up in zip(names, subs, above):
        for (k, leaf), p in zip(groups[g], paths):
            out.append((g, k, leaf, sub, p + up))
    return root, out


def key_of(r):
    return str(r)


@pytest.mark.parametrize("fan,seed", [(2, 0), (3, 1), (16, 2)])
def test_manifest_equals_brute_force(spark, fan, seed):
    from riskloom.llm.merkle import folded, manifest
    r = random.Random(seed)
    sizes = {"hot": 700, "b": 1, "": 2, None: fan, "é": fan + 1, "z": fan * fan,
             "zz": fan * fan + 1, "a": 3 * fan}
    leaves = [(g, r.randrange(n), sha(str(r.random()))) for g, n in sizes.items()
              for _ in range(n)]
    leaves += [("hot", None, sha("q")), ("b", 4, sha("same")), ("b", 4, sha("same"))]
    df = spark.createDataFrame(leaves, "source string, doc_id long, leaf string") \
        .withColumns({"pos": F.lit("p"), "grp": F.lit(1), "h": F.lit("h"), "segments": F.lit(2)}) \
        .repartition(5)
    m = manifest(df, group="source", key="doc_id", fan=fan)
    assert (m.subroot, m.segments) == ("subroot", "segments_1")
    root, want = brute_manifest(leaves, fan)
    assert m.root == root
    got = m.proofs.withColumn("up", folded(F.col("leaf"), F.col(m.segments))).collect()
    assert {g["up"] for g in got} == {root} and {g["pos"] for g in got} == {"p"}
    assert sorted(((g["source"], g["doc_id"], g["leaf"], g["subroot"],
                    [tuple(s) for s in g[m.segments]]) for g in got), key=key_of) \
        == sorted(want, key=key_of)


def test_manifest_query_on_awkward_rows(spark, tmp_path):
    from riskloom.llm.queries import queries
    rows = [(1, "Text A", "en", "s1", 6), (1, "Text A", "en", "s1", 6), (None, None, None, None, None),
            (7, None, "de", None, 0), (8, "", "de", "s1", 0), (9, "ÄB c", "de", "s2", 4),
            (10, "x" * 300_000, "en", "s2", 5)] + [(i, f"T {i}", "en", "s3", 3)
                                                   for i in range(20, 120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .withColumn("leaf", F.lit("clash")).repartition(3) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op12_merkle_manifest"](spark, str(tmp_path)).collect()

    def leaf(doc, text):
        vals = [doc[0], doc[3], doc[2], doc[4], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    root, want = brute_manifest([(d[3], d[0], leaf(d, d[1])) for d in rows])
    other = {leaf(d, d[1]): leaf(d, d[1].translate(low)) for d in rows
             if d[1] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0}
    exp = []
    for g, k, x, sub, segs in want:
        up = other.get(x, x)
        for a, b in segs:
            up = sha(a + up + b)
        exp.append((k, x, sub, root, sha("".join(a + b for a, b in segs)), up, up == root))
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == sorted(exp, key=str)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_nothing(spark):
    from riskloom.llm.merkle import manifest
    df = spark.createDataFrame([], "doc_id long, source string, leaf string")
    m = manifest(df, group="source", key="doc_id")
    assert m.root is None and m.proofs.count() == 0
    one = spark.createDataFrame([(1, None, "ab" * 32)], "doc_id long, source string, leaf string")
    m = manifest(one, group="source", key="doc_id")
    assert m.root == "ab" * 32 and m.proofs.first()["segments"] == []


# ------------------------------------------------------------------------ rules

def brute_measures(text):
    text = text or ""
    w = SPACE.findall(text)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {p for i, t in enumerate(tri) if tri.count(t) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), len(lines),
            sum("A" <= c <= "Z" for c in text))


def test_measures_equal_brute_force():
    from riskloom.llm.rules import MEASURES, measured_batch
    r = random.Random(4)
    vocab = ["a", "b", "the", "Ört", "né", "x#", "**", "<b>", "A|B", " ", "\x1c", "\x85q"]
    texts = [None, "", " \n\t ", "one", "a b", "a b a", "\n\n", "a a a a", "L\nL\nL \r\nL", "x\x00y"]
    for _ in range(150):
        texts.append("".join(r.choice(vocab) + r.choice([" ", "  ", "\n", "\t"])
                             for _ in range(r.randrange(60))))
    got = measured_batch(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(got[m][i]) for m in MEASURES) == brute_measures(t), t
    sliced = measured_batch(pa.array(texts, pa.string()).slice(20, 30))
    assert sliced["n_symbols"].tolist() == got["n_symbols"][20:50].tolist()


def test_tail_is_the_exact_binomial():
    from riskloom.llm.rules import tail
    for n, x, p in ((5, 0, .1), (40, 3, .05), (2000, 7, .01), (3, 3, .2)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(x + 1))
        assert math.isclose(tail(x, n, p), want, rel_tol=1e-9)
    assert tail(0, 0, .1) == 1


def text_of(r, junk):
    w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    return " ".join(x + "###" if junk else x for x in w)


def test_rules_reject_junk_and_spare_good_documents(spark):
    from riskloom.llm.rules import base_failed, judged
    r = random.Random(9)
    docs, labels = [], []
    for i in range(2400):
        junk, lang = i % 6 == 0, "en" if i % 40 else "fr"
        docs.append((i, text_of(r, junk), lang))
        labels.append((i, 0 if junk else 1))
    docs += [(3000, None, "en"), (3001, "", None), (3002, "few words", "en"), (None, "x", "en"),
             (3003, "a b c " * 90, "en"), (7, docs[7][1], "en"), (3004, "word " * 400_000, "fr")]
    labels += [(1, 0), (1, None), (9999, 1), (None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string") \
        .withColumns({"measures": F.lit(1), "cutoffs": F.lit("c"), "rejected_by": F.lit(0)}) \
        .repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got, m, why = judged(df, lab, alpha=0.05)
    rows = {(r["doc_id"]): r for r in got.withColumn("bad", base_failed(F.col(m))).collect()}
    assert got.count() == len(docs)
    for i in range(2400):
        hit = rows[i][why]
        if rows[i]["lang"] == "en":
            assert hit == (["symbols"] if i % 6 == 0 else []), i
        else:  # 60 labelled documents certify nothing at this risk
            assert hit == []
    assert all(rows[i]["bad"] for i in (3000, 3001, 3002, None, 3003, 3004)) and not rows[7]["bad"]


def test_false_rejections_stay_within_the_risk():
    """Over many draws of labels whose good documents exceed cutoffs at known
    rates, the chosen cutoffs break the risk in less than ``delta`` of them."""
    from riskloom.llm.rules import Rule, certified
    rules = (Rule("one", "a", "b", (.5, .4, .3, .2)), Rule("two", "a", "b", (.9, .8)))
    rates = ((.001, .005, .02, .2), (.01, .03))
    g, broken, runs, chosen = np.random.default_rng(1), 0, 400, 0
    for _ in range(runs):
        rows = []
        for s, n in (("x", 3000), ("y", 900)):
            row = {"stratum": s, "n": n}
            for i, rs in enumerate(rates):
                u = g.random(n)
                row |= {f"r{i}_{j}": int((u < p).sum()) for j, p in enumerate(rs)}
            rows.append(row)
        cuts = certified(rows, 2, alpha=.04, delta=.1, rules=rules)
        true = [rates[i][rules[i].cutoffs.index(c)] for v in cuts.values()
                for i, c in enumerate(v) if c is not None]
        chosen += len(true)
        broken += any(p > .02 for p in true)
    assert broken <= runs * .1 and chosen > runs


def test_rules_of_nothing(spark):
    from riskloom.llm.rules import judged
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert judged(df, lab)[0].count() == 0
    one = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert judged(one, lab)[0].first()["rejected_by"] == []


def test_many_strata_take_the_joined_path(spark, monkeypatch):
    from riskloom.llm import rules
    r = random.Random(2)
    docs = [(i, text_of(r, i % 7 == 0), "en") for i in range(1500)] + [(5000, text_of(r, True), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(1500)], "doc_id long, quality int")
    want = sorted((x["doc_id"], x["rejected_by"]) for x in rules.judged(df, lab, alpha=.1)[0].collect())
    monkeypatch.setattr(rules, "BROADCAST_STRATA", 0)
    got = sorted((x["doc_id"], x["rejected_by"]) for x in rules.judged(df, lab, alpha=.1)[0].collect())
    assert got == want and any(h for _, h in got) and got[-1][1] == []


# --------------------------------------------- open families of the Jaccard join

@pytest.mark.parametrize("cell,num,den", [(1024, 9, 10), (4, 9, 10), (5, 4, 5)])
def test_open_families_are_decided_in_cells(spark, monkeypatch, cell, num, den):
    """Copies of one text with changes around the threshold: every family is
    large, cells are cut into slices, and the components are brute force's."""
    from riskloom.llm import jaccard
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "SMALL_FAMILY", 2)
    met = []
    whole = jaccard.cross_links

    def counted(*a, **k):
        out = whole(*a, **k)
        met.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "cross_links", counted)
    r, rows = random.Random(num), []
    for t in range(2):
        base = [f"t{t}w{i}" for i in range(90)]
        forks = []
        for f in range(4):  # far from each other, with copies of their own
            fork = list(base)
            for at in r.sample(range(90), 5):
                fork[at] = f"f{f}x{at}"
            forks.append(fork)
        for i in range(45):
            text = list(r.choice(forks))
            for at in r.sample(range(90), r.choice([0, 1, 1, 2, 3])):
                text[at] = f"y{r.randrange(6)}"
            rows.append((1000 * t + i, " ".join(text)))
    sets = {i: {tuple(x.split()[k:k + 3]) for k in range(88)} for i, x in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in sets:
        for b in sets:
            both = len(sets[a] | sets[b])
            if a < b and den * len(sets[a] & sets[b]) >= num * both:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.components_of_similar(df, num=num, den=den, shingle=3)
    assert {x["id"]: x["component_id"] for x in got.collect()} == {i: root(i) for i in sets}
    if num == 9:
        assert met and met[0] > 0


def test_likely_rows_keep_every_wanted_one(spark, monkeypatch):
    from riskloom.llm import jaccard
    rows = spark.range(4000).select((F.col("id") * 7919).alias("key"), F.lit("t").alias("text"))
    wanted = rows.where("key % 37 = 0").select("key")
    want = {r["key"] for r in wanted.collect()}
    for size in (1 << 26, 1 << 16, 1 << 8):
        monkeypatch.setattr(jaccard, "MAP_BITS", size)
        got = jaccard.likely(rows, "key", wanted)
        assert got.columns == rows.columns
        keys = {r["key"] for r in got.collect()}
        assert want <= keys and (size < 1 << 20 or keys == want)
        assert jaccard.likely(rows, "key", wanted.limit(0)).count() == 0


# ------------------------------------------------------------------------ top-k

def test_an_invalid_row_does_not_silence_its_query(spark):
    from riskloom.llm.topk import top_k
    rows = [(50, [None, 1.0]), (50, [1.0, 0.5]), (50, [float("nan"), 0.0]), (1, [1.0, 1.0]),
            (2, [0.5, 0.0]), (100, [-math.inf, 1.0]), (150, None)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = [tuple(r) for r in top_k(df).orderBy("query_id", "rank").collect()]
        assert got == [(50, 1, 1, 256 * 256 + 128 * 256), (50, 2, 2, 128 * 256)]
