"""What the Jaccard join ships for members of an open family."""

import random

import numpy as np
import pyarrow as pa

from riskloom.llm import jaccard
from riskloom.llm.packed import packed_rows


def _sets(rows):
    return {i: {tuple(w[k:k + 3]) for k in range(len(w) - 2)} for i, w in
            ((i, x.split()) for i, x in rows)}


def test_lists_of_changes_are_sent_once(spark, monkeypatch):
    """Long texts just too far apart, which sketches can't tell from links and
    which share many cells: a member's list goes on once, not once a cell."""
    r, base, rows = random.Random(8), [f"b{i}" for i in range(3000)], []
    for i in range(20):
        text = list(base)
        for at in r.sample(range(3000), 62):
            text[at] = f"c{i}x{at}"
        rows.append((i, " ".join(text)))
        if i % 6 == 0:
            for at in r.sample(range(3000), 20):
                text[at] = f"d{i}x{at}"
            rows.append((100 + i, " ".join(text)))
    sent, real = [], jaccard.staged

    def staged(df, tag, codec=None):
        out = real(df, tag, codec)
        if tag == "once":
            sent.append((out.count(), out.select("cid").distinct().count()))
        return out
    monkeypatch.setattr(jaccard, "staged", staged)
    got = jaccard.components_of_similar(spark.createDataFrame(rows, "doc_id long, text string"),
                                        num=4, den=5, shingle=3)
    sets = _sets(rows)
    least = {i: min(j for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
             for i in sets}
    assert {x["id"]: x["component_id"] for x in got.collect()} == least
    assert len(set(least.values())) == 20
    assert sent and sent[0][0] == sent[0][1] > 10


def test_shared_elements_and_their_members(monkeypatch):
    """Against a dict: every set of members that share an element, once, in
    rows of at most LIST members."""
    monkeypatch.setattr(jaccard, "LIST", 3)
    rng = np.random.default_rng(4)
    e, cid = rng.integers(0, 400, 1500).astype(np.uint64), rng.integers(-60, 60, 1500)
    for hot in (7, 21):  # two elements of the same members, one bucket
        keep = e != hot
        e = np.concatenate([e[keep], np.full(10, hot, np.uint64)])
        cid = np.concatenate([cid[keep], np.arange(10)])
    members = {}
    for x, c in zip(e.tolist(), cid.tolist()):
        members.setdefault(x, set()).add(c)
    n, got = 7, {}
    packed = packed_rows(e % np.uint64(n), {"e": (e // np.uint64(n)).astype(np.uint32), "cid": cid})
    for i in range(packed.num_rows):
        out = jaccard._shared(n)(pa.Table.from_batches([packed.slice(i, 1)]))
        seen = set()
        for x in out.to_pylist():
            assert len(x["cids"]) <= 3 and x["g"] == len(members[x["e"]])
            got.setdefault(x["e"], []).extend(x["cids"])
            seen.add((x["s1"], x["s2"], x["e"]))
        assert len({s[:2] for s in seen}) == len(seen)
    assert all(sorted(v) == sorted(members[x]) for x, v in got.items())
    want = {(x % n, frozenset(v)) for x, v in members.items() if len(v) > 1}
    assert {(x % n, frozenset(v)) for x, v in got.items()} == want and len(got) == len(want)
    assert (7 in got) + (21 in got) == 1
    one = packed_rows(np.zeros(2, np.uint64), {"e": np.array([1, 2], np.uint32), "cid": np.array([5, 5])})
    assert jaccard._shared(1)(pa.Table.from_batches([one])).num_rows == 0
