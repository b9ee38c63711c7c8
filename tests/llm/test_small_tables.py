"""Small tables of the Jaccard join do not take a task per shuffle partition."""

import random

import pytest

from riskloom.llm import components, frames, jaccard

WIDE = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def wide(spark):
    """A session with many partitions that Spark does not coalesce."""
    old = {k: spark.conf.get(k) for k in WIDE}
    for k, v in WIDE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _spied(monkeypatch, module, files):
    real = module.staged

    def staged(df, tag, codec=None):
        out = real(df, tag, codec)
        files.append((tag, len(out.inputFiles())))
        return out
    monkeypatch.setattr(module, "staged", staged)


def test_components_of_few_links_take_few_tasks(wide, monkeypatch):
    files, r = [], random.Random(3)
    _spied(monkeypatch, components, files)
    name = r.sample(range(1 << 60), 400)
    pairs = [(name[i], name[i + 1]) for i in range(150)]  # a chain
    pairs += [(name[200], name[i]) for i in range(201, 300)]  # a star
    pairs += [(name[310], name[310]), (name[320], name[321]), (name[321], name[320])]
    got = components.components(wide.createDataFrame(pairs, "u long, v long"), len(pairs)).collect()
    parts = {}
    for x in got:
        parts.setdefault(x["comp"], set()).add(x["node"])
    want = [set(name[:151]), set(name[200:300]), set(name[320:322])]
    assert len(got) == len({x["node"] for x in got})
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want))
    cores = wide.sparkContext.defaultParallelism
    assert len(files) > 4 and max(n for _, n in files) <= cores < 48


def test_join_of_few_texts_takes_few_tasks_and_no_empty_rounds(wide, monkeypatch):
    files, r = [], random.Random(4)
    for m in (components, jaccard):
        _spied(monkeypatch, m, files)
    rows = []
    for t in range(12):
        base = [f"t{t}w{i}" for i in range(60)]
        for c in range(4):
            text = list(base)
            for at in r.sample(range(60), c):
                text[at] = f"c{c}"
            rows.append((10 * t + c, " ".join(text)))
    got = jaccard.components_of_similar(wide.createDataFrame(rows, "doc_id long, text string"),
                                        num=4, den=5, shingle=3).collect()
    sets = {i: {tuple(x.split()[k:k + 3]) for k in range(58)} for i, x in rows}
    up = {i: i for i in sets}
    for _ in sets:  # the least id spreads over links
        for a in sets:
            for b in sets:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    up[a] = min(up[a], up[b])
    assert {x["id"]: x["component_id"] for x in got} == up
    cores = wide.sparkContext.defaultParallelism
    # candidates and sets come from as many buckets as there are partitions
    assert max(n for tag, n in files if tag not in ("candidates", "large")) <= cores < 48
    # the family's root and centre are one round of pairs
    assert [tag for tag, _ in files].count("linked") <= 2


def test_tasks_follow_the_bytes(wide):
    df = wide.range(0, 1000, 1, 40)
    assert frames.in_tasks(df, 0).rdd.getNumPartitions() == wide.sparkContext.defaultParallelism
    assert frames.in_tasks(df, 30 * frames.TASK_BYTES).rdd.getNumPartitions() == 30
    assert frames.in_tasks(df, 1 << 50).rdd.getNumPartitions() == 40
