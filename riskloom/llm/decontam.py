"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a
shorter item is one window).  A window is the set of its word shingles; the
shingles are ordered by how rare they are in the whole corpus, and since a
window must be contained whole, its one rarest shingle is a necessary prefix.
A document joins on prefix shingles only; the place of the shingle gives the
one alignment possible (positional bound), which must fit into the document
(length bound), and the words of the item-sized window are then compared one
by one.

The join key side is the benchmark: it is read in blocks of at most
``block_words`` words, each block an index of bounded size that is broadcast,
and every document row passes all blocks within one stage, so the texts are
never shuffled.

Defined cases: a null or empty text has no words; a null or empty item has no
windows; repeated rows give a result each; items that share an id count once;
items without an id count as one item more, a null at the end of the list of
items; input columns other than the id and the text are dropped unless named in
``carry``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import column, fresh_name, slices
from .tokens import ALNUM, Members, row_of, split_words, window_hashes, word_hashes

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))
RESULT = T.StructType([T.StructField("n_words", T.LongType()),
                       T.StructField("spans", SPAN),
                       T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW = pa.struct([("n_words", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ("items", pa.list_(pa.string()))])


@dataclass
class Windows:
    """The distinct windows of one length within a block of the benchmark."""

    length: int
    shingle: int
    words: np.ndarray       # (n, length) word hashes
    item: np.ndarray        # item index of each (window, item) pair, by window
    item_at: np.ndarray     # offsets into ``item``

    def shingles(self) -> np.ndarray:
        n = self.length - self.shingle + 1
        flat = window_hashes(self.words.reshape(-1), self.shingle)
        at = np.arange(len(self.words))[:, None] * self.length + np.arange(n)
        return flat[at]


def item_windows(ids: list[str | None], texts: list[str | None], window: int, shingle: int):
    """The windows of a block of items, grouped by length."""
    words, offsets = split_words(pa.array(texts, pa.string()), ALNUM)
    h, n = word_hashes(words), np.diff(offsets)
    out = []
    for length in sorted(set(np.minimum(n, window).tolist()) - {0}):
        mine = np.flatnonzero(np.minimum(n, window) == length)
        starts = np.concatenate([np.arange(offsets[i], offsets[i + 1] - length + 1) for i in mine])
        item = np.repeat(mine, n[mine] - length + 1)
        seqs, inverse = np.unique(h[starts[:, None] + np.arange(length)], axis=0,
                                  return_inverse=True)
        pairs = np.unique(np.stack([inverse.reshape(-1), item], axis=1), axis=0)
        out.append(Windows(length, min(shingle, length), seqs, pairs[:, 1],
                           np.searchsorted(pairs[:, 0], np.arange(len(seqs) + 1))))
    return out


def _in_order(items) -> list:
    """Item ids sorted, null last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


class Index:
    """Prefix index of one block: for each window its rarest shingle, where in
    the window it stands, and the window's words."""

    def __init__(self, ids: list[str | None], groups: list[Windows], counts: dict[int, dict[int, int]]):
        self.ids, self.parts = ids, []
        for g in groups:
            sh = g.shingles()
            seen = counts.get(g.shingle, {})
            rare = np.array([[seen.get(int(x), 0) for x in row] for row in sh])
            place = rare.argmin(axis=1)
            live = np.flatnonzero(rare.min(axis=1) > 0)  # a shingle the corpus lacks: no match
            key = sh[np.arange(len(sh)), place]
            order = live[np.argsort(key[live], kind="stable")]
            if len(order):
                members = Members(key[order])
                first = np.searchsorted(key[order], members.values)
                self.parts.append((g, members, np.append(first, len(order)), order, place))

    def matches(self, h: np.ndarray, offsets: np.ndarray, rows: np.ndarray):
        """(start, length, window group, window) of all occurrences."""
        for g, members, first, order, place in self.parts:
            at, j = members.find(window_hashes(h, g.shingle))
            reps = first[j + 1] - first[j]
            n = int(reps.sum())
            if not n:
                continue
            k = np.repeat(first[j], reps) + np.arange(n) - np.repeat(np.cumsum(reps) - reps, reps)
            win, start = order[k], np.repeat(at, reps) - place[order[k]]
            fits = (start >= 0) & (start + g.length <= len(h))
            win, start = win[fits], start[fits]
            inside = rows[start] == rows[start + g.length - 1]
            win, start = win[inside], start[inside]
            for lo in range(0, len(start), 200_000):
                w, s = win[lo:lo + 200_000], start[lo:lo + 200_000]
                same = (h[s[:, None] + np.arange(g.length)] == g.words[w]).all(axis=1)
                yield s[same], g, w[same]


def _hits(index: Index, h, offsets, rows):
    """Per document with a match: sorted disjoint (start, end) ranges of hit
    words, counted from the document's first word, and the item ids."""
    delta, found = np.zeros(len(h) + 1, dtype=np.int32), {}
    for start, g, win in index.matches(h, offsets, rows):
        np.add.at(delta, start, 1)
        np.add.at(delta, start + g.length, -1)
        for d, w in zip(rows[start].tolist(), win.tolist()):
            found.setdefault(d, set()).update(
                g.item[g.item_at[w]:g.item_at[w + 1]].tolist())
    out = {}
    if found:
        hit = np.cumsum(delta[:-1]) > 0
        for d, items in found.items():
            x = np.diff(np.concatenate([[0], hit[offsets[d]:offsets[d + 1]], [0]]).astype(np.int8))
            out[d] = (list(zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist())),
                      _in_order({index.ids[i] for i in items}))
    return out


def _merge(a, b):
    """Union of two results of one document (from two blocks)."""
    spans = []
    for s, e in sorted(a[0] + b[0]):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return spans, _in_order(set(a[1]) | set(b[1]))


def _mark(index_of, text: int, first: bool):
    """Arrow kernel of one block: fills (first block) or widens the last
    column, the result struct."""
    def run(batches):
        index = index_of.value
        for batch in batches:
            for part in slices(batch, text):
                words, offsets = split_words(column(part, text), ALNUM)
                h, rows = word_hashes(words), row_of(offsets)
                hits = _hits(index, h, offsets, rows)
                n = np.diff(offsets).tolist()
                if first:
                    res = [{"n_words": n[i], "spans": [], "items": []} for i in range(len(n))]
                else:
                    res = column(part, part.num_columns - 1).to_pylist()
                for d, (spans, items) in hits.items():
                    old = ([(x["start"], x["end"]) for x in res[d]["spans"]], res[d]["items"])
                    spans, items = _merge(old, (spans, items))
                    res[d] = {"n_words": n[d], "items": items,
                              "spans": [{"start": s, "end": e} for s, e in spans]}
                keep = part.columns if first else part.columns[:-1]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(res, _ARROW)], [str(i) for i in range(len(keep) + 1)])
    return run


def _count(shingles_of):
    """Arrow kernel: how often each item shingle stands in the texts."""
    def run(batches):
        wanted = {s: Members(v) for s, v in shingles_of.value.items()}
        got = {s: np.zeros(len(m.values), dtype=np.int64) for s, m in wanted.items()}
        for batch in batches:
            for part in slices(batch, 0):
                words, offsets = split_words(column(part, 0), ALNUM)
                h, rows = word_hashes(words), row_of(offsets)
                for s, m in wanted.items():
                    at, j = m.find(window_hashes(h, s))
                    j = j[rows[at] == rows[at + s - 1]]
                    got[s] += np.bincount(j, minlength=len(m.values))
        for s, m in wanted.items():
            some = np.flatnonzero(got[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), s, dtype=np.int32)),
                 pa.array(m.values[some].view(np.int64)), pa.array(got[s][some])],
                ["s", "shingle", "n"])
    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """Items in blocks of about ``block_words`` words: the driver only ever
    holds one block.  An item longer than that is a block of its own."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"),
                             F.col(text_col).alias("t")).where("t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // (4 * block_words)))
    for b in range(n):
        got = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        if got or b == 0:
            yield [r["i"] for r in got], [r["t"] for r in got]


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", carry: tuple[str, ...] = (), window: int = 10,
                  shingle: int = 3, block_words: int = 1_000_000):
    """(documents with a result struct, the struct's column name).

    The result holds ``n_words``, the disjoint ``spans`` of words inside
    occurrences of item windows, and the ``items`` whose windows occur.  Rows
    keep ``id_col``, ``text_col`` and ``carry``.  The corpus is read twice:
    once for the shingle counts, once for the join."""
    spark = docs.sparkSession
    keep = list(dict.fromkeys([id_col, text_col, *carry]))
    name = fresh_name(keep, "contamination")
    base = docs.select(*keep)
    text = keep.index(text_col)
    out, first = base, True
    for ids, texts in benchmark_blocks(benchmark, item_col, item_text_col, block_words):
        groups = item_windows(ids, texts, window, shingle)
        wanted = {}
        for g in groups:
            wanted.setdefault(g.shingle, []).append(g.shingles().reshape(-1))
        counts = {}
        if wanted:
            sent = spark.sparkContext.broadcast(
                {s: np.unique(np.concatenate(v)) for s, v in wanted.items()})
            rows = (docs.select(text_col).mapInArrow(_count(sent), "s int, shingle long, n long")
                    .groupBy("s", "shingle").agg(F.sum("n").alias("n")).collect())
            for r in rows:  # at most the block's own shingles
                counts.setdefault(r["s"], {})[r["shingle"] % (1 << 64)] = r["n"]
        index = spark.sparkContext.broadcast(Index(ids, groups, counts))
        schema = T.StructType([*base.schema.fields, T.StructField(name, RESULT)])
        out = out.mapInArrow(_mark(index, text, first), schema)
        first = False
    return out, name


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of an item window, with their
    columns as they were."""
    cols = docs.columns
    marked, name = contamination(docs, benchmark, carry=tuple(cols), **options)
    return marked.where(F.size(f"{name}.spans") == 0).select(*cols)
