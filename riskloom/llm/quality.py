"""Byte-level convolutional quality classifier in numpy.

A text is its UTF-8 bytes.  Each byte has a learned embedding; learned filters
slide over the embedded bytes; their responses are max-pooled over chunks of
256 bytes that overlap by half and cover the whole document; a small dense
layer turns each chunk's pooled responses into evidence units, which are
max-pooled over all chunks and combined into one probability.

Training (driver, plain gradients with Adam) uses a bounded sample of labelled
rows, ``max_rows`` rows in hash order of their id with at most ``max_chars``
characters each; scoring takes every byte of every text, in blocks of bounded
memory.  Inputs of a score are the text's bytes only.

Defined cases: null and empty texts are scored as zero bytes of content;
repeated rows score alike; label rows that contradict each other are left out;
without a usable label the score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import byte_offsets, column, fresh_name, slices

HALF = 128       # bytes; a chunk is two halves, neighbours share one
WIDTH = 8        # bytes under a filter
STEP = 2         # bytes between filter places
EMBED = 4
FILTERS = 32
UNITS = 16
BLOCK = 2048     # halves convolved at once


def init_weights(seed: int = 7) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    f = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
    return {"emb": f(256, EMBED, scale=0.5), "w": f(WIDTH * EMBED, FILTERS, scale=0.25),
            "b": np.zeros(FILTERS, np.float32), "w1": f(FILTERS, UNITS, scale=0.25),
            "b1": np.full(UNITS, 0.1, np.float32), "w2": f(UNITS, scale=0.3),
            "b2": np.zeros(1, np.float32)}


def laid_out(texts: pa.Array):
    """(bytes of all texts, each with zeros before and after to whole halves,
    at least two, so that no filter sees two texts; first half of every text)."""
    offs = byte_offsets(texts)
    size = np.diff(offs)
    halves = np.maximum(2, -(-(size + 2 * WIDTH) // HALF))
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(first[-1]) * HALF + WIDTH, dtype=np.uint8)
    data = texts.buffers()[2]
    if data is not None and len(texts):
        raw = np.frombuffer(data, np.uint8)
        for a, b, h in zip(offs[:-1].tolist(), offs[1:].tolist(), first.tolist()):
            out[h * HALF + WIDTH:h * HALF + WIDTH + b - a] = raw[a:b]
    return out, first


def _windows(p, data: np.ndarray) -> np.ndarray:
    """The embedded bytes under every filter place of ``data`` (whole halves
    and WIDTH more bytes)."""
    x = p["emb"][data]
    n = (len(data) - WIDTH) // STEP
    return np.lib.stride_tricks.as_strided(
        x, (n, WIDTH * EMBED), (STEP * EMBED * 4, 4)) if n else np.zeros((0, WIDTH * EMBED))


def pooled_halves(p, data: np.ndarray, n: int, places: bool = False):
    """Max response of every filter in each of ``n`` halves (and its place)."""
    out = np.empty((n, FILTERS), np.float32)
    at = np.empty((n, FILTERS), np.int64) if places else None
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        r = (_windows(p, data[lo * HALF:hi * HALF + WIDTH]) @ p["w"]).reshape(
            hi - lo, HALF // STEP, FILTERS)
        r.max(axis=1, out=out[lo:hi])
        if places:
            at[lo:hi] = r.argmax(axis=1) + (np.arange(lo, hi) * (HALF // STEP))[:, None]
    return out + p["b"], at


def _chunks(first: np.ndarray):
    """(left half of every chunk, first chunk of every text)."""
    n = np.diff(first) - 1
    at = np.concatenate([[0], np.cumsum(n)])
    return np.arange(int(at[-1])) + np.repeat(np.arange(len(n)), n), at


def forward(p, data, first, places: bool = False):
    half, at = pooled_halves(p, data, int(first[-1]), places)
    left, chunk_at = _chunks(first)
    pool = np.maximum(half[left], half[left + 1])
    h = np.maximum(pool, 0)
    u = np.maximum(h @ p["w1"] + p["b1"], 0)
    z = np.maximum.reduceat(u, chunk_at[:-1], axis=0)
    s = 1 / (1 + np.exp(-(z @ p["w2"] + p["b2"][0]).astype(np.float64)))
    return s, (half, at, left, chunk_at, pool, h, u, z)


def gradients(p, data, first, y, weight):
    s, (half, at, left, chunk_at, pool, h, u, z) = forward(p, data, first, True)
    d = ((s - y) * weight / len(y)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["w2"], g["b2"] = z.T @ d, np.array([d.sum()], np.float32)
    dz = d[:, None] * p["w2"] * (z > 0)
    # the chunk each unit's maximum came from
    best = np.stack([u[a:b].argmax(axis=0) + a for a, b in zip(chunk_at[:-1], chunk_at[1:])])
    du = np.zeros_like(u)
    np.add.at(du, (best, np.arange(UNITS)), dz)
    some = np.unique(best)
    du, hs = du[some], h[some]
    g["w1"], g["b1"] = hs.T @ du, du.sum(axis=0)
    dh = (du @ p["w1"].T) * (pool[some] > 0)
    c, f = np.nonzero(dh)
    l = left[some][c]
    side = l + (half[l + 1, f] > half[l, f])
    place, dv = at[side, f] * STEP, dh[c, f]
    g["b"] = np.bincount(f, weights=dv, minlength=FILTERS).astype(np.float32)
    under = data[place[:, None] + np.arange(WIDTH)]
    x = p["emb"][under].reshape(len(place), -1)
    gw = np.zeros_like(g["w"].T)
    np.add.at(gw, f, x * dv[:, None])
    g["w"] = gw.T
    np.add.at(g["emb"], under.reshape(-1),
              (p["w"].T[f] * dv[:, None]).reshape(-1, EMBED))
    return s, g


def fit(texts: list[str], labels: list[int], *, steps: int = 1800, batch: int = 24,
        rate: float = 4e-3, seed: int = 7) -> dict[str, np.ndarray] | None:
    """Weights fitted to the labelled texts in about ``steps`` batches; None
    without both classes."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    p = init_weights(seed)
    p["b2"][0] = np.log(y.mean() / (1 - y.mean()))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    rng, step = np.random.default_rng(seed), 0
    arr = pa.array(texts, pa.string())
    epochs = -(-steps // -(-len(y) // batch))
    total = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            data, first = laid_out(arr.take(pa.array(pick)))
            _, g = gradients(p, data, first, y[pick], np.ones(len(pick)))
            step += 1
            lr = rate * min(1, step / 50) * (1 - step / (total + 1))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9 ** step))
                        / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


def score_texts(p, texts: pa.Array) -> np.ndarray:
    texts = texts.fill_null("") if texts.null_count else texts
    if p is None or not len(texts):
        return np.full(len(texts), 0.5)
    return forward(p, *laid_out(texts))[0]


def _score(sent, text: int):
    def run(batches):
        p = sent.value
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score_texts(p, column(part, text)))],
                    [str(i) for i in range(part.num_columns + 1)])
    return run


def held_out(id_col: str, folds: int = 5):
    """Is the id's text in the fold that training never sees?"""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0,
                      F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str,
                  label_col: str, max_rows: int, max_chars: int):
    """(texts, labels) of the bounded sample: at most ``max_rows`` labelled
    rows outside the held-out fold."""
    rows = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))
    one = (rows.where("i is not null and y in (0, 1)").where(~held_out("i"))
           .groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1")
           .orderBy(F.xxhash64("i"), "i").limit(max_rows).select("i", "y"))
    got = (docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
           .where(F.length("t") <= max_chars)
           .join(F.broadcast(one), F.col("d") == F.col("i"))  # at most max_rows ids
           .select("i", "t", "y").orderBy("i", "t").limit(max_rows).toPandas())
    return got["t"].tolist(), got["y"].tolist()


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality", max_rows: int = 4000,
                   max_chars: int = 20_000, carry: tuple[str, ...] = ()):
    """(documents with a score, the score column's name): rows keep
    ``id_col``, ``text_col`` and ``carry``."""
    texts, y = training_rows(docs, labels, id_col=id_col, text_col=text_col,
                             label_col=label_col, max_rows=max_rows, max_chars=max_chars)
    sent = docs.sparkSession.sparkContext.broadcast(fit(texts, y))
    keep = list(dict.fromkeys([id_col, text_col, *carry]))
    name = fresh_name(keep, "score")
    base = docs.select(*keep)
    schema = T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())])
    return base.mapInArrow(_score(sent, keep.index(text_col)), schema), name


def good_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3,
                   **options) -> DataFrame:
    """The documents that score ``threshold`` or more, columns as they were."""
    scored, name = quality_scores(docs, labels, carry=tuple(docs.columns), **options)
    return scored.where(F.col(name) >= threshold).select(*docs.columns)
