"""Exact top-k by inner product with pivot-table elimination.

Vectors are integers (``floor(scale * x)``).  Every row's distances to a table
of pivots are computed once per block; for a query q and a row x the largest
|d(q, p) - d(x, p)| over the pivots p is a lower bound of d(q, x), and
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 turns it into an upper bound of the
score.  Rows are evaluated in the order of that bound until it falls below the
k-th best score, so the answer is exact.

Queries go out in blocks of at most ``block`` vectors (the only thing that is
broadcast); each task keeps the k best of its rows for every query, and those
meet in one small shuffle by query.

Defined cases: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; only vectors of one length are compared;
a query's own id is never its answer; of rows that repeat a query's id the
least valid vector asks; every repeated candidate row counts; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import column


def integer_vectors(ids: pa.Array, vecs: pa.Array, scale: float):
    """{length: (ids, int64 matrix)} of the rows that take part."""
    vecs = vecs.cast(pa.list_(vecs.type.value_type))
    n = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy(zero_copy_only=False)
    ok = (n >= 0) & ~ids.is_null().to_numpy(zero_copy_only=False)
    out = {}
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for size in np.unique(n[ok]).tolist():
        at = np.flatnonzero(ok & (n == size))
        flat = vecs.take(pa.array(at)).flatten()
        gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), size)
        x = np.floor(flat.cast(pa.float64()).fill_null(0).to_numpy(
            zero_copy_only=False).reshape(len(at), size) * scale)
        good = ~gaps.any(axis=1) & np.isfinite(x).all(axis=1)
        if good.any():
            out[size] = (ids[at[good]], x[good].astype(np.int64))
    return out


class Queries:
    """One block of queries of one length, with their pivot distances."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, pivots: np.ndarray):
        self.ids, self.vecs, self.pivots = ids, vecs, pivots
        self.norm = (vecs.astype(np.float64) ** 2).sum(axis=1)
        self.far = distances(vecs, pivots)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, p = x.astype(np.float64), pivots.astype(np.float64)
    d2 = (a ** 2).sum(axis=1)[:, None] + (p ** 2).sum(axis=1) - 2 * a @ p.T
    return np.sqrt(np.maximum(d2, 0))


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots, each the vector farthest from those before it."""
    if not len(x):
        return x
    pick = [int(np.argmax((x.astype(np.float64) ** 2).sum(axis=1)))]
    near = distances(x, x[pick])[:, 0]
    while len(pick) < min(n, len(x)) and near.max() > 0:
        pick.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[pick[-1:]])[:, 0])
    return x[pick]


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where they cannot round."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max()) * max(1, x.shape[1]) < 2 ** 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def best_rows(queries: Queries, ids, x, k: int, best: dict):
    """Update ``best`` {query: sorted [(-score, id)]} with a block of rows."""
    norm, far = (x.astype(np.float64) ** 2).sum(axis=1), distances(x, queries.pivots)
    for i, qid in enumerate(queries.ids.tolist()):
        gap = np.abs(far - queries.far[i]).max(axis=1) if far.shape[1] else np.zeros(len(x))
        bound = (queries.norm[i] + norm - gap ** 2) / 2
        bound += 1 + 1e-9 * (queries.norm[i] + norm)  # more than the doubles can be off
        order = np.argsort(-bound)
        top, done, step = best.get(qid, []), 0, 4 * k
        while done < len(order) and (len(top) < k or bound[order[done]] >= -top[-1][0]):
            at = order[done:done + step]
            at = at[ids[at] != qid]
            s = _scores(x[at], queries.vecs[i])
            if len(top) == k:
                keep = s >= -top[-1][0]
                at, s = at[keep], s[keep]
            top = sorted([*top, *zip((-s).tolist(), ids[at].tolist())])[:k]
            done, step = done + step, 4 * step
        best[qid] = top


def _search(sent, k: int, scale: float):
    def run(batches):
        blocks, best = sent.value, {}
        for batch in batches:
            for size, (ids, x) in integer_vectors(column(batch, 0), column(batch, 1),
                                                  scale).items():
                if size in blocks:
                    best_rows(blocks[size], ids, x, k, best)
        rows = [(q, i, -s) for q, top in best.items() for s, i in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                             ["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = 5, every: int = 50, scale: float = 256.0, block: int = 2048,
          n_pivots: int = 32, pivot_sample: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of every query, a
    query being each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))
    # an invalid vector must not stand for the valid ones of its id
    valid = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x) < F.lit(float("inf"))))
    asked = rows.where((F.col("i") % every == 0) & F.col("v").isNotNull() & valid) \
        .groupBy("i").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-asked.count() // block))
    sample = rows.where("i is not null and v is not null").orderBy(
        F.xxhash64("i"), "i").limit(pivot_sample).toArrow()  # pivots only: any choice is exact
    pool = integer_vectors(*(sample[c].combine_chunks() for c in ("i", "v")), scale)
    pivots = {n: spread_out(x, n_pivots) for n, (_, x) in pool.items()}
    found = None
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == b).toArrow()
        vecs = integer_vectors(*(part[c].combine_chunks() for c in ("i", "v")), scale)
        sent = spark.sparkContext.broadcast(
            {n: Queries(i, x, pivots.get(n, x[:1])) for n, (i, x) in vecs.items()})
        got = rows.mapInArrow(_search(sent, k, scale), "query_id long, vec_id long, score long")
        found = got if found is None else found.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
