"""Centroid clustering (Lloyd rounds over integer vectors) with a LAESA table.

The distances of every vector to a few fixed pivots are computed once and
stored beside the vector.  In each round the centroids' distances to the same
pivots are computed (a few numbers), and the largest |d(x, p) - d(c, p)| over
the pivots p bounds d(x, c) from below for every vector x and centroid c.  A
vector's centroids are tried in the order of that bound until the bound
exceeds the best distance so far; only those tried cost an exact integer
distance, so the assignment is that of a full comparison, ties included.

A round is one scan of the stored table: each task adds up its vectors per
centroid, at most ``k`` rows a task are shuffled, and ``k`` rows of exact sums
reach the driver.  Nothing grows with the number of vectors but the scan; a
hot vector costs its own row only.

Defined cases: vectors that are null, are not of ``dims`` components, hold
null or non-finite components or one beyond 2^27 after scaling (a squared
distance would not fit a long) take no part; repeated ids are vectors of their
own, ties of the seeding hash go to the lesser vector; rows without an id are
clustered, but seed only after all others; with fewer vectors than ``k`` there
are as many centroids as vectors; no vector, no row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import column, staged

#: largest magnitude of a component that takes part
LARGEST = 1 << 27
_ROWS = 8192


@dataclass
class Clusters:
    """``rows`` (id, cluster, distance), the final ``centroids`` (one integer
    row per cluster number) and ``tried``, the exact distances each round took."""
    rows: DataFrame
    centroids: np.ndarray
    tried: list[int]


def integer_rows(vecs: pa.Array, dims: int, scale: float):
    """(positions of the vectors that take part, their integer matrix)."""
    vecs = vecs.cast(pa.list_(vecs.type.value_type))
    n = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(n == dims)
    flat = vecs.take(pa.array(at)).flatten()
    gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), dims)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(flat.cast(pa.float64()).fill_null(0).to_numpy(
            zero_copy_only=False).reshape(len(at), dims) * scale)
        good = ~gaps.any(axis=1) & np.isfinite(x).all(axis=1) & (np.abs(x) <= LARGEST).all(axis=1)
    return at[good], x[good].astype(np.int64)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances as doubles, each from an exact integer square."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        gap = x - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(np.float64))
    return out


def far_apart(pool: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``pool``, each the one farthest from those before it."""
    picked = [0]
    near = pivot_distances(pool, pool[:1])[:, 0]
    while len(picked) < min(n, len(pool)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, pivot_distances(pool, pool[picked[-1:]])[:, 0])
    return pool[picked]


def nearest(x: np.ndarray, far: np.ndarray, centroids: np.ndarray, cfar: np.ndarray):
    """(cluster, squared distance, exact distances taken) of every row."""
    low = np.zeros((len(x), len(centroids)))
    for p in range(far.shape[1]):
        np.maximum(low, np.abs(far[:, p, None] - cfar[None, :, p]), out=low)
    order = np.argsort(low, axis=1, kind="stable")
    best = np.full(len(x), np.iinfo(np.int64).max)
    who = np.full(len(x), len(centroids))
    left, tried = np.arange(len(x)), 0
    for j in range(len(centroids)):
        c = order[left, j]
        # the bound may be off by the rounding of two square roots
        open_ = low[left, c] <= np.sqrt(best[left].astype(np.float64)) * (1 + 1e-9) + 1e-6
        left, c = left[open_], c[open_]
        if not len(left):
            break
        gap = x[left] - centroids[c]
        d = np.einsum("ij,ij->i", gap, gap)
        tried += len(left)
        less = (d < best[left]) | ((d == best[left]) & (c < who[left]))
        best[left[less]], who[left[less]] = d[less], c[less]
    return who, best, tried


def _stored(dims: int, scale: float, pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            at, x = integer_rows(column(batch, 1), dims, scale)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [column(batch, 0).take(pa.array(at)),
                     pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.int32()), dims)
                     .cast(pa.list_(pa.int32())),
                     pa.FixedSizeListArray.from_arrays(
                         pa.array(pivot_distances(x, pivots).ravel()), len(pivots))
                     .cast(pa.list_(pa.float64()))], ["id", "v", "far"])
    return run


def _blocks(batches, dims: int, n_pivots: int):
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            part = batch.slice(i, _ROWS)
            yield (part, _matrix(column(part, 1), dims).astype(np.int64),
                   _matrix(column(part, 2), n_pivots))


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """Per task: vectors, component sums and exact distances of every cluster."""
    cfar = pivot_distances(centroids, pivots)

    def run(batches):
        k, dims = centroids.shape
        n, sums, cost = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for _, x, far in _blocks(batches, dims, len(pivots)):
            who, _, tried = nearest(x, far, centroids, cfar)
            cost += tried
            n += np.bincount(who, minlength=k)
            for c in np.unique(who):
                sums[c] += x[who == c].sum(axis=0)
        for c in np.flatnonzero(n).tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([int(n[c])]), pa.array([cost]),
                 pa.array([sums[c].tolist()], pa.list_(pa.int64()))],
                ["cluster", "n", "tried", "sums"])
            cost = 0
    return run


def _assigned(centroids: np.ndarray, pivots: np.ndarray):
    cfar = pivot_distances(centroids, pivots)

    def run(batches):
        for part, x, far in _blocks(batches, centroids.shape[1], len(pivots)):
            who, d, _ = nearest(x, far, centroids, cfar)
            yield pa.RecordBatch.from_arrays(
                [column(part, 0), pa.array(who, pa.int32()), pa.array(d, pa.int64())],
                ["id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding",
            dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: float = 256.0,
            n_pivots: int = 16, pivot_pool: int = 512) -> Clusters:
    """``rounds`` Lloyd rounds from the ``k`` vectors whose ids hash least, then
    one more assignment.  Pivots come from the ``pivot_pool`` first vectors of
    that order: which ones is a matter of speed only."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    whole = rows.mapInArrow(_stored(dims, scale, np.zeros((1, dims), np.int64)),
                            "id long, v array<int>, far array<double>")
    first = whole.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
                                     .cast("binary"), 256).alias("h")) \
        .orderBy(F.col("h").asc_nulls_last(), "v").limit(max(k, pivot_pool)).select("v").toArrow()
    pool = np.array(first["v"].to_pylist(), dtype=np.int64).reshape(-1, dims)
    if not len(pool):
        return Clusters(spark.createDataFrame([], "id long, cluster int, distance long"),
                        pool, [])
    centroids, pivots, tried = pool[:k].copy(), far_apart(pool, n_pivots), []
    table = staged(rows.mapInArrow(_stored(dims, scale, pivots),
                                   "id long, v array<int>, far array<double>"), "laesa")
    for _ in range(rounds):
        found = (table.mapInArrow(_sums(centroids, pivots),
                                  "cluster int, n long, tried long, sums array<long>")
                 .groupBy("cluster").agg(
                     F.sum("n").alias("n"), F.sum("tried").alias("tried"),
                     F.array(*[F.sum(F.col("sums")[i].cast("decimal(20,0)"))
                               for i in range(dims)]).alias("sums")).collect())  # k rows
        for r in found:
            centroids[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
        tried.append(sum(r["tried"] for r in found))
    out = staged(table.mapInArrow(_assigned(centroids, pivots),
                                  "id long, cluster int, distance long"), "clusters")
    return Clusters(out, centroids, tried)


def with_inertia(c: Clusters) -> DataFrame:
    """The rows with the distance summed over their cluster and over all, and
    the hash of their centroid: a join with at most ``k`` rows."""
    spark = c.rows.sparkSession
    per = {r["cluster"]: int(r["s"]) for r in c.rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
             for v in c.centroids.tolist()]
    total = sum(per.values())
    facts = spark.createDataFrame(
        [(i, s, total, names[i]) for i, s in sorted(per.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return c.rows.join(F.broadcast(facts), "cluster")
