"""Machine-learning jobs on Spark ML.

Training, scoring and evaluation are Spark jobs: estimators from
``pyspark.ml``, metrics from :mod:`riskloom.operators.stats` (exact AUC / KS
through distributed running sums).  Only fitted parameters (scaler moments,
trees, metrics) reach the driver.  Randomness is hash-derived
(``xxhash64(id, seed)``), so splits do not depend on partitioning.
"""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import risk_band, to_score
from ..session import ensure_checkpoint_dir, scratch_path, scratch_table
from . import stats as st
from .boost import search_margins
from .ordered import exact_quantiles
from .trees import (Forest, TreeEnsemble, _from_nodes, attribute_batch,  # noqa: F401
                    ensemble_from, ensemble_from_rows, local_surrogates, margin_batch,
                    staged_margins)

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (hyper-parameters, gate).
# ---------------------------------------------------------------------------
CREDIT_GBT = dict(maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.9,
                  featureSubsetStrategy="0.8", minInstancesPerNode=3)
CREDIT_GBT_ALT = dict(maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.9,
                      featureSubsetStrategy="0.8", minInstancesPerNode=3, maxBins=64)
FRAUD_FOREST = dict(numTrees=100, maxDepth=10)
DEFAULT_GBT = dict(maxIter=100, maxDepth=5, stepSize=0.1)
LEGACY_FOREST = dict(numTrees=200, maxDepth=15)
SEGMENTS_K, SEGMENTS_RESTARTS = 4, 10
ISO_TREES, ISO_SAMPLE, ISO_CONTAMINATION = 100, 256, 0.1
GATE = {"auc_minimo": 0.8, "ks_minimo": 0.3, "n_amostras_minimo": 100}
TUNE_SPACE = {"maxIter": (100, 500), "maxDepth": (3, 10), "stepSize": (0.01, 0.2),
              "subsamplingRate": (0.6, 1.0), "featureSubsetStrategy": (0.5, 1.0),
              "minInstancesPerNode": (1, 10)}


# --- M1 -----------------------------------------------------------------------
def hash_uniform(key, seed: int, salt: str = "") -> Column:
    """Deterministic U[0,1) from (key, seed, salt), 53 bits."""
    h = F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed), F.lit(salt))
    return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)


def _share_by_label(df: DataFrame, u: str, label: str, share: float) -> Column:
    """Is the row within the lowest ``share`` of its class's hash values?  The
    cut per class is the exact quantile (distributed); classes are few."""
    cuts = exact_quantiles(df.select(label, u), u, [share], [label]).collect()
    out = F.lit(False)
    for r in cuts:
        out = F.when(F.col(label) == F.lit(r[label]), F.col(u) <= F.lit(r["quantile"])) \
            .otherwise(out)
    return out


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42,
                     test: float = 0.2, val: float | None = 0.15) -> DataFrame:
    """Adds ``split`` in {train, val, test}: of every class the share ``test``
    with the lowest hash, then the share ``val`` of what is left, exact to one
    row per class.  Rows without a label train."""
    base = df.withColumns({"_u": hash_uniform(key, seed, "split"),
                           "_v": hash_uniform(key, seed, "val")})
    base = base.withColumn("_test", _share_by_label(base, "_u", label, test))
    if val:
        is_val = _share_by_label(base.filter(~F.col("_test")), "_v", label, val)
    else:
        is_val = F.lit(False)
    return base.withColumn("split", F.when(F.col("_test"), "test").when(is_val, "val")
                           .otherwise("train")).drop("_u", "_v", "_test")


def split_shares(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(label, "split").agg(F.count(F.lit(1)).alias("n"))
    t = df.groupBy(label).agg(F.count(F.lit(1)).alias("tot"))
    return c.join(F.broadcast(t), label).withColumn("share", F.col("n") / F.col("tot"))


# --- M2 -----------------------------------------------------------------------
@dataclass
class Scaler:
    """Zero mean / unit population std (sklearn semantics; Spark's
    StandardScaler divides by the sample std)."""
    cols: list
    mean: list
    std: list

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        exprs = [((F.col(c) - m) / (s if s > 0 else 1.0)).alias(c)
                 for c, m, s in zip(self.cols, self.mean, self.std)]
        return df.select(*(keep or []), *exprs)


def fit_scaler(df: DataFrame, cols: list[str]) -> Scaler:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return Scaler(cols, [float(row[f"m{i}"] or 0.0) for i in range(len(cols))],
                  [float(row[f"s{i}"] or 0.0) for i in range(len(cols))])


# --- shared helpers -------------------------------------------------------------
def assemble(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def positive_prob(pred: DataFrame, col_name: str = "probability", out: str = "p") -> DataFrame:
    return pred.withColumn(out, vector_to_array(F.col(col_name))[1])


def evaluate(pred: DataFrame, y: str = "label", p: str = "p") -> dict:
    """AUC (exact), KS separation, precision/recall/F1/accuracy at 0.5, n.
    The scored pairs are kept while the three statistics read them."""
    pred = pred.select(F.col(y).alias("y"), F.col(p).alias("y_prob")).persist()
    m = st.binary_metrics(pred).first().asDict()
    auc = st.auc_exact(pred).first()["auc"]
    ks = st.ks_separation(pred).first()["ks"]
    pred.unpersist()
    return {"auc_roc": float(auc or 0.0), "ks_statistic": float(ks or 0.0),
            "precision": m["precision"], "recall": m["recall"], "f1": m["f1"],
            "accuracy": m["accuracy"], "n_amostras_teste": int(m["n"])}


# --- M3 / M4 / M8 ---------------------------------------------------------------
#: bytes of feature values that are worth a partition of a fit's rows, and the
#: most that one partition holds
FIT_PARTITION_BYTES, FIT_PARTITION_MOST = 4 << 20, 128 << 20


def fit_partitions(rows: int, n_features: int, cores: int) -> int:
    """Partitions of a fit's rows.  Every one costs each of the fit's many jobs
    a task, a result and (forests) the statistics of all open nodes in the
    shuffle: one per core, fewer for a small table, more only where one would
    hold more than ``FIT_PARTITION_MOST``."""
    size = rows * n_features * 8
    return max(1, min(-(-size // FIT_PARTITION_BYTES), cores), -(-size // FIT_PARTITION_MOST))


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


@contextmanager
def fit_rows(train: DataFrame, feature_cols: list[str], label: str):
    """The rows of a fit, kept for all its rounds, in partitions by their size:
    a round runs a handful of jobs, and a task that holds a few rows costs as
    much to start as one that holds many."""
    rows = train.select(label, *feature_cols).persist()
    try:
        yield rows.coalesce(fit_partitions(rows.count(), len(feature_cols), _cores(train)))
    finally:
        rows.unpersist()


def train_gbt(train: DataFrame, feature_cols: list[str], label: str = "label",
              params: dict | None = None, seed: int = 42) -> PipelineModel:
    """One boosted fit.  The training rows are kept for all rounds; lineage is
    cut every 10 rounds in the shared checkpoint folder."""
    params = dict(params or CREDIT_GBT)
    ensure_checkpoint_dir(train.sparkSession)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **params)
    with fit_rows(train, feature_cols, label) as rows:
        return Pipeline(stages=[assemble(feature_cols), gbt]).fit(rows)


def train_credit(train: DataFrame, feature_cols: list[str], label: str = "inadimplente",
                 params: dict | None = None, seed: int = 42) -> PipelineModel:
    """M3: boosted trees with the credit hyper-parameters."""
    return train_gbt(train, feature_cols, label, params or CREDIT_GBT, seed)


def train_credit_alt(train: DataFrame, feature_cols: list[str], label: str = "inadimplente",
                     params: dict | None = None, seed: int = 42) -> PipelineModel:
    """M4: the second booster (finer histogram binning).  It is always at
    hand here, so nothing falls back to M3: a failed fit is an error."""
    return train_gbt(train, feature_cols, label, params or CREDIT_GBT_ALT, seed)


def train_default(train: DataFrame, feature_cols: list[str], label: str = "inadimplente",
                  params: dict | None = None, seed: int = 42) -> PipelineModel:
    """M8: boosted trees 100 x depth 5, lr 0.1."""
    return train_gbt(train, feature_cols, label, params or DEFAULT_GBT, seed)


def forest_rows(df: DataFrame, n_features: int) -> DataFrame:
    """The rows of a forest's fit, stored: metadata, split points and the fit
    read them without building them again."""
    rows = scratch_table(df, "forest")
    return rows.coalesce(fit_partitions(rows.count(), n_features, _cores(df)))


# --- M5 -------------------------------------------------------------------------
def train_fraud(train: DataFrame, feature_cols: list[str], label: str = "is_fraud",
                params: dict | None = None, seed: int = 42) -> tuple[Scaler, PipelineModel]:
    """M5: population-std scaling then a 100-tree depth-10 forest."""
    scaler = fit_scaler(train, feature_cols)
    scaled = forest_rows(scaler.transform(train, keep=[label]), len(feature_cols))
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed,
                                **(params or FRAUD_FOREST))
    return scaler, Pipeline(stages=[assemble(feature_cols), rf]).fit(scaled)


# --- M10 ------------------------------------------------------------------------
#: nodes of a forest that the driver may hold, and of a part of a larger one
FOREST_NODES, FOREST_PART_NODES = 5_000_000, 600_000


class PartedForest:
    """A regression forest of more trees than the driver can hold at once: the
    parts lie in the shared folder and score one after the other."""

    def __init__(self, feature_cols: list[str], parts: list[tuple[str, int]]):
        self.cols, self.parts = list(feature_cols), parts

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the mean ``prediction`` of all trees, stored."""
        out = df.withColumn("prediction", F.lit(0.0))
        for path, trees in self.parts:
            part = RandomForestRegressionModel.load(path).setPredictionCol("_part")
            scored = part.transform(assemble(self.cols).transform(out))
            out = scratch_table(scored.select(*df.columns, (
                F.col("prediction") + F.col("_part") * trees).alias("prediction")), "scored")
        return out.withColumn("prediction", F.col("prediction") / sum(n for _, n in self.parts))


def forest_parts(trees: int, rows: int, depth: int) -> list[int]:
    """Trees of every part of a forest's fit: one part as long as its nodes, two
    a row and tree at most, are within what the driver may hold.  A part has at
    least two trees: a single one would not draw its features."""
    nodes = min(2 << depth, 2 * rows)
    if trees * nodes <= FOREST_NODES or trees < 4:
        return [trees]
    n = min(trees // 2, -(-trees * nodes // FOREST_PART_NODES))
    return [trees // n + (i < trees % n) for i in range(n)]


def train_legacy_score(train: DataFrame, feature_cols: list[str], label: str = "score_credito",
                       params: dict | None = None, seed: int = 42):
    """Scaled input, 200-tree depth-15 regression forest on the integer
    score (predictions rounded when scoring).  Returns the scaler and the model:
    a forest whose nodes would fill the driver is fitted, stored and scored in
    parts of a few trees, each with a seed of its own."""
    scaler = fit_scaler(train, feature_cols)
    scaled = forest_rows(scaler.transform(train, keep=[label]), len(feature_cols))
    params = dict(params or LEGACY_FOREST)
    sizes = forest_parts(params["numTrees"], scaled.count(), params["maxDepth"])
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, **params)
    if len(sizes) == 1:
        return scaler, Pipeline(stages=[assemble(feature_cols), rf]).fit(scaled)
    rows, parts = assemble(feature_cols).transform(scaled), []
    for i, n in enumerate(sizes):
        path = scratch_path(train.sparkSession, "forest-part")
        rf.copy({rf.numTrees: n, rf.seed: seed + i}).fit(rows).write().save(path)
        parts.append((path, n))
    return scaler, PartedForest(feature_cols, parts)


# --- M9 / A19 -------------------------------------------------------------------
def train_segments(df: DataFrame, feature_cols: list[str], k: int = SEGMENTS_K,
                   restarts: int = SEGMENTS_RESTARTS, seed: int = 42):
    """M9: k-means on population-scaled features, ``restarts`` seeds, the
    fit with the lowest training cost wins.  Returns (scaler, model,
    silhouette (squared Euclidean, Spark's definition))."""
    scaler = fit_scaler(df, feature_cols)
    # every restart's jobs send a result per partition to the driver
    kept = scaler.transform(df).persist()
    parts = max(2 * _cores(df), -(-kept.count() * len(feature_cols) * 8 // FIT_PARTITION_MOST))
    rows = kept.coalesce(parts) if kept.rdd.getNumPartitions() > parts else kept
    scaled = assemble(feature_cols).transform(rows).cache()
    scaled.count()
    kept.unpersist()
    best = None
    for r in range(restarts):
        m = KMeans(k=k, seed=seed + r, featuresCol="features").fit(scaled)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    pred = best.transform(scaled)
    sil = ClusteringEvaluator(featuresCol="features").evaluate(pred)
    scaled.unpersist()
    return scaler, best, float(sil)


# --- M6 isolation forest --------------------------------------------------------
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    idx = len(nodes)
    nodes.append([-1, 0.0, -1, -1, float(len(x))])  # feature, thr, left, right, size
    if depth >= limit or len(x) <= 1:
        return idx
    spans = x.max(axis=0) - x.min(axis=0)
    cand = np.flatnonzero(spans > 0)
    if cand.size == 0:
        return idx
    f = int(rng.choice(cand))
    thr = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[x[:, f] < thr]
    right = x[x[:, f] >= thr]
    nodes[idx][0], nodes[idx][1] = f, thr
    nodes[idx][2] = _grow(left, rng, depth + 1, limit, nodes)
    nodes[idx][3] = _grow(right, rng, depth + 1, limit, nodes)
    return idx


def _path_forest(trees: list) -> Forest:
    """The trees as one :class:`Forest` whose margin is the sum of the path
    lengths: a split sends what is below its threshold to the left, a leaf
    counts its depth and the mean path of the rows that it holds."""
    out = []
    for nodes in trees:
        depth = [0] * len(nodes)
        rows = []
        for i, (f, thr, left, right, size) in enumerate(nodes):  # a parent comes before its children
            leaf = f < 0
            if not leaf:
                depth[int(left)] = depth[int(right)] = depth[i] + 1
            rows.append([f, np.nextafter(thr, -np.inf), left, right,
                         depth[i] + _c(size) if leaf else 0.0, size, None])
        out.append(_from_nodes(rows, 1.0))
    return Forest(TreeEnsemble(out, 0))


@dataclass
class IsolationForestModel:
    cols: list
    trees: list            # list of node arrays (feature, thr, left, right, size)
    sample_size: int
    offset: float = -0.5   # decision threshold on score_samples

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """score_samples = -2^(-E[h(x)] / c(psi)) via an Arrow UDF over
        partitions; trees are a few KB, shipped in the closure, and a block of
        rows descends all of them at once."""
        forest, n_trees = _path_forest(self.trees), len(self.trees)
        cols, cn = list(self.cols), _c(self.sample_size)
        offset = self.offset

        def run(batches):
            for pdf in batches:
                x = pdf[cols].to_numpy(dtype=float)
                x = np.nan_to_num(x)
                h = forest.margins(x) / n_trees
                s = -np.power(2.0, -h / cn)
                out = pdf[keep].copy()
                out["iso_score"] = s
                out["iso_pred"] = np.where(s - offset < 0, -1, 1).astype("int32")
                yield out
        schema = ", ".join(f"{k} {t}" for k, t in df.select(*keep).dtypes)
        return df.mapInPandas(run, f"{schema}, iso_score double, iso_pred int")


def isolation_forest(df: DataFrame, cols: list[str], key: str, n_trees: int = ISO_TREES,
                     sample: int = ISO_SAMPLE, contamination: float = ISO_CONTAMINATION,
                     seed: int = 42) -> IsolationForestModel:
    """M6: each tree is grown on its own ``sample`` rows of the whole table:
    a row goes to the trees whose 64-bit hash of (key, tree) falls under the
    sampling share, and the lowest ``sample`` hashes of each tree grow it (a
    bounded group, built in ``applyInPandas``).  The threshold is the exact
    ``contamination`` quantile of the training scores."""
    picked = tree_samples(df, cols, key, n_trees, sample, seed)
    limit = int(math.ceil(math.log2(max(sample, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed + t)
        nodes: list = []
        x = pdf.sort_values("r")[cols].to_numpy(dtype=float)
        _grow(np.nan_to_num(x), rng, 0, limit, nodes)
        return pd.DataFrame({"tree": [t], "nodes": [json.dumps(nodes)], "n": [len(pdf)]})
    built = picked.groupBy("tree").applyInPandas(build, "tree int, nodes string, n long").collect()
    trees = [json.loads(r["nodes"]) for r in sorted(built, key=lambda r: r["tree"])]
    model = IsolationForestModel(cols, trees, max([r["n"] for r in built], default=1))
    scored = model.score(df.select(key, *cols), [key])
    q = exact_quantiles(scored, "iso_score", [contamination]).first()
    model.offset = float(q["quantile"])
    return model


def tree_samples(df: DataFrame, cols: list[str], key: str, n_trees: int, sample: int,
                 seed: int = 42) -> DataFrame:
    """(key, cols, tree, r): the rows each tree is grown on.  The share leaves
    ``sample`` rows per tree in all but hopeless draws (mean ``sample`` + 6
    standard deviations), whatever the size of the table."""
    n = df.count()
    share = min(1.0, (sample + 6 * math.sqrt(sample)) / max(n, 1))
    bound = min(int(share * float(1 << 64)) - (1 << 63), (1 << 63) - 1)
    # compiled code hashes and drops a (row, tree) pair before a row is made of it
    cand = (df.select(key, *cols, F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
            .withColumn("r", F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)))
            .filter(F.col("r") <= F.lit(bound)))
    w = Window.partitionBy("tree").orderBy("r", key)
    return cand.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= sample).drop("rk")


# --- M7 -------------------------------------------------------------------------
def fraud_combine(iso_score, iso_pred, rf_prob, rf_pred, normalised: bool = False):
    """score = (iso + rf) / 2 (iso negated when ``normalised``); flag =
    anomaly (-1) or supervised positive."""
    iso = -F.col(iso_score) if normalised else F.col(iso_score)
    return F.struct(((iso + F.col(rf_prob)) / 2).alias("combined_score"),
                    ((F.col(iso_pred) == -1) | (F.col(rf_pred) == 1)).cast("int")
                    .alias("combined_pred"))


# --- M11 ------------------------------------------------------------------------
def trial_params(n_trials: int, seed: int, per_fit: int = 7) -> list[dict]:
    """The seeded random draws over the six ranges: the number of rounds anew
    for every trial, the other five for every ``per_fit`` trials, so that those
    differ in rounds only and are read off one fit."""
    rnd = random.Random(seed)
    out: list = []
    for i in range(n_trials):
        if i % per_fit == 0:
            lo, hi = TUNE_SPACE["stepSize"]
            setting = {
                "maxDepth": rnd.randint(*TUNE_SPACE["maxDepth"]),
                "stepSize": math.exp(rnd.uniform(math.log(lo), math.log(hi))),
                "subsamplingRate": rnd.uniform(*TUNE_SPACE["subsamplingRate"]),
                "featureSubsetStrategy": str(round(
                    rnd.uniform(*TUNE_SPACE["featureSubsetStrategy"]), 3)),
                "minInstancesPerNode": rnd.randint(*TUNE_SPACE["minInstancesPerNode"])}
        out.append({"maxIter": rnd.randint(*TUNE_SPACE["maxIter"]), **setting})
    return out


#: bytes of a search's rows that a task may hold: more are dealt over the cluster
SEARCH_TASK_BYTES = 64 << 20


def tune(train: DataFrame, val: DataFrame, feature_cols: list[str], label: str,
         n_trials: int = 20, seed: int = 42, parallel: int = 4,
         per_fit: int | None = None) -> dict:
    """Seeded random search over the six ranges; maximise validation AUC
    (``auc_exact``, ties at half weight).  With ``per_fit`` 1 every trial draws
    all six; else trials share settings as :func:`trial_params` says, and those
    that differ in their number of rounds only share one fit to the largest of
    them: a boosted fit's first r trees are those of a fit of r rounds, so every
    trial's margins are read off the staged sums.  Fits take all labelled
    training rows; all trials are judged on all labelled validation rows by one
    grouped aggregate.  More than ``parallel`` fits of a table that a task can
    hold (``SEARCH_TASK_BYTES``) are a task each (:mod:`.boost`); else Spark ML
    makes them, the rows assembled once and kept, ``parallel`` at a time."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    known = F.col(label).isNotNull()
    held = scratch_table(val.filter(known).select(label, *feature_cols), "validation")
    trials = trial_params(n_trials, seed, *([per_fit] if per_fit else []))
    fits: dict = {}
    for i, params in enumerate(trials):
        rest = tuple(sorted((k, v) for k, v in params.items() if k != "maxIter"))
        fits.setdefault(rest, {})[i] = params["maxIter"]

    def run(item) -> DataFrame:
        setting, rounds = item
        gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed,
                            **{**CREDIT_GBT, **dict(setting), "maxIter": max(rounds.values())})
        ens = ensemble_from(PipelineModel([gbt.fit(rows)]), spark)
        return staged_margins(ens, held, feature_cols, label, rounds)

    with fit_rows(train.filter(known), feature_cols, label) as kept:
        n = kept.count()
        small = (n + held.count()) * (len(feature_cols) + 1) * 8 <= SEARCH_TASK_BYTES
        if n and small and len(fits) > parallel:
            return _best_trial(trials, search_margins(kept, held, feature_cols, label, [
                ({**CREDIT_GBT, **dict(k)}, r) for k, r in fits.items()], seed))
        rows = assemble(feature_cols).transform(kept).select(label, "features").persist()
        try:
            with ThreadPoolExecutor(parallel) as pool:
                scored = list(pool.map(inheritable_thread_target(spark)(run), fits.items()))
        finally:
            rows.unpersist()
    return _best_trial(trials, reduce(DataFrame.unionByName, scored))


def _best_trial(trials: list[dict], scored: DataFrame) -> dict:
    """The trial of the largest AUC, the first of equal ones."""
    p = scored.select(
        "trial", "y", (1 / (1 + F.exp(-2 * F.col("margin")))).alias("p"))
    aucs = {r["trial"]: float(r["auc"] or 0.0)
            for r in st.auc_exact(p, "y", "p", ["trial"]).collect()}  # one row per trial
    best = min(range(len(trials)), key=lambda i: (-aucs.get(i, 0.0), i))
    return {"params": trials[best], "auc": aucs.get(best, 0.0)}


# --- M12 ------------------------------------------------------------------------
def score_batch(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """probability, FICO-style score and A-D band for every row."""
    pred = positive_prob(model.transform(df))
    return pred.select(*keep, F.col("p").alias("probabilidade"),
                       to_score("p").alias("score"), risk_band("p").alias("nivel_risco"))


def score_trees(ens: TreeEnsemble, df: DataFrame, feature_cols: list[str], key: str) -> DataFrame:
    """M12 for an ensemble given as trees: its margin is half the log-odds."""
    p = margin_batch(ens, df, feature_cols, key).withColumn(
        "p", 1 / (1 + F.exp(-2 * F.col("margin"))))
    return p.select(key, F.col("p").alias("probabilidade"), to_score("p").alias("score"),
                    risk_band("p").alias("nivel_risco"))


# --- M14 local surrogate -------------------------------------------------------
def local_surrogate_batch(model: PipelineModel, df: DataFrame, feature_cols: list[str],
                          key: str, n_samples: int = 5000, top: int = 10, seed: int = 42,
                          kernel_width: float | None = None) -> DataFrame:
    """Local linear surrogates of a fitted booster at every row, with noise of
    the columns' own std (:func:`riskloom.operators.trees.local_surrogates`)."""
    return local_surrogates(ensemble_from(model), df, feature_cols, key,
                            fit_scaler(df, feature_cols).std, n_samples, top, seed, kernel_width)


# --- J6 -------------------------------------------------------------------------
def merge_attributions(path: DataFrame, local: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Full outer merge per feature of mean |path attribution| (``feature,
    importancia``), mean surrogate weight (``feature, peso``) and the model's
    column list; the weight is the larger of both magnitudes."""
    shap = path.select("feature", F.col("importancia").alias("shap_value"))
    lime = (local.filter(F.col("feature").isNotNull())
            .groupBy("feature").agg(F.avg("peso").alias("lime_value")))
    cols = path.sparkSession.createDataFrame([(c,) for c in feature_cols], "feature string")
    m = cols.join(shap, "feature", "full").join(lime, "feature", "full")
    return m.withColumn("peso_absoluto", F.greatest(
        F.abs(F.coalesce("shap_value", F.lit(0.0))), F.abs(F.coalesce("lime_value", F.lit(0.0)))))


# --- M15 ------------------------------------------------------------------------
def validate_gate(metrics) -> Column:
    """struct(aprovado, violacoes) from columns auc_roc, ks_statistic,
    n_amostras_teste."""
    v = F.filter(F.array(
        F.when(F.col("auc_roc") < GATE["auc_minimo"],
               F.format_string(f"AUC-ROC %.4f < minimo {GATE['auc_minimo']}", F.bround("auc_roc", 4))),
        F.when(F.col("ks_statistic") < GATE["ks_minimo"],
               F.format_string(f"KS statistic %.4f < minimo {GATE['ks_minimo']}",
                               F.bround("ks_statistic", 4))),
        F.when(F.coalesce(F.col("n_amostras_teste"), F.lit(0)) < GATE["n_amostras_minimo"],
               F.format_string(f"Amostra teste %d < minimo {GATE['n_amostras_minimo']}",
                               F.coalesce(F.col("n_amostras_teste"), F.lit(0))))),
        lambda x: x.isNotNull())
    return F.struct((F.size(v) == 0).alias("aprovado"), v.alias("violacoes"))


# --- K2 -------------------------------------------------------------------------
def importance_table(spark, model: PipelineModel, feature_cols: list[str]) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(feature_cols, imp)],
                                 "feature string, importance double") \
        .orderBy(F.col("importance").desc(), F.col("feature"))


# --- S11 ------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str, feature_cols: list[str], metadata: dict):
    """Model + feature order + metadata (one-row JSON beside the model)."""
    model.write().overwrite().save(f"{path}/model")
    spark = model.stages[-1]._java_obj  # noqa: F841  (keeps the JVM model alive)
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    meta = dict(metadata, features=list(feature_cols))
    s.createDataFrame([(json.dumps(meta, default=str),)], "meta string") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    meta = json.loads(s.read.text(f"{path}/metadata").first()[0])
    return PipelineModel.load(f"{path}/model"), meta


# --- M16 ------------------------------------------------------------------------
@dataclass
class TrainingResult:
    metrics: dict
    gate: dict
    params: dict
    importances: list
    attributions: list
    split_counts: dict
    stored: dict | None = None


def training_run(df: DataFrame, feature_cols: list[str], key: str, label: str,
                 params: dict | None = None, tune_trials: int = 0, seed: int = 42,
                 model_path: str | None = None):
    """M1 split -> M11 tune (optional; every trial draws all six parameters)
    on the training and validation rows -> M3 fit on both -> A10/A12/A13 on
    held-out rows -> M15 gate -> A16 mean |attribution| over all held-out rows
    -> S11 save, read back."""
    sp = scratch_table(stratified_split(df, key, label, seed), "split")
    test = sp.filter(F.col("split") == "test")
    p = dict(params or CREDIT_GBT)
    if tune_trials:
        best = tune(sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "val"),
                    feature_cols, label, tune_trials, seed, per_fit=1)
        p.update(best["params"] or {})
    model = train_credit(sp.filter(F.col("split") != "test"), feature_cols, label, p, seed)
    pred = positive_prob(model.transform(test)).withColumn("label_", F.col(label))
    metrics = evaluate(pred, "label_", "p")
    gate_row = df.sparkSession.createDataFrame([metrics]).select(validate_gate(None).alias("g")).first()
    ens = ensemble_from(model)
    attrs = st.mean_abs_attribution(attribute_batch(ens, test, feature_cols, key)).collect()
    stored = None
    if model_path:
        save_model(model, model_path, feature_cols, {"metrics": metrics, "params": p})
        back, meta = load_model(model_path)
        stored = {"arvores": back.stages[-1].getNumTrees, "colunas": len(meta["features"])}
    counts = {r["split"]: r["n"] for r in sp.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    res = TrainingResult(metrics, {"aprovado": gate_row["g"]["aprovado"],
                                   "violacoes": list(gate_row["g"]["violacoes"])},
                         p, [(f, float(v)) for f, v in zip(
                             feature_cols, model.stages[-1].featureImportances.toArray())],
                         [(r["feature"], float(r["importancia"])) for r in attrs], counts, stored)
    return model, res


def result_row(res: TrainingResult) -> dict:
    d = asdict(res)
    return {"metrics": json.dumps(d["metrics"]), "aprovado": bool(d["gate"]["aprovado"]),
            "violacoes": list(d["gate"]["violacoes"]), "params": json.dumps(d["params"], default=str),
            "top_importancia": json.dumps(sorted(d["importances"], key=lambda x: -x[1])[:10]),
            "top_atribuicao": json.dumps(sorted(d["attributions"], key=lambda x: (-x[1], x[0]))[:10]),
            "linhas": json.dumps(d["split_counts"], sort_keys=True),
            "modelo": json.dumps(d["stored"])}


RESULT_SCHEMA = ("metrics string, aprovado boolean, violacoes array<string>, params string, "
                 "top_importancia string, top_atribuicao string, linhas string, modelo string")
