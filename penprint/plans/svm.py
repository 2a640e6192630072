"""M3: support vector machine with an RBF kernel, all classes and folds together.

The kernel exp(-gamma |x - y|^2) is approximated by ``n_features`` random Fourier
features, drawn from the seed alone.  On them one-vs-rest machines minimise
|w|^2 / 2 + C * sum max(0, 1 - y m)^2 over the margins m.  Each step replaces the
squared hinge by the parabola through the present margins that lies above it
(targets y * max(1, y m)), so the loss never rises and every step solves linear
equations with the same matrix:

* one job sums the features' second moments for each fold; a fold's training
  matrix is the total less its own, factored once;
* each step is one job: tasks map their rows to features, to the margins of all
  (fold, class) machines that train on them, and to sums of feature * target,
  which are added by (fold, class).

Rows are never moved or gathered; what a task sends is bounded by folds x classes
x features.  The equations are solved where the sums are made, one (fold, class) each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.session import cut_lineage, one_blas_thread

N_FEATURES = 256
STEPS = 8


class FourierFeatures:
    """x -> features whose inner products approximate the RBF kernel; the last
    one is the constant 1 (bias)."""

    def __init__(self, dim: int, gamma: float, n: int = N_FEATURES, seed: int = 1):
        r = np.random.default_rng(seed)
        self.w = r.normal(size=(dim, n)) * np.sqrt(2 * gamma)
        self.b = r.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def _arrays(batch):
    fold, label, vec = batch.column(0), batch.column(1), batch.column(2)
    x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    return fold.to_numpy(zero_copy_only=False), label.to_numpy(zero_copy_only=False), x


def _summed(df: DataFrame, keys: list[str], then=None) -> dict:
    """{key: sum of the vectors} over (keys, v) rows, added in Spark; ``then(key,
    sum)`` is applied to each sum there."""
    schema = ", ".join(f"{k} int" for k in keys) + ", v array<double>"

    def add(key, table):
        v, key = table.column("v").combine_chunks(), tuple(k.as_py() for k in key)
        total = v.flatten().to_numpy().reshape(len(v), -1).sum(0)
        total = total if then is None else then(key, total)
        return pa.Table.from_arrays([pa.array([k], pa.int32()) for k in key] + [pa.array([total], pa.list_(pa.float64()))],
                                    [*keys, "v"])

    rows = df.groupBy(*keys).applyInArrow(add, schema).toArrow()
    return {tuple(r[k] for k in keys): np.array(r["v"]) for r in rows.to_pylist()}


def scale_gamma(rows: DataFrame, vec: str = "vec") -> tuple[float, int]:
    """1 / (dimension * variance of all coordinates), and the dimension."""
    size = F.size(vec)
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)
    r = rows.agg(F.sum(total).alias("s"), F.sum(square).alias("q"), F.sum(size).alias("n"), F.max(size).alias("d")).first()
    variance = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2
    return 1.0 / (r["d"] * variance) if variance > 0 else 1.0, int(r["d"])


def fit_folds(rows: DataFrame, labels: int, folds: list[int], features: FourierFeatures, c: float,
              steps: int = STEPS) -> dict[int, np.ndarray]:
    """{fold: weights (features, labels)} of machines trained without the fold;
    ``rows``: (fold, label, vec)."""
    spark, lists = rows.sparkSession, pa.list_(pa.float64())
    one_blas_thread(spark)
    shared = spark.sparkContext.broadcast(features)

    def moments(batches):
        total = {}
        for batch in batches:
            fold, _, x = _arrays(batch)
            z = shared.value(x)
            for f in np.unique(fold):
                zf = z[fold == f]
                total[f] = total.get(f, 0) + zf.T @ zf
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.ravel() for m in total.values()], lists)],
                                             ["fold", "v"])

    own = {f: m.reshape(len(features.b) + 1, -1) for (f,), m in
           _summed(rows.mapInArrow(moments, "fold int, v array<double>"), ["fold"]).items()}
    whole = sum(own.values())
    train = [(f, (whole - own.get(f, 0) + np.eye(len(whole)) / (2 * c)).ravel().tolist()) for f in folds]
    inverse = _summed(spark.createDataFrame(train, "fold int, v array<double>"), ["fold"],
                      lambda key, m: np.linalg.inv(m.reshape(len(features.b) + 1, -1)).ravel())
    solved = spark.sparkContext.broadcast({f: m.reshape(len(whole), -1) for (f,), m in inverse.items()})
    weights = {f: np.zeros((len(whole), labels)) for f in folds}
    for _ in range(steps):
        current = spark.sparkContext.broadcast(weights)

        def targets(batches, current=current):
            total = {}
            for batch in batches:
                fold, label, x = _arrays(batch)
                z = shared.value(x)
                y = np.where(label[:, None] == np.arange(labels), 1.0, -1.0)
                for f, w in current.value.items():
                    train = fold != f
                    t = y[train] * np.maximum(1, y[train] * (z[train] @ w))
                    total[f] = total.get(f, 0) + z[train].T @ t
            if total:
                keys = [(f, j) for f in total for j in range(labels)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for f, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()),
                     pa.array([total[f][:, j] for f, j in keys], lists)], ["fold", "label", "v"])

        made = _summed(rows.mapInArrow(targets, "fold int, label int, v array<double>"), ["fold", "label"],
                       lambda key, v: solved.value[key[0]] @ v)
        weights = {f: np.stack([made[f, j] for j in range(labels)], axis=1) for f in folds}
        current.unpersist()
    return weights


def svm_cross_validate(cs: DataFrame, params: dict | None = None, vec: str = "embedding",
                       folds: list[int] | None = None) -> DataFrame:
    """(fold, n, accuracy) of RBF machines on the closed set.  ``params``: ``C``,
    ``gamma`` (a number or 'scale'), ``n_features``, ``steps``, ``seed``.  A row goes
    to the class with the largest margin (the smaller label among equals)."""
    p = params or {}
    rows = cut_lineage(cs.select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"),
                                 F.col(vec).cast("array<double>").alias("vec")))
    labels = int(rows.agg(F.max("label")).first()[0]) + 1
    every = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    folds = every if folds is None else list(folds)
    gamma, dim = scale_gamma(rows)
    if p.get("gamma", "scale") != "scale":
        gamma = float(p["gamma"])
    features = FourierFeatures(dim, gamma, p.get("n_features", N_FEATURES), p.get("seed", 1))
    weights = fit_folds(rows, labels, folds, features, p.get("C", 1.0), p.get("steps", STEPS))
    shared = rows.sparkSession.sparkContext.broadcast((features, weights))

    def judge(batches):
        features, weights = shared.value
        for batch in batches:
            fold, label, x = _arrays(batch)
            z, ok = features(x), np.zeros(len(fold), np.int64)
            for f, w in weights.items():
                mine = fold == f
                ok[mine] = (z[mine] @ w).argmax(1) == label[mine]
            known = np.isin(fold, list(weights))
            yield pa.RecordBatch.from_arrays([pa.array(fold[known], pa.int32()), pa.array(ok[known])], ["fold", "ok"])

    got = rows.mapInArrow(judge, "fold int, ok long")
    return got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
