"""Closed-set classifiers with pyspark.ml.

Folds come from the closed-set layout (``fold`` column): fold f is the test
set, the other folds train — the reference's unshuffled K-fold over the
fold-major order.  Features are the embedding vectors (``array_to_vector``).
The fold loop runs on the driver over a cached feature table; each fit is a
distributed ``pyspark.ml`` job.
"""

from __future__ import annotations

from pyspark.ml.classification import (
    MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(cs: DataFrame, vec: str = "embedding") -> DataFrame:
    return cs.select("file_id", "fold", F.col("label").cast("double").alias("label"),
                     array_to_vector(F.col(vec)).alias("features"))


def _estimator(name: str, n_labels: int, dim: int, params: dict):
    if name == "random_forest":
        return RandomForestClassifier(numTrees=params.get("n_estimators", 100), seed=params.get("seed", 1),
                                      maxDepth=params.get("max_depth", 10))
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[dim, 512, 512, n_labels], seed=params.get("seed", 1),
                                              maxIter=params.get("max_iter", 100))
    raise KeyError(name)


CLASSIFIERS = ("knn", "random_forest", "svm", "mlp")


def cross_validate(cs: DataFrame, model: str, params: dict | None = None, vec: str = "embedding",
                   folds: list[int] | None = None) -> DataFrame:
    """D4 + M1/M2/M3/M4: per-fold accuracy (fold, n, accuracy) of ``model``."""
    params = params or {}
    if model == "knn":  # all folds in one plan; nothing is fitted
        from penprint.operators.votes import distance_weighted_vote, mode_vote
        from penprint.plans.closed_set import closed_set_neighbours, fold_accuracy
        rows = cs if folds is None else cs.where(F.col("fold").isin(list(folds)))
        nb = closed_set_neighbours(cs, params.get("n_neighbors", 1), vec_col=vec)
        nb = nb.join(rows.select(F.col("file_id").alias("query_id")), "query_id", "left_semi") if folds is not None else nb
        vote = distance_weighted_vote if params.get("vote") == "distance" else mode_vote
        return fold_accuracy(vote(nb, metric="cosine") if vote is distance_weighted_vote else vote(nb))
    if model == "svm":  # all classes and folds in one job a step
        from penprint.plans.svm import svm_cross_validate
        return svm_cross_validate(cs, params, vec, folds)
    feats = features(cs, vec).persist()
    n_labels = int(feats.agg(F.max("label")).first()[0]) + 1
    dim = len(feats.select("features").first()[0])
    k = folds if folds is not None else [r[0] for r in feats.select("fold").distinct().orderBy("fold").collect()]
    out = None
    for f in k:
        train = feats.where(F.col("fold") != f)
        test = feats.where(F.col("fold") == f)
        fitted = _estimator(model, n_labels, dim, params).fit(train)
        pred = fitted.transform(test)
        acc = pred.agg(F.lit(f).alias("fold"), F.count(F.lit(1)).alias("n"),
                       F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        out = acc if out is None else out.unionByName(acc)
    return out


def first_fold_holdout(cs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold 0 validates, the other folds train."""
    return cs.where(F.col("fold") > 0), cs.where(F.col("fold") == 0)


def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float | None = None,
                     seed="p") -> DataFrame:
    """Per label, the first ceil(f * n) rows in hash order go to test,
    f = max(1/k, .1) by default where k is the smallest label count; every
    label keeps at least one training row when n >= 2.  A label may hold half
    of all rows, so the rank inside a label is the bucketed (skew-safe) ordinal."""
    from penprint.functions.rng import h
    from penprint.operators.ranking import hash_ordinal
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    if test_fraction is None:
        k = counts.agg(F.min("_n")).first()[0]
        test_fraction = max(1.0 / k, 0.1)
    r = hash_ordinal(df.withColumn("_h", h(seed, "strat", id_col)), [label], "_h", [id_col], out="_o")
    r = r.join(counts, label)
    cut = F.least(F.ceil(F.col("_n") * F.lit(test_fraction)), F.greatest(F.col("_n") - 1, F.lit(1)))
    return r.withColumn("split", F.when(F.col("_o") < cut, "test").otherwise("train")).drop("_n", "_o", "_h")
