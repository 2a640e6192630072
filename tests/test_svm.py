"""RBF machines: the solver's optimum, a problem no line separates, odd folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.plans.classifiers import cross_validate
from penprint.plans.svm import FourierFeatures, fit_folds, scale_gamma, svm_cross_validate


def rings(n=600, seed=4):
    r = np.random.default_rng(seed)
    label = np.arange(n) % 3
    angle, radius = r.uniform(0, 2 * np.pi, n), 1 + 2 * label + r.normal(scale=0.2, size=n)
    return [(int(i % 5), int(label[i]), [float(radius[i] * np.cos(angle[i])), float(radius[i] * np.sin(angle[i]))])
            for i in range(n)]


@pytest.fixture(scope="module")
def ring_rows(spark):
    return spark.createDataFrame(rings(), "fold int, label int, vec array<double>").repartition(4).persist()


def test_features_approximate_the_kernel():
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8))
    z = FourierFeatures(8, 0.1, 20_000)(x)[:, :-1]
    exact = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_solver_reaches_the_optimum(ring_rows):
    """The gradient of |w|^2 / 2 + C sum max(0, 1 - y m)^2 vanishes."""
    features, c = FourierFeatures(2, 0.5, 64), 2.0
    w = fit_folds(ring_rows, 3, [0], features, c, steps=30)[0]
    data = [r for r in ring_rows.collect() if r.fold != 0]
    z = features(np.array([r.vec for r in data]))
    y = np.where(np.array([r.label for r in data])[:, None] == np.arange(3), 1.0, -1.0)
    gradient = w - 2 * c * z.T @ (y * np.maximum(0, 1 - y * (z @ w)))
    assert np.abs(gradient).max() < 0.05 * np.abs(2 * c * z.T @ y).max()


def test_rings_are_told_apart(ring_rows):
    cs = ring_rows.withColumnRenamed("vec", "embedding")
    got = cross_validate(cs, "svm", {"C": 10.0, "gamma": 0.5, "n_features": 256}).orderBy("fold").collect()
    assert [r.fold for r in got] == [0, 1, 2, 3, 4] and all(r.n == 120 and r.accuracy > 0.95 for r in got)


def test_one_fold_and_scale(ring_rows):
    gamma, dim = scale_gamma(ring_rows)
    x = np.array([r.vec for r in ring_rows.collect()])
    assert dim == 2 and abs(gamma - 1 / (2 * x.var())) < 1e-9
    cs = ring_rows.withColumnRenamed("vec", "embedding")
    got = svm_cross_validate(cs, {"C": 10.0, "steps": 4}, folds=[3]).collect()
    assert [r.fold for r in got] == [3]


@pytest.mark.parametrize("model,params", [("random_forest", {"n_estimators": 10}), ("mlp", {"max_iter": 30}), ("knn", {}),
                                          ("svm", {"C": 10.0, "n_features": 64, "steps": 4})])
def test_models_learn_separable_authors(spark, model, params):
    """Far better than 1 / number of authors where the vectors tell authors apart."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8)) * 3
    rows = [(a * 10 + f, f, a, [float(v) for v in centres[a] + r.normal(size=8)]) for a in range(6) for f in range(5)]
    cs = spark.createDataFrame(rows, "file_id long, fold int, label int, embedding array<float>")
    got = cross_validate(cs, model, params, folds=[0, 1]).collect()
    assert sorted(x.fold for x in got) == [0, 1] and sum(x.accuracy for x in got) / 2 > 0.75
