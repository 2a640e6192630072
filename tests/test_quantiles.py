"""Exact order statistics wherever the values crowd."""

import random

import numpy as np
import pytest

from penprint.operators import histogram as H


def crowded(n=20_000, seed=6):
    """99% of the values lie in a sliver of the range, a third are one value."""
    r = random.Random(seed)
    return [r.uniform(-1e6, 1e6) if i % 100 == 0 else 0.25 if i % 3 == 0 else 0.25 + r.random() * 1e-7 for i in range(n)]


@pytest.mark.parametrize("keep", [10_000, 50, 1])
def test_quantiles_of_crowded_values(spark, monkeypatch, keep):
    monkeypatch.setattr(H, "KEEP", keep)
    values = crowded()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(6).persist()
    probs = [0, 0.001, 0.25, 0.5, 0.75, 0.9995, 1]
    got = H.exact_quantiles(df, "x", probs)
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=0)


def test_two_values_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "KEEP", 3)
    df = spark.createDataFrame([(float(i % 2),) for i in range(999)], "x double")
    assert H.exact_quantiles(df, "x", [0.25, 0.5, 0.6]) == [0.0, 0.0, 1.0]
    few = spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "x double")
    assert H.exact_quantiles(few, "x", [0.25, 0.5]) == [1.5, 2.0]
    assert np.isnan(H.exact_quantiles(few.limit(0), "x", [0.5])[0])
