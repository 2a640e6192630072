"""Inverted lists against brute force: exact, recall, hot lists, odd vectors."""

import numpy as np
import pytest

from penprint.operators.ivf import InvertedLists, spherical_kmeans


def clustered(n=1500, d=16, seed=3):
    """A third of all vectors crowd around one centre."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    own = np.where(r.random(n) < 1 / 3, 0, r.integers(1, 12, n))
    return (centres[own] + 0.15 * r.normal(size=(n, d))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)],
                                 "file_id long, embedding array<float>")


def nearest(x, k, queries):
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm == 0, 1, norm)
    out = {}
    for q in queries:
        s = u @ u[q]
        out[q] = sorted((j for j in range(len(x)) if j != q), key=lambda j: (-round(s[j], 9), j))[:k]
    return out


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.base_id))
    return {q: [b for _, b in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("block_rows,lists", [(64, 12), (4096, 40)])
def test_exact_search_equals_brute_force(spark, block_rows, lists):
    x = clustered()
    x[7] = 0
    df = frame(spark, x)
    q = df.where("file_id % 9 = 0 or file_id = 7")
    got = by_query(InvertedLists(df, lists=lists, block_rows=block_rows).search(q, 5, probes=1, exact=True))
    want = nearest(x, 5, [i for i in range(len(x)) if i % 9 == 0 or i == 7])
    assert got == want


def test_lists_are_ruled_out_and_recall_is_high(spark):
    x = clustered(3000)
    df = frame(spark, x)
    index = InvertedLists(df, lists=24)
    got = by_query(index.search(df.where("file_id % 10 = 0"), 5, probes=3))
    want = nearest(x, 5, range(0, 3000, 10))
    hit = sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want))
    assert hit >= 0.9
    members = index.members.count()
    assert members == 3000 and max(index.sizes.values()) < 3000


def test_hot_list_is_cut_into_bounded_parts(spark):
    x = (1 + 0.3 * np.random.default_rng(1).normal(size=(900, 8))).astype(np.float32)
    df = frame(spark, x)
    index = InvertedLists(df, lists=1, block_rows=100)
    assert index.sizes == {0: 900}
    got = by_query(index.search(df, 3, probes=1))
    assert got == nearest(x, 3, range(900))


def test_null_vectors_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.9, 0.1]), (4, [0.0, 0.0])],
                               "file_id long, embedding array<float>")
    got = by_query(InvertedLists(df).search(df, 5, exact=True))
    assert got == {1: [3, 4], 3: [1, 4], 4: [1, 3]}
    empty = df.where("file_id < 0")
    assert InvertedLists(empty).search(df, 2, exact=True).count() == 0
    assert InvertedLists(df).search(empty, 2, exact=True).count() == 0


def test_kmeans_drops_empty_centroids():
    x = np.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]] * 5)
    assert len(spherical_kmeans(x, 8)) <= 8 and len(spherical_kmeans(x, 50)) <= 10
