"""Exact block k-NN against brute force; the LSH tier returns valid neighbours."""

import numpy as np
from pyspark.sql import functions as F

from penprint.operators.similarity import approx_knn_join, knn_join
from tests.conftest import SF001


def test_block_knn_matches_brute_force(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").selectExpr("vec_id AS file_id", "embedding")
    nb = knn_join(e, e, 3, block_rows=64)   # many blocks on purpose
    got = {(r["query_id"], r["rank"]): r["base_id"] for r in nb.collect()}
    pdf = e.toPandas()
    X = np.vstack(pdf["embedding"].to_numpy()).astype(np.float64)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    S = X @ X.T
    np.fill_diagonal(S, -np.inf)
    ids = pdf["file_id"].to_numpy()
    for q in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (-S[q, j], ids[j]))[:3]
        for r, j in enumerate(order, 1):
            assert got[(ids[q], r)] == ids[j]


def test_lsh_tier_returns_ranked_neighbours(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").selectExpr("vec_id AS file_id", "embedding")
    nb = approx_knn_join(e, e, 3, bucket_length=2.0, num_hash_tables=3, max_distance=2.0)
    assert nb.where("query_id = base_id").count() == 0
    assert nb.groupBy("query_id").agg(F.max("rank").alias("m")).where("m > 3").count() == 0
    assert nb.count() > 0
