"""Neighbour votes (K2–K4) over a neighbour table
``(query_id, base_id, score, rank, query_label, query_fold, base_label)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penprint.operators.ranking import first_k


def mode_vote(nb: DataFrame) -> DataFrame:
    """K3: most common neighbour label; ties -> smallest label.
    Output (query_id, label, fold, predicted)."""
    votes = nb.groupBy("query_id", "query_label", "query_fold", "base_label").agg(
        F.count(F.lit(1)).alias("votes"))
    best = first_k(votes, ["query_id"], [F.col("votes").desc(), F.col("base_label")], 1)
    return best.select("query_id", F.col("query_label").alias("label"),
                       F.col("query_fold").alias("fold"), F.col("base_label").alias("predicted"))


def distance_weighted_vote(nb: DataFrame, metric: str = "euclidean") -> DataFrame:
    """K4: weight 1/d per neighbour; if any neighbour is at distance 0 only the
    exact matches vote (count).  ``score`` is minus the Euclidean distance for
    ``metric='euclidean'``; for cosine on unit vectors d = sqrt(2 - 2 cos)."""
    if metric == "euclidean":
        d = -F.col("score")
    else:
        d = F.sqrt(F.greatest(F.lit(2.0) - F.lit(2.0) * F.col("score"), F.lit(0.0)))
    nb = nb.withColumn("_d", d)
    nb = nb.withColumn("_zero", F.max((F.col("_d") == 0).cast("int")).over(
        Window.partitionBy("query_id")))
    w = F.when(F.col("_zero") == 1, (F.col("_d") == 0).cast("double")).otherwise(F.lit(1.0) / F.col("_d"))
    votes = nb.groupBy("query_id", "query_label", "query_fold", "base_label").agg(F.sum(w).alias("weight"))
    best = first_k(votes, ["query_id"], [F.col("weight").desc(), F.col("base_label")], 1)
    return best.select("query_id", F.col("query_label").alias("label"),
                       F.col("query_fold").alias("fold"), F.col("base_label").alias("predicted"))


def top_k_similar(nb: DataFrame, k: int) -> DataFrame:
    """K2: neighbours ranked 1..k (the neighbour table already holds <= k)."""
    return nb.where(F.col("rank") <= k)
