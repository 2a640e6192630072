"""Registered closed-set queries (M1, W4–W6, J7, K2–K4, A12) over ``embeddings``
(author = label, file = vec_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.operators.ivf import InvertedLists
from penprint.operators.similarity import knn_join
from penprint.operators.votes import distance_weighted_vote, mode_vote
from penprint.plans.closed_set import (
    closed_set, closed_set_neighbours, fold_accuracy, mean_accuracy,
)
from penprint.plans.registry import register
from penprint.plans.sqlparts import closed_set_sql, cosine_sql
from penprint.tables import files_from_embeddings

K = 9          # files per author = folds (reference verification/closed-set setting)
SEED = "p"
MAX_AUTHORS = 1600  # the reference's bound on the authors of a closed set


def _cs(spark, sf):
    return closed_set(files_from_embeddings(spark, sf), K, MAX_AUTHORS, SEED).persist()


def _knn_sql(n: int, vote: str, k: int = K) -> str:
    base = f"""WITH {closed_set_sql(k, SEED, MAX_AUTHORS)},
sims AS (SELECT q.file_id AS qid, q.label AS qlabel, q.fold AS qfold, b.file_id AS bid, b.label AS blabel,
                {cosine_sql('q.embedding', 'b.embedding')} AS score
         FROM cs q JOIN cs b ON q.fold <> b.fold),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, bid) AS rk FROM sims)
       WHERE rk <= {n}),"""
    if vote == "mode":
        votes = "votes AS (SELECT qid, qlabel, qfold, blabel, count(*) AS v FROM nb GROUP BY qid, qlabel, qfold, blabel),"
    else:
        votes = """nbd AS (SELECT *, sqrt(greatest(2.0 - 2.0 * score, 0.0)) AS d FROM nb),
nbz AS (SELECT *, max(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS z FROM nbd),
votes AS (SELECT qid, qlabel, qfold, blabel,
                 sum(CASE WHEN z = 1 THEN (CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / d END) AS v
          FROM nbz GROUP BY qid, qlabel, qfold, blabel),"""
    return base + votes + """
pred AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v DESC, blabel) AS r FROM votes)
         WHERE r = 1)
SELECT qfold AS fold, count(*) AS n, avg(CASE WHEN blabel = qlabel THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy
FROM pred GROUP BY qfold"""


@register("m1_closed_set_knn", _knn_sql(1, "mode"))
def m1_closed_set_knn(spark, sf):
    """Flagship: 9-fold closed-set 1-NN (cosine) accuracy per fold."""
    nb = closed_set_neighbours(_cs(spark, sf), 1)
    return fold_accuracy(mode_vote(nb))


@register("k3_mode_vote_knn5", _knn_sql(5, "mode"))
def k3_mode_vote_knn5(spark, sf):
    nb = closed_set_neighbours(_cs(spark, sf), 5)
    return fold_accuracy(mode_vote(nb))


@register("k4_distance_weighted_knn5", _knn_sql(5, "distance"))
def k4_distance_weighted_knn5(spark, sf):
    nb = closed_set_neighbours(_cs(spark, sf), 5)
    return fold_accuracy(distance_weighted_vote(nb, metric="cosine"))


@register("a12_mean_accuracy_1nn", f"""SELECT avg(accuracy)::DOUBLE AS accuracy, count(*) AS folds FROM (
{_knn_sql(1, "mode")})""")
def a12_mean_accuracy_1nn(spark, sf):
    return mean_accuracy(m1_closed_set_knn(spark, sf))


@register("w5_closed_set_folds", f"""WITH {closed_set_sql(K, SEED, MAX_AUTHORS)}
SELECT file_id, author, label, fold, row_index FROM cs""")
def w5_closed_set_folds(spark, sf):
    return _cs(spark, sf).select("file_id", "author", "label", "fold", "row_index")


J7_SQL = f"""WITH s AS (
  SELECT q.vec_id AS query_id, b.vec_id AS base_id, {cosine_sql('q.embedding', 'b.embedding')} AS score
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id)
SELECT query_id, base_id, CAST(rk AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rk FROM s)
WHERE rk <= 5"""


@register("j7_knn_top5_all", J7_SQL)
def j7_knn_top5_all(spark, sf):
    """J7/K2 over the whole table: the 5 most similar other vectors of every vector."""
    e = files_from_embeddings(spark, sf)
    nb = knn_join(e, e, 5, id_col="file_id", vec_col="embedding")
    return nb.select("query_id", "base_id", F.col("rank").cast("int").alias("rank"),
                     F.round("score", 6).alias("score"))


@register("j7_inverted_lists", J7_SQL)
def j7_inverted_lists(spark, sf):
    """J7 through the inverted-list index, exact: the k-th score of the first
    lists rules out those that cannot hold a better vector."""
    e = files_from_embeddings(spark, sf)
    nb = InvertedLists(e).search(e, 5, probes=4, exact=True)
    return nb.select("query_id", "base_id", F.col("rank").cast("int").alias("rank"),
                     F.round("score", 6).alias("score"))


@register("j7_inverted_lists_recall")
def j7_inverted_lists_recall(spark, sf):
    """J7 with three quarters of the lists probed (the table holds nearly random
    vectors in 64 dimensions), for the queries whose id is divisible by
    100 against all rows: every true neighbour (exact blocks) and whether the
    index found it."""
    e = files_from_embeddings(spark, sf)
    q = e.where(F.col("file_id") % 100 == 0)
    index = InvertedLists(e)
    got = index.search(q, 5, probes=-(-3 * len(index.centroids) // 4)).select("query_id", "base_id", F.lit(1).alias("hit"))
    want = knn_join(q, e, 5, id_col="file_id", vec_col="embedding")
    return (want.join(got, ["query_id", "base_id"], "left")
            .select("query_id", "base_id", F.col("rank").cast("int").alias("rank"), F.col("hit").isNotNull().alias("found")))


# ------------------------------------------------------------------ X22 / A21 / M13

GRID = {"k_cross_val": [5, 9], "model": ["knn1", "knn5_mode", "knn5_distance"]}
MODELS = {"knn1": (1, "mode"), "knn5_mode": (5, "mode"), "knn5_distance": (5, "distance")}


def _grid_results(spark, sf):
    """Mean closed-set accuracy for every combination of the grid."""
    import json

    from penprint.plans.experiments import param_grid
    grid = param_grid(spark, GRID).collect()  # the grid itself: 6 rows
    e = files_from_embeddings(spark, sf)
    most = max(n for n, _ in MODELS.values())
    near, out = {}, None
    for g in grid:
        k, model = json.loads(g["k_cross_val"]), json.loads(g["model"])
        if k not in near:  # the nearest 5 hold the nearest 1: one k-NN serves all models
            near[k] = closed_set_neighbours(closed_set(e, k, MAX_AUTHORS, SEED).persist(), most).persist()
        n, vote = MODELS[model]
        nb = near[k].where(F.col("rank") <= n)
        pred = mode_vote(nb) if vote == "mode" else distance_weighted_vote(nb, metric="cosine")
        acc = mean_accuracy(fold_accuracy(pred)).select(
            F.lit(int(g["combination"])).cast("bigint").alias("combination"), F.lit(model).alias("model"),
            F.lit(k).alias("k_cross_val"), F.round("accuracy", 9).alias("accuracy"))
        out = acc if out is None else out.unionByName(acc)
    return out


def _grid_sql() -> str:
    parts = []
    combo = 0
    for k in GRID["k_cross_val"]:
        for model in GRID["model"]:
            n, vote = MODELS[model]
            parts.append(f"""SELECT CAST({combo} AS BIGINT) AS combination, '{model}' AS model, {k} AS k_cross_val,
round(avg(accuracy), 9) AS accuracy FROM ({_knn_sql(n, vote, k)})""")
            combo += 1
    return " UNION ALL ".join(parts)


@register("x22_grid_results", _grid_sql())
def x22_grid_results(spark, sf):
    """X22 + A12: the (k, model) grid of closed-set classifiers, one mean accuracy each."""
    return _grid_results(spark, sf)


@register("a21_best_per_k", f"""SELECT k_cross_val, model, accuracy FROM (
SELECT *, row_number() OVER (PARTITION BY k_cross_val ORDER BY accuracy DESC, model DESC) AS rk FROM ({_grid_sql()}))
WHERE rk = 1""")
def a21_best_per_k(spark, sf):
    """The best classifier row for every k."""
    from penprint.plans.experiments import best_per_combination
    b = best_per_combination(_grid_results(spark, sf).drop("combination"), by=("k_cross_val",), tie="model")
    return b.select("k_cross_val", "model", "accuracy")


@register("m13_leaderboard", f"""SELECT model, k_cross_val, accuracy FROM (
SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, k_cross_val) AS rk FROM ({_grid_sql()}))
WHERE rk = 1""")
def m13_leaderboard(spark, sf):
    """Per model, its best k over the grid's experiments."""
    from penprint.plans.experiments import leaderboard
    r = _grid_results(spark, sf).withColumn("experiment", F.format_string("%03d", "k_cross_val"))
    return leaderboard(r, group=("model",)).select("model", "k_cross_val", "accuracy")


@register("d4_knn_cross_validate", _knn_sql(5, "distance"))
def d4_knn_cross_validate(spark, sf):
    """K-NN behind the interface of the other classifiers."""
    from penprint.plans.classifiers import cross_validate
    return cross_validate(_cs(spark, sf), "knn", {"n_neighbors": 5, "vote": "distance"})
