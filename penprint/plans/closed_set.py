"""Closed-set author identification (M1–M4): sample k files per author, lay them
out in k folds, and score k-fold classifiers over per-file embeddings.

Layout (W4–W6): author ``label`` = rank of the author name among the eligible
authors (0-based); ``fold`` = position of the file among the author's k chosen
files (hash order).  Row ``row_index = fold * A + label`` is the fold-major
order of the reference; contiguous K-fold over that order gives fold f exactly
the rows with ``fold = f`` because every fold holds A rows — so ``fold`` *is*
the CV fold and no global ordering is computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions.rng import h
from penprint.operators.ranking import first_k, sorted_index
from penprint.operators.similarity import knn_join
from penprint.operators.votes import distance_weighted_vote, mode_vote


def limit_authors(authors: DataFrame, max_authors: int | None, author: str = "author") -> DataFrame:
    """the first ``max_authors`` authors in sorted name order (bounded)."""
    if max_authors is None or max_authors < 0:
        return authors
    return authors.orderBy(author).limit(max_authors)


def closed_set(files: DataFrame, k: int, max_authors: int | None = None, seed="p",
               author: str = "author", file_id: str = "file_id") -> DataFrame:
    """F6 -> F7 -> W4 -> W5: exactly k files of every author with >= k files.

    Output adds ``label`` (author ordinal), ``fold`` (0..k-1), ``row_index``.
    The author table is bounded by ``max_authors`` when given, so it is
    broadcast; the per-author pick is a ``row_number() <= k`` with a partial
    group limit before the shuffle (skew-safe for any author size).
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    counts = files.groupBy(author).agg(F.count(F.lit(1)).alias("_n"))
    elig = limit_authors(counts.where(F.col("_n") >= k).select(author), max_authors, author)
    labels = sorted_index(elig, [author], "label")
    n_authors = labels.count()
    labels = F.broadcast(labels) if max_authors and max_authors > 0 else labels
    picked = files.join(labels, author).withColumn("_h", h(seed, "file", file_id))
    picked = first_k(picked, [author], [F.col("_h"), F.col(file_id)], k, out="_rn")
    picked = picked.withColumn("fold", (F.col("_rn") - 1).cast("int")).drop("_rn", "_h")
    return (picked.withColumn("label", F.col("label").cast("int"))
            .withColumn("row_index", (F.col("fold") * F.lit(n_authors) + F.col("label")).cast("bigint")))


def closed_set_neighbours(cs: DataFrame, n_neighbors: int, metric: str = "cosine",
                          file_id: str = "file_id", vec_col: str = "embedding") -> DataFrame:
    """J7 per fold: every row against the rows of all other folds."""
    return knn_join(cs, cs, n_neighbors, id_col=file_id, vec_col=vec_col, group_col="fold",
                    query_carry=["label", "fold"], base_carry=["label"], metric=metric)


def fold_accuracy(pred: DataFrame) -> DataFrame:
    """A12 per fold: (fold, n, accuracy)."""
    return (pred.groupBy("fold")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy")))


def mean_accuracy(per_fold: DataFrame) -> DataFrame:
    """A12 mean over folds."""
    return per_fold.agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("folds"))


def closed_set_knn(emb: DataFrame, k: int = 9, max_authors: int | None = None,
                   n_neighbors: int = 1, vote: str = "mode", metric: str = "cosine",
                   seed="p", author: str = "author", file_id: str = "file_id",
                   vec_col: str = "embedding") -> DataFrame:
    """M1: k-fold closed-set k-NN accuracy, all folds in one plan.  Returns the
    per-fold table (fold, n, accuracy)."""
    cs = closed_set(emb, k, max_authors, seed, author, file_id).persist()
    nb = closed_set_neighbours(cs, n_neighbors, metric, file_id, vec_col)
    pred = mode_vote(nb) if vote == "mode" else distance_weighted_vote(nb, metric=metric)
    return fold_accuracy(pred)
