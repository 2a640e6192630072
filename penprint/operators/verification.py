"""Histogram verification.

Input: a closed set (``plans.closed_set.closed_set``) with ``label`` (author
ordinal), ``fold`` and ``row_index = fold * A + label``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions.vectors import cosine_similarity
from penprint.operators.histogram import Histogram, histogram_auto
from penprint.operators.scan import scan
from penprint.session import cut_lineage

TILE = 256


def stable_sigmoid(x: Column) -> Column:
    """1/(1+e^-x) without overflow (the reference's e^x/(1+e^x) gives NaN for large x)."""
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


def same_author_similarities(cs: DataFrame, vec: str = "embedding") -> DataFrame:
    """Lower triangle of each author's k x k similarity matrix.  The closed
    set holds exactly k files per author, so an author contributes k(k-1)/2
    pairs — bounded by the parameter k."""
    a = cs.select("label", F.col("fold").alias("fa"), F.col(vec).alias("va"))
    b = cs.select("label", F.col("fold").alias("fb"), F.col(vec).alias("vb"))
    return (a.join(b, "label").where(F.col("fa") > F.col("fb"))
            .select("label", "fa", "fb", cosine_similarity("va", "vb").alias("similarity")))


def fold_slice_similarities(cs: DataFrame, k: int, vec: str = "embedding",
                            include_same_author: bool = False) -> DataFrame:
    """Rows i, i+k, i+2k, ... of the fold-major order form slice i; lower
    triangle of each slice.  Same-author pairs (possible when gcd(k, A) > 1) are
    removed unless ``include_same_author`` (the reference's raw form)."""
    s = cs.select(F.pmod(F.col("row_index"), F.lit(k)).cast("int").alias("slice"), "row_index", "label",
                  F.col(vec).alias("v"))
    # tiles of about TILE rows; a row meets every tile of its slice, so a slice of A
    # rows is (A / TILE)^2 / 2 tasks' work and no pair leaves the task that makes it
    n_tiles = max(1, -(-(cs.count() // k) // TILE))
    s = (s.withColumn("_t", F.pmod(F.floor(F.col("row_index") / k), F.lit(n_tiles)).cast("int"))
         .withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
         .withColumn("_a", F.least("_t", "_o")).withColumn("_b", F.greatest("_t", "_o")))

    def pairs(table):
        key = np.array(table.column("row_index").to_pylist())
        order = np.argsort(key)
        key, label = key[order], np.array(table.column("label").to_pylist())[order]
        tile = np.array(table.column("_t").to_pylist())[order]
        x = np.array(table.column("v").to_pylist(), np.float64)[order]
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        sim = x @ x.T
        later, earlier = np.nonzero(np.tri(len(key), k=-1, dtype=bool))
        keep = np.ones(len(later), bool)
        if table.column("_a")[0].as_py() != table.column("_b")[0].as_py():
            keep &= tile[later] != tile[earlier]
        if not include_same_author:
            keep &= label[later] != label[earlier]
        later, earlier = later[keep], earlier[keep]
        return pa.table({"slice": pa.array(np.full(len(later), table.column("slice")[0].as_py()), pa.int32()),
                         "ra": pa.array(key[later], pa.int64()), "rb": pa.array(key[earlier], pa.int64()),
                         "similarity": pa.array(sim[later, earlier])})

    return s.groupBy("slice", "_a", "_b").applyInArrow(pairs, "slice int, ra long, rb long, similarity double")


def similarity_kinds(cs: DataFrame, k: int, vec: str = "embedding") -> DataFrame:
    """U4: one long table (kind: 1 same, 0 different, similarity)."""
    same = same_author_similarities(cs, vec).select(F.lit(1).alias("kind"), "similarity")
    diff = fold_slice_similarities(cs, k, vec).select(F.lit(0).alias("kind"), "similarity")
    return same.unionByName(diff)


def similarity_extremes(kinds: DataFrame) -> DataFrame:
    """Count, max and min similarity per kind."""
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("max_sim"),
                                     F.min("similarity").alias("min_sim"))


def fit_verifier(cs: DataFrame, k: int, vec: str = "embedding") -> tuple[Histogram, Histogram]:
    """M5: same-author and different-author similarity densities."""
    same = histogram_auto(same_author_similarities(cs, vec), "similarity")
    diff = histogram_auto(fold_slice_similarities(cs, k, vec), "similarity")
    return same, diff


def verification_trials(cs: DataFrame, set_size: int, n_authors: int, vec: str = "embedding",
                        n_rows: int | None = None) -> DataFrame:
    """M8: per author l, set A = its folds [0, s); true trial: set B = its folds
    [s, 2s); false trial: set B = the rows one position further in fold-major
    order (the next author, wrapping at the end).  Output one row per
    (trial, truth, pos_a, pos_b) with the cosine similarity."""
    s, a_n = set_size, n_authors
    total = n_rows if n_rows is not None else cs.count()  # = k * A rows in fold-major order
    a = cs.where(F.col("fold") < s).select(F.col("label").alias("trial"), F.col("fold").alias("pos_a"),
                                            F.col(vec).alias("va"))
    bt = cs.where((F.col("fold") >= s) & (F.col("fold") < 2 * s)).select(
        F.col("label").alias("trial"), F.lit(1).alias("truth"), (F.col("fold") - s).alias("pos_b"),
        F.col(vec).alias("vb"))
    y = F.pmod(F.col("row_index") - 1, F.lit(total))
    bf = (cs.withColumn("_y", y).where((F.floor(F.col("_y") / a_n) >= s) & (F.floor(F.col("_y") / a_n) < 2 * s))
          .select(F.pmod(F.col("_y"), F.lit(a_n)).cast("int").alias("trial"), F.lit(0).alias("truth"),
                  (F.floor(F.col("_y") / a_n) - s).cast("int").alias("pos_b"), F.col(vec).alias("vb")))
    b = bt.unionByName(bf)
    return (a.join(b, "trial")
            .select(F.lit(s).alias("set_size"), "trial", "truth", "pos_a", "pos_b",
                    cosine_similarity("va", "vb").alias("similarity")))


def _log_ratio(trials: DataFrame, same: Histogram, diff: Histogram) -> DataFrame:
    t = same.pdf(trials, "similarity", "p_same")
    t = diff.pdf(t, "similarity", "p_diff")
    return t.withColumn("llr", F.log(F.col("p_same") / F.col("p_diff")))


def score_independent(trials: DataFrame, same: Histogram, diff: Histogram, prior: float = 0.5) -> DataFrame:
    """M6: logit(prior) + sum of log(same/diff) over all pairs -> sigmoid."""
    import math
    t = _log_ratio(trials, same, diff)
    acc = t.groupBy("set_size", "trial", "truth").agg(F.sum("llr").alias("_s"))
    return acc.select("set_size", "trial", "truth",
                      stable_sigmoid(F.col("_s") + F.lit(math.log(prior / (1 - prior)))).alias("score"))


def score_averaged(trials: DataFrame, same: Histogram, diff: Histogram, prior: float = 0.5) -> DataFrame:
    """M7 + W13: the pairs (i, (i + c) mod s) form diagonal c; each diagonal's
    log-odds -> sigmoid; mean over diagonals."""
    import math
    t = _log_ratio(trials, same, diff).withColumn(
        "diag", F.pmod(F.col("pos_b") - F.col("pos_a"), F.col("set_size")))
    per = t.groupBy("set_size", "trial", "truth", "diag").agg(F.sum("llr").alias("_s"))
    per = per.withColumn("_p", stable_sigmoid(F.col("_s") + F.lit(math.log(prior / (1 - prior)))))
    return per.groupBy("set_size", "trial", "truth").agg(F.avg("_p").alias("score"))


#: D3: scorers by name; any (trials, same, diff) -> (set_size, trial, truth, score) will do.
SCORERS = {"independent": score_independent, "averaged": score_averaged}


def score_trials(cs: DataFrame, same: Histogram, diff: Histogram, set_sizes, scorer=score_independent,
                 n_authors: int | None = None, n_rows: int | None = None) -> DataFrame:
    """M8 + D3: the trials of all set sizes, scored by ``scorer``."""
    rows = cs.count() if n_rows is None else n_rows
    a = n_authors or cs.select("label").distinct().count()
    trials = [verification_trials(cs, s, a, n_rows=rows) for s in set_sizes]
    every = trials[0]
    for t in trials[1:]:
        every = every.unionByName(t)
    return scorer(every, same, diff)


def verification_report(scores: DataFrame, by=("set_size",)) -> DataFrame:
    """M9: accuracy at .5 (A14), number of trials and ROC AUC (W14 + A24) per group."""
    return threshold_accuracy(scores, by).join(auc(roc_curve(scores, by), by), list(by))


def threshold_accuracy(scores: DataFrame, by=("set_size",)) -> DataFrame:
    """Predict 1 when score > .5."""
    return scores.groupBy(*by).agg(
        F.avg(((F.col("score") > 0.5).cast("int") == F.col("truth")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("trials"))


def _cumulative(scores: DataFrame, by, neighbours: bool = False) -> DataFrame:
    """tps/fps at every distinct threshold, descending (sklearn's
    _binary_clf_curve), by a running sum over ranges of the thresholds; with
    ``neighbours`` also the next threshold's own counts."""
    g = cut_lineage(scores.groupBy(*by, F.col("score").alias("threshold")).agg(
        F.sum("truth").cast("bigint").alias("_tp"), F.sum(F.lit(1) - F.col("truth")).cast("bigint").alias("_fp")))
    ends = g.groupBy(*by).agg(F.sum("_tp").alias("P"), F.sum("_fp").alias("N"))
    behind = {"_next_tp": "_tp", "_next_fp": "_fp"} if neighbours else {}
    c = scan(g, by, [F.col("threshold").desc()], sums={"tps": F.col("_tp"), "fps": F.col("_fp")}, lead=behind)
    return c.join(ends, list(by))


def roc_curve(scores: DataFrame, by=("set_size",), drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) per group, with sklearn's start point
    (threshold = +inf, 0, 0) and optional removal of collinear points: those
    whose own counts equal the next threshold's.  Curves of any length are cut
    into ranges of thresholds (``scan.py``)."""
    by = list(by)
    c = _cumulative(scores, by, neighbours=drop_intermediate)
    if drop_intermediate:
        first = (F.col("tps") == F.col("_tp")) & (F.col("fps") == F.col("_fp"))
        same = (F.col("_next_tp") == F.col("_tp")) & (F.col("_next_fp") == F.col("_fp"))
        c = c.where(first | ~F.coalesce(same, F.lit(False)))
    pts = c.select(*by, "threshold", (F.col("fps") / F.col("N")).alias("fpr"),
                   (F.col("tps") / F.col("P")).alias("tpr"))
    start = c.select(*by).distinct().select(*by, F.lit(float("inf")).alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def auc(roc: DataFrame, by=("set_size",)) -> DataFrame:
    """Trapezoid rule over the ROC points in curve order."""
    by = list(by)
    p = scan(cut_lineage(roc), by, [F.col("threshold").desc()], lag={"_fpr": "fpr", "_tpr": "tpr"})
    seg = (F.col("fpr") - F.col("_fpr")) * (F.col("tpr") + F.col("_tpr")) / 2
    return p.withColumn("_seg", seg).groupBy(*by).agg(F.sum("_seg").alias("auc"))


def precision_recall_curve(scores: DataFrame, by=("set_size",)) -> DataFrame:
    """precision/recall at every distinct threshold plus the end point
    (precision 1, recall 0, threshold null)."""
    c = _cumulative(scores, list(by))
    pts = c.select(*by, "threshold",
                   F.when(F.col("tps") + F.col("fps") > 0, F.col("tps") / (F.col("tps") + F.col("fps")))
                   .otherwise(F.lit(0.0)).alias("precision"),
                   F.when(F.col("P") > 0, F.col("tps") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"))
    end = c.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def verification_accuracy_expr(d: str = "distance", y: str = "label") -> Column:
    """Mean of y == (d < 0.5)."""
    return F.avg(((F.col(d) < 0.5).cast("int") == F.col(y)).cast("double"))


def verification_accuracy(dist: DataFrame, d: str = "distance", y: str = "label") -> DataFrame:
    return dist.agg(verification_accuracy_expr(d, y).alias("accuracy"))


def margin_loss_expr(margin: float = 1.0, d: str = "distance", y: str = "label") -> Column:
    """Mean of y d^2 + (1 - y) max(margin - d, 0)^2."""
    v = (F.col(y) * F.pow(F.col(d), 2)
         + (F.lit(1) - F.col(y)) * F.pow(F.greatest(F.lit(margin) - F.col(d), F.lit(0.0)), 2))
    return F.avg(v)


def contrastive_margin_loss(dist: DataFrame, margin: float = 1.0, d: str = "distance",
                            y: str = "label") -> DataFrame:
    return dist.agg(margin_loss_expr(margin, d, y).alias("loss"))
