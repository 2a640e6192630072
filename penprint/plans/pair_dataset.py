"""Pair datasets for verification training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.operators import sampling as S

SPLITS = ("train", "val", "test")


def build_contrastive_combinations(files: DataFrame, m: int = 200, val_test: float = 0.1,
                                   seed="p", author: str = "author", file_id: str = "file_id") -> DataFrame:
    """Author-disjoint three-way split (W2), quota ``min(m, C(min(m,n),2))``
    per author (A5), then that many distinct same-author pairs (W7).
    Output (split, author, file_1, file_2)."""
    splits = S.author_split_three_way(files, val_test, seed, author).persist()  # used three times
    fs = S.split_membership(files, splits, author).persist()
    quotas = S.max_matches_per_author(S.author_file_counts(fs, author), m).join(splits, author)
    ords = S.file_ordinals(fs, seed, author, file_id, with_counts=False).persist()  # for both files of a pair
    pairs = S.sample_k_combinations(fs, quotas, seed, "comb", author, file_id, ordinals=ords)
    return pairs.join(splits, author).select("split", author, "file_1", "file_2")


def build_pair_dataset(spark, files: DataFrame, fraction: float = 0.5, val_test: float = 0.1,
                       seed="p", author: str = "author", file_id: str = "file_id",
                       matched_per_split: dict | None = None) -> DataFrame:
    """Per split, ``total`` matched pairs by round-robin quotas (A6 -> W7)
    and as many different-author pairs (J5), labelled 1/0 (U2).

    ``total`` per split is ``matched_per_split[split]`` when given (the
    reference's 500,000 / 25,000 / 25,000 at match rate .5), else ``fraction``
    of that split's capacity sum(n-1).  All splits run in one plan: quotas,
    pair ranks and different-author draws are keyed by (split, author) or
    (split, sample).  Output (split, file_1, file_2, label, shuffle_key).
    """
    splits = S.author_split_three_way(files, val_test, seed, author).persist()
    fs = S.split_membership(files, splits, author).persist()
    counts = fs.groupBy("split", author).agg(F.count(F.lit(1)).alias("n_files"))
    quotas = S.match_quota_round_robin(counts, seed=seed, fraction=fraction, author=author,
                                       group="split", totals=matched_per_split).persist()
    n_match = {r["split"]: int(r["q"]) for r in quotas.groupBy("split").agg(F.sum("quota").alias("q")).collect()}
    ords = S.file_ordinals(fs, seed, author, file_id).persist()
    matched = S.sample_k_combinations(fs, quotas, seed, "comb", author, file_id, ordinals=ords)
    matched = matched.join(splits, author)
    unmatched = S.different_author_pairs(spark, fs, n_match, seed, "diff", author, file_id,
                                         ordinals=ords, group="split")
    m = matched.select("split", "file_1", "file_2", F.lit(1).alias("label"))
    u = unmatched.select("split", "file_1", "file_2", F.lit(0).alias("label"))
    from penprint.functions.rng import h
    return m.unionByName(u).withColumn("shuffle_key", h(seed, "shuffle", "split", "file_1", "file_2", "label"))
