"""One author owns a third of all files: the skew-safe paths must stay exact."""

from pyspark.sql import functions as F

from penprint.operators import sampling as S
from penprint.operators.ranking import hash_ordinal
from penprint.functions.rng import h


def _skewed(spark):
    hot = [(0, i) for i in range(3000)]
    rest = [(a, a * 100000 + i) for a in range(1, 601) for i in range(1 + a % 9)]
    return spark.createDataFrame(hot + rest, "author int, file_id int")


def test_bucketed_ordinal_equals_plain_window(spark):
    files = _skewed(spark).withColumn("_h", h("p", "ord", "file_id"))
    got = hash_ordinal(files, ["author"], "_h", ["file_id"], out="o", bucket_bits=6)
    from pyspark.sql import Window
    w = Window.partitionBy("author").orderBy("_h", "file_id")
    want = files.withColumn("o", F.row_number().over(w) - 1)
    assert got.select("author", "file_id", "o").exceptAll(want.select("author", "file_id", "o")).count() == 0
    hot = got.where("author = 0").agg(F.min("o"), F.max("o"), F.countDistinct("o")).first()
    assert tuple(hot) == (0, 2999, 3000)


def test_hot_author_pairs_and_quotas(spark):
    files = _skewed(spark)
    counts = S.author_file_counts(files)
    quotas = S.match_quota_round_robin(counts, fraction=0.9)
    pairs = S.sample_k_combinations(files, quotas)
    q_hot = quotas.where("author = 0").first()["quota"]
    hot = pairs.where("author = 0")
    assert hot.count() == q_hot
    assert hot.select(F.least("file_1", "file_2"), F.greatest("file_1", "file_2")).distinct().count() == q_hot
    assert hot.where("file_1 = file_2").count() == 0


def test_file_ordinals_split_path_equals_plain_rank(spark, monkeypatch):
    from pyspark.sql import Window
    monkeypatch.setattr(S, "SPLIT_AUTHOR_FILES", 100)   # force the hot author into buckets
    files = _skewed(spark)
    got = S.file_ordinals(files, "p")
    w = Window.partitionBy("author").orderBy(h("p", "ord", "file_id"), F.col("file_id"))
    want = files.withColumn("ordinal", F.row_number().over(w) - 1)
    a = got.select("author", "file_id", "ordinal")
    b = want.select("author", "file_id", F.col("ordinal").cast("bigint"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_random_pairs_with_nearly_all_files_of_one_author(spark):
    """One author owns 99.9% of the files: every sample comes back, in one plan."""
    files = spark.createDataFrame([(0, i) for i in range(3996)] + [(a, 10000 + a) for a in (1, 2, 3, 4)],
                                  "author int, file_id int")
    got = S.random_pair_epoch(spark, files, 600, 0.5)
    owner = files.select("file_id", "author")
    pairs = (got.join(owner.toDF("file_1", "a1"), "file_1").join(owner.toDF("file_2", "a2"), "file_2")).collect()
    assert len(pairs) == 600 and len({p.sample_id for p in pairs}) == 600
    assert all((p.a1 == p.a2) == (p.label == 1) and p.file_1 != p.file_2 for p in pairs)
    assert any(p.label == 0 for p in pairs)


def test_random_pairs_need_two_authors(spark):
    import pytest
    one = spark.createDataFrame([(0, i) for i in range(5)], "author int, file_id int")
    with pytest.raises(ValueError):
        S.random_pair_epoch(spark, one, 10, 0.5)
    with pytest.raises(ValueError):
        S.simclr_batches(spark, one, 4, 8)


def test_quota_of_the_whole_space(spark):
    groups = spark.createDataFrame([(1, 300, 300), (2, 10 ** 9, 50), (3, 1, 1), (4, 5, 0)], "k int, sp long, q long")
    got = S.sample_distinct(groups, "k", "sp", "q").collect()
    by = {k: [r.value for r in got if r.k == k] for k in (1, 2, 3, 4)}
    assert sorted(by[1]) == list(range(300)) and len(set(by[2])) == 50 and by[3] == [0] and by[4] == []
