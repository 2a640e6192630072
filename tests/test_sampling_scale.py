"""Pair sampling at scale: draws inside a row, few passes over the files."""

import pytest
from pyspark.sql import functions as F

from penprint.functions.rng import h
from penprint.operators import sampling as S


def _draws(spark, key, space, quota, tag="comb"):
    t = spark.range(20_000).select(F.pmod(h("p", tag, F.lit(key), "id"), F.lit(space)).alias("v"), "id").orderBy("id")
    seen = {}
    for r in t.collect():
        seen.setdefault(r["v"], r["id"])
    return sorted(seen.items(), key=lambda x: x[1])[:quota]


@pytest.mark.parametrize("limit", [0, 512])
def test_first_distinct_draws_in_a_row_or_in_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "ROW_DRAWS", limit)
    wanted = {1: (45, 4), 2: (45, 44), 3: (10, 10), 4: (100_000, 700), 5: (3, 2)}
    g = spark.createDataFrame([(k, c, q) for k, (c, q) in wanted.items()] + [(None, 9, 3)], "k long, c long, q long")
    got = {}
    for r in S.sample_distinct(g, "k", "c", "q").collect():
        got.setdefault(r["k"], []).append((r["value"], r["draw_t"]))
    assert sorted(got) == [1, 2, 3, 4, 5]
    for k, (c, q) in wanted.items():
        want = [(v, v) for v in range(c)] if q == c else _draws(spark, k, c, q)
        assert sorted(got[k], key=lambda x: x[1]) == want


def test_small_keys_draw_little_more_than_they_need(spark):
    t = spark.range(1).select(S._draw_budget(F.lit(4), F.lit(45), 0).alias("t")).first()["t"]
    assert t <= 16  # 40 before


@pytest.mark.parametrize("split", [3, 1 << 16])
def test_file_ordinals_split_only_hot_authors(spark, monkeypatch, split):
    monkeypatch.setattr(S, "SPLIT_AUTHOR_FILES", split)
    files = spark.range(200).select(F.when(F.col("id") % 7 > 0, F.floor(F.sqrt("id"))).cast("long").alias("author"),
                                    F.col("id").alias("file_id"))
    got = {(r["author"], r["file_id"]): (r["ordinal"], r["n_files"]) for r in S.file_ordinals(files).collect()}
    by = {}
    for r in files.where("author IS NOT NULL").withColumn("h", h("p", "ord", "file_id")).collect():
        by.setdefault(r["author"], []).append((r["h"], r["file_id"]))
    want = {(a, f): (i, len(x)) for a, x in by.items() for i, (_, f) in enumerate(sorted(x))}
    assert got == want


def test_pairs_are_made_once_for_the_split(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x
    pairs = spark.range(50).select(F.udf(count, "long")("id").alias("sample_id"))
    got = S.sample_split_legacy(pairs, 40, 5, id_col="sample_id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 40, "val": 5, "test": 5}
    assert made.value == 50  # 150 before: counted, cut and ranked from scratch
