"""Distributed running sums, ranks and neighbours against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from penprint.functions.rng import h
from penprint.operators import ranking, scan as sc, tokens, verification as V
from penprint.operators import sampling as S


def table(spark, n=3000):
    """One group holds most rows; values tie; a group has one row."""
    r = random.Random(1)
    rows = [(0 if r.random() < 0.7 else r.randrange(1, 9), r.randrange(n // 3) / 7, i, r.randrange(5)) for i in range(n)]
    return spark.createDataFrame(rows + [(99, 1.5, -1, 3)], "g int, x double, id long, v long").repartition(5)


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("size,fan", [(50, 4), (10 ** 6, 1024)])
def test_scan_equals_plain_windows(spark, monkeypatch, by, size, fan):
    """Borders of ranges, several levels of offsets, descending order."""
    monkeypatch.setattr(sc, "ROWS_PER_RANGE", size)
    monkeypatch.setattr(sc, "FAN", fan)
    df, order = table(spark), [F.col("x").desc(), F.col("id").asc()]
    got = sc.scan(df, by, order, sums={"s": F.col("v"), "n": F.lit(1)}, lag={"px": "x", "pid": "id"}, lead={"nid": "id"})
    w = (Window.partitionBy(*by) if by else Window).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(upto).alias("s"), F.count("*").over(upto).alias("n"), F.lag("x").over(w).alias("px"),
                     F.lag("id").over(w).alias("pid"), F.lead("id").over(w).alias("nid"))
    key = repr
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_scan_of_an_empty_table(spark):
    assert sc.scan(table(spark).limit(0), [], [F.col("x").asc()], sums={"s": F.col("v")}, lag={"p": "x"}).count() == 0


def test_scan_uses_many_tasks_for_one_group(spark, monkeypatch):
    monkeypatch.setattr(sc, "ROWS_PER_RANGE", 100)
    df = spark.range(2000).select(F.lit(1).alias("g"), F.col("id"))
    got = sc.scan(df, ["g"], [F.col("id").asc()], sums={"s": F.lit(1)})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_range" in plan
    assert got.agg(F.max("s")).first()[0] == 2000


def test_hash_ordinal_in_levels(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 4)
    monkeypatch.setattr(sc, "FAN", 8)
    df = spark.range(3000).withColumn("_h", h("p", "x", "id"))
    got = ranking.hash_ordinal(df, [], "_h", ["id"], out="o", rows=3000)
    assert "_block" in got._jdf.queryExecution().executedPlan().toString()
    ids = [r.id for r in df.orderBy("_h", "id").collect()]
    assert [r.id for r in got.orderBy("o").collect()] == ids
    assert [r.o for r in got.orderBy("o").collect()] == list(range(3000))


def test_sorted_index_and_author_starts(spark, monkeypatch):
    monkeypatch.setattr(sc, "ROWS_PER_RANGE", 40)
    df = table(spark).groupBy("x").agg(F.count("*").alias("n_files"))
    got = [(r.x, r.idx) for r in ranking.sorted_index(df, ["x"]).orderBy("x").collect()]
    assert [i for _, i in got] == list(range(len(got)))
    at = 0
    for r in S.author_starts(df, "x").orderBy("x").collect():
        assert r._start == at
        at += r.n_files


def test_first_rows_cut_inside_a_document(spark, monkeypatch):
    monkeypatch.setattr(sc, "ROWS_PER_RANGE", 2)
    rows = [(d, p, f"t{d}") for d in (5, 1, 3, None, 9) for p in range(7)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, token string")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for f in (0, 0.1, 0.2, 0.5, 0.99, 1):
        got = sorted(map(tuple, tokens._first_rows(df, "doc_id", f).collect()), key=key)
        assert got == sorted(rows, key=key)[:int(len(rows) * f)]


def test_curves_of_one_hot_group(spark, monkeypatch):
    """ROC, AUC and precision-recall are the same cut into ranges."""
    r = random.Random(2)
    rows = [(5 if r.random() < 0.9 else 1, round(r.random(), 2 if i % 2 else 5), r.randrange(2)) for i in range(3000)]
    sc_ = spark.createDataFrame(rows, "set_size int, score double, truth int")
    key = lambda x: sorted(map(repr, x.collect()))
    whole = [key(V.roc_curve(sc_)), key(V.roc_curve(sc_, drop_intermediate=False)), key(V.precision_recall_curve(sc_))]
    area = {x.set_size: x.auc for x in V.auc(V.roc_curve(sc_)).collect()}
    monkeypatch.setattr(sc, "ROWS_PER_RANGE", 60)
    assert whole == [key(V.roc_curve(sc_)), key(V.roc_curve(sc_, drop_intermediate=False)),
                     key(V.precision_recall_curve(sc_))]
    cut = {x.set_size: x.auc for x in V.auc(V.roc_curve(sc_)).collect()}
    for g in area:
        pos = [s for a, s, t in rows if a == g and t]
        neg = [s for a, s, t in rows if a == g and not t]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert abs(area[g] - want) < 1e-9 and abs(cut[g] - want) < 1e-9


def test_weighted_batches_follow_their_law(spark):
    """First draws follow the files; a hot author ends in every batch; a batch
    never repeats an author, also where it takes all of them."""
    files = spark.createDataFrame([(0, i) for i in range(900)] + [(a, 1000 * a + i) for a in range(1, 11) for i in range(10)],
                                  "author int, file_id int")
    got = S.simclr_batches(spark, files, 4, 1600).collect()
    by = {}
    for x in got:
        by.setdefault(x.batch, []).append((x.slot, x.author))
    assert len(got) == 1600 and all(len({a for _, a in b}) == 4 == len(b) for b in by.values())
    first = sum(dict(b)[0] == 0 for b in by.values()) / len(by)
    assert abs(first - 0.9) < 0.06
    everyone = S.simclr_batches(spark, files, 11, 110).collect()
    assert all(len({x.author for x in everyone if x.batch == b}) == 11 for b in range(10))
    assert S.simclr_batches(spark, files, 4, 0).count() == 0


def test_any_callable_scores_trials(spark):
    """D3: a scorer is a function of the trials and the two densities."""
    rows = [(a * 5 + f, a, f, f * 4 + a, [float(a == i) + 0.01 * f for i in range(4)]) for a in range(4) for f in range(5)]
    cs = spark.createDataFrame(rows, "file_id long, label int, fold int, row_index long, embedding array<double>")

    def largest(trials, same, diff):
        assert same is None and diff is None
        return trials.groupBy("set_size", "trial", "truth").agg(F.max("similarity").alias("score"))

    got = V.verification_report(V.score_trials(cs, None, None, [1, 2], largest)).orderBy("set_size").collect()
    assert [(r.set_size, r.trials, r.accuracy, r.auc) for r in got] == [(1, 8, 1.0, 1.0), (2, 8, 1.0, 1.0)]
