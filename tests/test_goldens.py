"""Hand goldens (FIXTURES.md §C) and properties on tiny inline inputs."""

import math

import pytest
from pyspark.sql import functions as F

from penprint.functions import lexer as L
from penprint.functions import text as T
from penprint.operators import sampling as S
from penprint.operators import verification as V
from penprint.operators.histogram import Histogram, histogram_auto
from penprint.operators.losses import simclr_loss, simclr_loss_matrix
from penprint.operators.votes import mode_vote


def _views(spark, v1, v2):
    rows = [(0, i, [float(x) for x in a], [float(x) for x in b]) for i, (a, b) in enumerate(zip(v1, v2))]
    return spark.createDataFrame(rows, "batch int, slot int, v1 array<double>, v2 array<double>")


@pytest.mark.parametrize("v1,v2,expected", [
    ([(1, 1), (1, 0)], [(1, 1), (0, 1)], 1.2668942214842187),
    ([(1, 1), (1, 1)], [(1, 1), (-1, -1)], 1.3436208289266625),
])
def test_g1_simclr_loss_both_methods(spark, v1, v2, expected):
    d = _views(spark, v1, v2)
    a16 = simclr_loss(d).first()["loss"]
    a17 = simclr_loss_matrix(d).first()["loss"]
    assert a16 == pytest.approx(expected, rel=1e-9)
    assert a17 == pytest.approx(a16, rel=1e-12)


def test_g2_margin_loss_and_accuracy(spark):
    d = spark.createDataFrame([(0.2, 1), (0.9, 0), (0.4, 0), (1.3, 1)], "distance double, label int")
    assert V.contrastive_margin_loss(d, 1.0).first()[0] == pytest.approx(0.525)
    assert V.verification_accuracy(d).first()[0] == pytest.approx(0.5)


G3 = [.1, .2, .2, .3, .35, .4, .5, .55, .7, .95]


def test_g3_histogram_auto(spark):
    h = histogram_auto(spark.createDataFrame([(v,) for v in G3], "x double"), "x")
    assert h.n_bins == 5
    bins = sorted(h.bins.collect(), key=lambda r: r["bin"])
    assert [r["count"] for r in bins] == [3, 3, 2, 1, 1]
    assert [round(r["lo"], 6) for r in bins] == [0.1, 0.27, 0.44, 0.61, 0.78]
    integral = sum(r["pdf"] * (r["hi"] - r["lo"]) for r in bins)
    assert integral == pytest.approx(1.0)
    pts = spark.createDataFrame([(0.95,), (0.1,), (0.05,)], "x double")
    got = {r["x"]: r["p"] for r in h.pdf(pts, "x", "p", floor=None).collect()}
    assert got[0.95] == 0.0 and got[0.05] == 0.0 and got[0.1] > 0


def test_g3_histogram_constant_values(spark):
    h = histogram_auto(spark.createDataFrame([(0.3,)] * 4, "x double"), "x")
    assert (h.n_bins, h.first_edge, h.last_edge) == (1, pytest.approx(-0.2), pytest.approx(0.8))


def _fixed_hist(spark, pdfs):
    rows = [(i, i * 0.5, (i + 1) * 0.5, 0, p) for i, p in enumerate(pdfs)]
    return Histogram(0.0, 1.0, 2, 1, spark.createDataFrame(rows, "bin long, lo double, hi double, count long, pdf double"))


def test_g4_verification_scores(spark):
    same, diff = _fixed_hist(spark, [0.4, 1.6]), _fixed_hist(spark, [1.5, 0.5])
    a = [(1.0, 0.0), (0.6, 0.8)]
    b = [(0.8, 0.6), (0.0, 1.0)]
    from penprint.functions.vectors import cosine_similarity
    rows = [(1, 0, 1, i, j, list(a[i]), list(b[j])) for i in range(2) for j in range(2)]
    t = spark.createDataFrame(rows, "set_size int, trial int, truth int, pos_a int, pos_b int, va array<double>, vb array<double>")
    t = t.withColumn("similarity", cosine_similarity("va", "vb"))
    ind = V.score_independent(t, same, diff).first()["score"]
    avg = V.score_averaged(t.withColumn("set_size", F.lit(2)), same, diff).first()["score"]
    assert ind == pytest.approx(0.8973109151651241, rel=1e-9)
    assert avg == pytest.approx(0.6857318415730049, rel=1e-9)


def test_g5_roc_auc_and_monotone_invariance(spark):
    sc = [(.9, 1), (.8, 1), (.7, 0), (.6, 1), (.55, 0), (.5, 0)]
    df = spark.createDataFrame([(1, s, t) for s, t in sc], "set_size int, score double, truth int")
    auc = V.auc(V.roc_curve(df)).first()["auc"]
    assert auc == pytest.approx(8 / 9)
    mono = df.withColumn("score", F.exp(F.col("score") * 3))
    assert V.auc(V.roc_curve(mono)).first()["auc"] == pytest.approx(auc)
    pr = V.precision_recall_curve(df).collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)


def test_g6_crop_with_end(spark):
    d = spark.createDataFrame([(list(range(10, 16)),)], "ids array<int>")
    r = d.select(T.crop_prefix_with_end("ids", 4).alias("a"), T.crop_prefix_with_end("ids", 10).alias("b"),
                 T.pad_to("ids", 8).alias("p")).first()
    assert r["a"] == [2, 10, 11, 2]
    assert r["b"] == [2, 10, 11, 12, 13, 2]
    assert r["p"] == [10, 11, 12, 13, 14, 15, 0, 0]


def test_g7_char_ids(spark):
    d = spark.createDataFrame([("qé",)], "t string")
    r = d.select(T.char_encode("t").alias("f"), T.char_encode("t", "dataset").alias("d")).first()
    assert r["f"] == [1, 2, 98, 0]
    assert r["d"] == [0, 2, 98, 1]


def test_g8_max_matches(spark):
    c = spark.createDataFrame([(n, n) for n in (1, 2, 3, 20, 21)], "author int, n_files long")
    got = {r["author"]: r["quota"] for r in S.max_matches_per_author(c, 200).collect()}
    assert got == {2: 1, 3: 3, 20: 190, 21: 200}


def test_g9_round_robin(spark):
    c = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "author string, n_files long")
    def q(total):
        return {r["author"]: r["quota"] for r in S.match_quota_round_robin(c, total).collect()}
    assert q(2) == {"a": 1, "b": 1}
    assert q(3) == {"a": 2, "b": 1}
    assert q(4) == {"a": 3, "b": 1}
    with pytest.raises(ValueError):
        q(5)


def test_g12_split_sizes_and_disjointness(spark):
    files = spark.createDataFrame([(f"u{i}", i) for i in range(25)], "author string, file_id int")
    w1 = {r["split"]: r["n"] for r in S.author_split(files, .1, .1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert w1 == {"val": 2, "test": 2, "train": 21}
    w2 = {r["split"]: r["n"] for r in S.author_split_three_way(files, .1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert w2 == {"train": 20, "val": 2, "test": 2}


def test_g16_whitespace_split(spark):
    d = spark.createDataFrame([("a  b\n",), (" x",)], "t string")
    r = [x[0] for x in d.select(T.whitespace_keeping_split("t")).collect()]
    assert r[0] == ["a", "  ", "b", "\n", ""]
    assert r[1] == ["", " ", "x"]


def test_g15_subword_cleaning(spark):
    d = spark.createDataFrame([("a\tb\nc",)], "t string")
    r = d.select(T.clean_for_subwords("t").alias("p"), T.clean_lines_for_subwords("t").alias("l"),
                 T.trainer_text("t").alias("tr")).first()
    assert r["p"] == "a[TAB]b[EOL]c"
    assert r["l"] == ["a[TAB]b[EOL]\n", "c[EOL]\n"]
    assert r["tr"] == "a[TAB]b[EOL]\nc"


def test_g19_mode_vote(spark):
    nb = spark.createDataFrame([(0, 0, 0, lab) for lab in (2, 1, 1, 2)],
                               "query_id int, query_label int, query_fold int, base_label int")
    assert mode_vote(nb).first()["predicted"] == 1


def test_pair_sampling_properties(spark):
    files = spark.createDataFrame([(a, a * 1000 + i) for a in range(30) for i in range(a % 7 + 1)],
                                  "author int, file_id int")
    counts = S.author_file_counts(files)
    quotas = S.match_quota_round_robin(counts, fraction=0.6)
    pairs = S.sample_k_combinations(files, quotas).persist()
    # quota = pairs drawn, no self pairs, no repeated pair, same author
    got = {r["author"]: r["n"] for r in pairs.groupBy("author").agg(F.count("*").alias("n")).collect()}
    want = {r["author"]: r["quota"] for r in quotas.collect()}
    assert got == want
    assert pairs.where("file_1 = file_2").count() == 0
    assert pairs.select(F.least("file_1", "file_2"), F.greatest("file_1", "file_2")).distinct().count() == pairs.count()
    assert pairs.where(F.floor(F.col("file_1") / 1000) != F.col("author")).count() == 0
    diff = S.different_author_pairs(spark, files, 500)
    assert diff.where("author_1 = author_2").count() == 0
    assert diff.count() == 500


def test_unrank_pair_is_inverse(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("r"))
    i, j = S.unrank_pair(F.col("r"))
    bad = df.select("r", i.alias("i"), j.alias("j")).where(
        (F.col("i") >= F.col("j")) | (F.col("j") * (F.col("j") - 1) / 2 + F.col("i") != F.col("r")))
    assert bad.count() == 0


def test_lexer_classes_and_encoding(spark):
    src = 'int main() { x += 0x1F; y = 1.5e3; // hi\n s = "a\\"b"; c = \'z\'; }\n#include <x>'
    d = spark.createDataFrame([(src,)], "t string")
    toks = d.select(L.lex_source("t").alias("k")).first()["k"]
    cls = {(r["class"], r["token"]) for r in toks}
    for want in [("keyword", "int"), ("identifier", "main"), ("operator", "+="), ("integer", "0x1F"),
                 ("floating", "1.5e3"), ("lc", "// hi"), ("string", '"a\\"b"'), ("char", "'z'"),
                 ("preprocessor", "#include <x>"), ("newline", "\n"), ("s", " ")]:
        assert want in cls
    ids = d.select(L.encode_tokens("t", ["main"]).alias("i")).first()["i"]
    assert ids[0] == L.KEYWORD_BASE + L.CPP_KEYWORDS.index("int")
    assert ids[2] == L.KEYWORD_BASE + len(L.CPP_KEYWORDS)  # reserved identifier 'main'
    assert L.OPERATOR_BASE + L.OPERATORS.index("(") in ids
