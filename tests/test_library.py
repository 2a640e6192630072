"""Library paths without a registered query: BYO-model embedding, sinks, BPE."""

import numpy as np
from pyspark.sql import functions as F

from penprint.operators import bpe
from penprint.operators.histogram import histogram_auto
from penprint.plans.embed import embed_with_model
from penprint.sources import sinks as SK


def test_embed_with_model_normalises(spark):
    df = spark.createDataFrame([(i, float(i + 1)) for i in range(20)], "file_id long, x double")

    def load():
        return lambda pdf: np.stack([pdf["x"].to_numpy(), 2 * pdf["x"].to_numpy()], axis=1)

    out = embed_with_model(df, load, 2).collect()
    assert len(out) == 20
    for r in out:
        assert abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6


def test_distribution_roundtrip(spark, tmp_path):
    h = histogram_auto(spark.createDataFrame([(v,) for v in [.1, .2, .2, .3, .35, .4, .5, .55, .7, .95]], "x double"), "x")
    SK.save_distribution(h, str(tmp_path / "d"), "same")
    g = SK.load_distribution(spark, str(tmp_path / "d"), "same")
    assert (g.first_edge, g.last_edge, g.n_bins, g.n) == (h.first_edge, h.last_edge, h.n_bins, h.n)
    pts = spark.createDataFrame([(0.15,), (0.6,)], "x double")
    a = sorted(r["p"] for r in h.pdf(pts, "x", "p").collect())
    b = sorted(r["p"] for r in g.pdf(pts, "x", "p").collect())
    assert a == b


def test_pairs_and_corpus_text_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("train", 1, 2, 1), ("val", 3, 4, 0)], "split string, file_1 int, file_2 int, label int")
    SK.write_pairs(pairs, str(tmp_path / "p"))
    assert SK.read_pairs(spark, str(tmp_path / "p"), "val").first()["file_1"] == 3
    lines = spark.createDataFrame([("a[EOL]\n",), ("b[EOL]\n",)], "line string")
    SK.write_corpus_text(lines, str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a[EOL]", "b[EOL]"]


def test_bpe_merges_and_encoding(spark):
    docs = spark.createDataFrame([(1, "aaab aaab"), (2, "aab ab")], "doc_id int, text string")
    merges = bpe.learn_merges(docs, 2)
    assert merges[0][:2] == ("a", "a")
    enc = {r["doc_id"]: r["pieces"] for r in bpe.subword_encode(docs, merges).collect()}
    assert "".join(enc[1]) == "aaab aaab" and "".join(enc[2]) == "aab ab"
    assert len(enc[1]) < 8
