import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.llm import language
from tests.conftest import SF001

DOCS = f"{SF001}/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    got = language.op4_language_id(spark, SF001).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(DOCS)
    swapped = docs.withColumn("lang", F.when(language.holdout("doc_id", 3, 1), F.lit("zz")).otherwise(F.col("lang")))
    train = ~language.holdout("doc_id", 3, 1)
    a, b = (language.train(d.where(train)) for d in (docs, swapped))
    assert a["langs"] == b["langs"] and np.allclose(a["w"], b["w"])


def test_edge_cases(make):
    rows = [(i, "the house of the king and the " * 3, "en") for i in range(5)]
    rows += [(10 + i, "das haus des königs und der " * 3, "de") for i in range(5)]
    model = language.train(make(rows))
    odd = [(1, None), (2, ""), (3, "123 !!"), (None, "the king and the house"), (4, "the house"), (4, "the house"),
           (5, "das haus und der könig " * 20000)]
    got = language.predict(make(odd, extra=True), model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted(
        [("1", "und"), ("2", "und"), ("3", "und"), ("None", "en"), ("4", "en"), ("4", "en"), ("5", "de")])
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.predict(make([]), model).count() == 0


def test_no_labels_and_one_language(make):
    none = language.train(make([(1, "words", None)]))
    assert none["langs"] == [] and language.predict(make([(1, "words")]), none).first().lang_pred == "und"
    one = language.train(make([(1, "words", "en")]))
    assert language.predict(make([(2, "other")]), one).first().lang_pred == "en"


def test_filter_keeps_all_columns(make):
    rows = [(i, "the house of the king " * 3, "en") for i in range(4)] + [
        (9, "das haus des königs " * 3, "de"), (20, "42"), (21, None)]
    docs = make(rows, extra=True)
    got = language.keep_identified(docs, language.train(docs))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 3, 9]


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_codewords(n):
    code = language.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
    assert np.all(np.abs(code.sum(0)) < n)


def test_decoding_prefers_the_nearest_codeword():
    counts = np.full((4, 64), 5.0)
    for i in range(4):
        counts[i, i * 16:(i + 1) * 16] = 50
    model = language.fit(list("abcd"), counts)
    for i in range(4):
        best, score, close = language.decode(model, counts[i] / counts[i].sum() @ model["w"], 400)
        assert best == i and not close and score > 0.5
    assert language.decode(model, np.zeros(model["code"].shape[1]), 1)[2]


def test_long_texts_are_counted_whole():
    text = b"abcd" * (1 << 20) + b"zzzz"  # more than one piece
    whole = sum(np.bincount(x, minlength=64) for x in language._bins(np.frombuffer(text, np.uint8), 64))
    assert abs(int(language._counts(text, 64).sum()) - int(whole.sum())) <= 12
