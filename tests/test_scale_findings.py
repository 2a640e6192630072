"""Memory and passes of the operators that the third round of findings named."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from penprint.functions import text as T
from penprint.operators.bpe import WordEncoder, slices
from penprint.operators.ivf import InvertedLists
from penprint.operators.similarity import best_columns, block_count, knn_join
from penprint.plans.embed import char_ngram_counts, char_ngram_embeddings, char_ngrams


def test_best_columns_keep_k_of_equal_scores():
    x, y = np.ones((3, 2)), np.ones((5000, 2))
    r, c, v = best_columns(x, y, 4, lambda a, b: a @ b.T)
    assert r.tolist() == [0] * 4 + [1] * 4 + [2] * 4 and c.tolist() == [0, 1, 2, 3] * 3  # 15,000 before
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 8)), rng.normal(size=(5000, 8))
    _, c, _ = best_columns(x, y, 5, lambda a, b: a @ b.T)
    assert c.reshape(30, 5).tolist() == np.argsort(-(x @ y.T), axis=1, kind="stable")[:, :5].tolist()


def test_blocks_are_few():
    assert block_count(600_000, 64, 12) == 19  # 293 before
    assert block_count(100_000, 4096, 12) == 49  # at most 64 MB of vectors
    assert block_count(10, 64, 12) == 1


def test_a_query_of_all_lists_is_a_row_a_shelf(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    e = spark.createDataFrame(rows, "file_id long, embedding array<float>")
    index = InvertedLists(e, lists=20, block_rows=4096)
    q = index._rows(e, "file_id", "embedding")
    assert index._probed(q, 20, False).count() <= 400 * index.shelves < 400 * 20  # 8,000 before


def test_one_hot_rows_from_the_table_and_from_the_line(spark):
    ids = spark.createDataFrame([([0, 2, None, 3, -1, 9],)], "ids array<int>")
    want = [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]
    assert ids.select(T.one_hot("ids", 3)).first()[0] == want
    got = ids.select(T.one_hot("ids", 1000)).first()[0]
    assert [sum(r) for r in got] == [1, 1, 0, 1, 0, 1] and got[3][3] == 1 and {len(r) for r in got} == {1000}
    plan = ids.select(T.one_hot("ids", 98))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan  # a sequence of 98 for each id before


def test_ngram_counts_with_repeated_and_null_ids(spark):
    rows = [(1, "abab"), (1, "abx"), (2, "aba"), (None, "aba"), (3, None), (4, "\U0001f600b\U0001f600b"), (5, "ab"), (6, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for some in (d, d.where("doc_id <> 1 OR doc_id IS NULL")):
        want = (some.select("doc_id", F.explode(char_ngrams("text", 3)).alias("gram")).groupBy("gram")
                .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")))
        assert sorted(map(tuple, char_ngram_counts(some).collect())) == sorted(map(tuple, want.collect()))
    plan = char_ngram_counts(d.where("doc_id > 1"))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan  # a row for each character before


def test_word_table_and_slices_are_bounded():
    e = WordEncoder([])
    e("x" * 1000)
    assert not e.known and e.most <= 100_000
    got = list(slices(pa.array(["aa", None, "bbbb", "c" * 50, "d"]), 6))
    assert [(s.start, s.stop) for s in got] == [(0, 3), (3, 4), (4, 5)]


def test_vectors_of_wanted_texts_use_all_frequencies(spark):
    d = spark.createDataFrame([(i, "abc" * (i + 1) + "xyz"[:i % 4]) for i in range(12)], "doc_id long, text string")
    every = {r["doc_id"]: r["embedding"] for r in char_ngram_embeddings(d, dim=64).collect()}
    some = {r["doc_id"]: r["embedding"] for r in
            char_ngram_embeddings(d, dim=64, wanted=spark.createDataFrame([(3,), (3,), (7,)], "doc_id long")).collect()}
    assert some == {k: every[k] for k in (3, 7)}


def test_token_arrays_are_not_kept(spark):
    import inspect

    from penprint.plans.q_text import x10_encode_tokens
    assert "persist" not in inspect.getsource(x10_encode_tokens)


def test_null_vectors_are_left_out(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None)], "file_id long, embedding array<float>")
    assert {(r["query_id"], r["base_id"]) for r in knn_join(e, e, 2).collect()} == {(1, 2), (2, 1)}
