import numpy as np
import pytest

from penprint.llm import katz
from pyspark.sql import functions as F


def compare(make, rows, held):
    docs = make(rows, extra=True)
    got = katz.score_documents(docs, held=F.coalesce(F.col("doc_id").isin([i for i in held]), F.lit(False))).collect()
    base, score, p, model, uni = katz.brute_force([t for _, t in rows], [i in held for i, _ in rows])
    want = sorted(zip([str(i) for i, _ in rows], base, score))
    have = sorted((str(r.doc_id), r.base_score, r.score) for r in got)
    assert [w[0] for w in want] == [h[0] for h in have]
    assert np.allclose([w[1:] for w in want], [h[1:] for h in have], rtol=0, atol=1e-8)
    return got, p, model, uni


def test_against_brute_force(make, hostile):
    held = {11, 14, 33, 60, 4, 2}
    got, p, model, uni = compare(make, hostile, held)
    assert {r.doc_id for r in got if r.held_out} == held
    assert len({r.train_tokens for r in got}) == 1 and got[0].train_tokens == sum(uni.values())
    unseen = max(1.0, model.one.n1 ** 2 / (2 * max(model.one.n2, 1)))
    for v in [0, b"the", b"be", b"never-seen", next(iter(uni))]:
        assert sum(p(w, v) for w in uni) + unseen * p(b"!!no such word", v) == pytest.approx(1)
    assert sum(p1 for p1 in model.unigram(np.array(list(uni.values())))) + unseen * model.p_unseen == pytest.approx(1)


def test_repeated_rows_case_and_tiny_shards(make, monkeypatch):
    monkeypatch.setattr(katz, "_SHARD", 64)
    rows = [(1, "A b a B c"), (1, "A b a B c"), (2, "c c c c c c c c"), (3, "z"), (None, "a b"), (4, "c " * 300)]
    compare(make, rows, {3})


def test_nothing_to_learn(make):
    got = katz.score_documents(make([(1, "a b"), (2, None)]), held=F.lit(True)).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in got} == {1: (3, 0, 0), 2: (1, 0, 0)}
    assert all(np.isfinite(r.score) and r.base_score == 0 for r in got)
    assert katz.score_documents(make([])).count() == 0


def test_good_turing_falls_back():
    info = np.zeros(katz.K + 4, np.int64)
    info[katz.K + 2] = 3  # only frequent types
    info[katz.K + 3] = 60
    d = katz.Discount(info)
    assert d.types == 3 and d.total == 60 and np.all((d.d[1:] > 0) & (d.d[1:] < 1)) and d.freed == 0


def test_small_counts_round_trip():
    x = np.array([0, 1, 254, 255, 256, 10 ** 12])
    assert katz.unsmall(katz.small(x)).tolist() == x.tolist()


def test_model_beats_the_base_on_held_out_text(spark):
    from tests.conftest import SF001
    got = katz.op7_language_model(spark, SF001).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
