"""X7 and X8 against merging one pair at a time, the definition itself."""

import random
import re
from collections import Counter

import pytest

from penprint.operators import bpe
from penprint.tables import table
from tests.conftest import SF001


def one_at_a_time(freq: dict, n: int) -> list:
    words = [(re.findall(bpe.SYMBOL, w), c) for w, c in freq.items()]
    out = []
    while len(out) < n:
        pairs = Counter()
        for s, c in words:
            for p in zip(s, s[1:]):
                pairs[p] += c
        if not pairs:
            break
        (left, right), count = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        out.append((left, right, count))
        for s, _ in words:
            if left not in s:
                continue
            i = 0
            while i < len(s) - 1:
                if s[i] == left and s[i + 1] == right:
                    s[i:i + 2] = [left + right]
                i += 1
    return out


def test_merges_equal_one_at_a_time(spark):
    docs = table(spark, SF001, "documents").where("doc_id < 12")
    freq = {r.word: r.freq for r in bpe.word_counts(docs).collect()}
    want = one_at_a_time(freq, 300)
    assert bpe.learn_merges(docs, 300) == want and len(want) == 300


@pytest.mark.parametrize("seed", range(60))
def test_rounds_take_the_merges_that_come_next(seed):
    """Few letters and many ties: the hard case for several merges a round."""
    r = random.Random(seed)
    freq = {"".join(r.choices("abcd"[:r.randint(1, 4)], k=r.randint(1, 9))): r.randint(1, 3) for _ in range(r.randint(1, 25))}
    words = [(list(w), c) for w, c in freq.items()]
    want, got, sizes = one_at_a_time(freq, 40), [], []
    while len(got) < 40:
        pairs, symbols = Counter(), set()
        for s, c in words:
            symbols.update(s)
            for p in zip(s, s[1:]):
                pairs[p] += c
        symbols.update(l_ + r_ for l_, r_, _ in got)
        best = [(*p, c) for p, c in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))]
        cut = best[:4]  # the driver sees a part of the pairs only
        new = bpe.next_merges(cut, symbols, 40 - len(got), len(cut) == len(best))
        if not new:
            break
        sizes.append(len(new))
        got += new
        for left, right, _ in new:
            for s, _ in words:
                i = 0
                while i < len(s) - 1:
                    if s[i] == left and s[i + 1] == right:
                        s[i:i + 2] = [left + right]
                    i += 1
    assert got == want


def test_ids_follow_the_merges(spark):
    docs = spark.createDataFrame([(1, "aaab ab\tc"), (2, ""), (3, None), (4, "abab\nzz")], "doc_id long, text string")
    merges = [("a", "b", 4), ("a", "a", 1), ("ab", "ab", 1)]
    vocab = bpe.vocabulary(bpe.word_counts(docs), merges)
    got = {r.doc_id: r for r in bpe.subword_encode(docs, merges, vocab=vocab).collect()}
    assert got[1].pieces == ["aa", "ab", " ", "ab", "[TAB]", "c"]
    assert got[4].pieces == ["abab", "[EOL]", "\n", "z", "z"]
    assert got[2].pieces == got[3].pieces == [] and got[2].ids == got[3].ids == [bpe.BOS, bpe.EOS]
    for r in got.values():
        assert r.ids == [bpe.BOS, *(vocab.get(p, bpe.UNK) for p in r.pieces), bpe.EOS]


def test_empty_corpus_has_no_merges(spark):
    assert bpe.learn_merges(spark.createDataFrame([], "doc_id long, text string"), 5) == []
