"""Byte-level BPE against the library that the rank files are made for."""

import hashlib
import random

import numpy as np
import pytest

from penprint.llm import bytebpe
from tests.conftest import SF001


@pytest.fixture(scope="module")
def tokens():
    return bytebpe.read_ranks(bytebpe.default_ranks())


@pytest.fixture(scope="module")
def codec(tokens):
    return bytebpe.Codec(bytebpe.PerfectHash(tokens), bytebpe.default_pattern())


@pytest.fixture(scope="module")
def reference(tokens):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=bytebpe.default_pattern(),
                             mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_perfect_hash_is_minimal_and_exact(tokens, codec):
    table = codec.table
    assert sorted(table.at.tolist()) == list(range(len(tokens)))
    assert table.find(tokens) == list(range(len(tokens)))
    assert table.find([t + b"\xff\x00" for t in tokens[:500]] + [b""]) == [-1] * 501
    small = bytebpe.PerfectHash([b"a"])
    assert small.find([b"a", b"b"]) == [0, -1] and bytebpe.PerfectHash([]).find([b"a"]) == [-1]


def test_random_texts(codec, reference):
    r = random.Random(5)
    letters = "  \n\t\r\x1c\x85　 ab'sTéñ中文🙂12٣٤.,!?<|endoftext|>ँ‍"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    for text, raw in zip(texts, codec.encode(texts)):
        assert ids(raw) == reference.encode_ordinary(text)
        assert codec.decode(raw) == text.encode()


def test_every_code_point(codec, reference):
    texts = [f"a {chr(i)} 1{chr(i)}é" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for text, raw in zip(texts, codec.encode(texts)):
        assert ids(raw) == reference.encode_ordinary(text)


def test_merging_equals_repeated_search(codec, tokens):
    """The heap over linked bytes against its definition: merge the leftmost
    pair of the lowest rank until none is left."""
    ranks, r = codec.ranks, random.Random(9)
    for _ in range(300):
        parts = [bytes([r.choice(b"aabbtheion \xc3\xa9")]) for _ in range(r.randint(1, 40))]
        got = codec.merge(b"".join(parts))
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks),
                       default=None)
            if best is None:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert got == [ranks[p] for p in parts]


def test_long_pre_tokens(codec, reference):
    for text in ("x" * 3000, "ab" * 2000 + " " * 500, "\n" * 700):
        assert ids(codec.encode([text])[0]) == reference.encode_ordinary(text)
    assert codec.decode(codec.encode(["é" * 300_000])[0]) == ("é" * 300_000).encode()


def test_results_do_not_depend_on_what_is_kept(tokens, reference, monkeypatch):
    monkeypatch.setattr(bytebpe, "KEPT", 3)
    c = bytebpe.Codec(bytebpe.PerfectHash(tokens), bytebpe.default_pattern())
    for text in ("thntwhre zzqq thhaat", "erhwes oution zzqq", "thntwhre"):
        assert ids(c.encode([text])[0]) == reference.encode_ordinary(text)


def test_unknown_ids_are_refused(codec, tokens):
    with pytest.raises(ValueError):
        codec.decode(np.array([len(tokens)], "<u4").tobytes())


def test_hostile_rows(spark, make, hostile, reference):
    bpe = bytebpe.ByteBpe(spark)
    rows = hostile + [(70, "<|endoftext|>"), (4, "a"), (None, None)]
    got = bpe.decode(bpe.encode(make(rows, extra=True))).collect()
    assert sorted((repr(r.doc_id), ids(r.ids), bytes(r.decoded)) for r in got) == sorted(
        (repr(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert bpe.decode(bpe.encode(make([]))).count() == 0


def test_query(spark, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = bytebpe.op11_byte_bpe(spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        want = reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
