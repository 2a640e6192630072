import zlib

import numpy as np
import pytest

from penprint.llm import packing
from penprint.llm.tokens import default_path, encoder


def whole(text):
    return np.append(encoder(default_path()).whole(text or ""), np.uint32(1)).astype("<u4")


def check(rows, got, tokens, segments=None, loss=None):
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids, at = whole(t), 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    pad = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens and len(s) <= (segments or 10 ** 9) and sum(r.loss_tokens for r in s) <= (loss or tokens)
        pad += 0 if at & (at - 1) == 0 else tokens - at
    return pad, len(seqs)


def test_every_id_is_packed_once(make, hostile):
    got = packing.pack_documents(make(hostile, extra=True)).collect()
    pad, n = check(hostile, got, 2048)
    assert pad == 0 and n < 60


def test_limits_on_all_dimensions(make, hostile):
    got = packing.pack_documents(make(hostile), tokens=64, segments=3, loss=40).collect()
    check(hostile, got, 64, 3, 40)


def test_prompt_tokens_bear_no_loss(make):
    rows = [(i, "question " * 30 + "ANSWER: " + "yes " * 5) for i in range(20)]
    got = packing.pack_documents(make(rows), tokens=128, segments=4, loss=24, prompt_mark="ANSWER:").collect()
    check(rows, got, 128, 4, 24)
    by = {}
    for r in got:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.loss_tokens
    assert set(by.values()) == {len(encoder(default_path()).whole(" yes yes yes yes yes ")) + 1}


def test_repeated_rows_and_empty_table(make):
    got = packing.pack_documents(make([(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sum(r.length for r in got) == 7 and sorted(r.doc_tokens for r in got if not r.start) == [1, 3, 3]
    assert packing.pack_documents(make([])).count() == 0


@pytest.mark.parametrize("bad", [dict(tokens=0), dict(segments=0), dict(loss=0)])
def test_bad_limits(make, bad):
    with pytest.raises(ValueError):
        packing.pack_documents(make([(1, "a")]), **bad)


def test_encoder_equals_the_tokenizer(hostile):
    e = encoder(default_path())
    odd = ["a  b", " x", "x ", "x \n y", "in.\n the", "in.\nthe end", "\n\n a b  c", " ", "", "It's don't  'll x", "🙂 é ñ  ",
           "a <|endoftext|> b", "tab\tand nbsp", "a\x1cb c", "end\n", "\nstart", "x\ny\nz"]
    texts = [t for _, t in hostile if t is not None] + odd
    assert [x.tolist() for x in e(texts)] == [e.whole(t).tolist() if t else [] for t in texts]


def test_tables_stay_bounded_and_go_when_idle(monkeypatch):
    """A worker serves other steps after the packing, so it may not hold on to the
    tables: they are bounded, and dropped when idle."""
    import time
    from penprint.llm import tokens
    monkeypatch.setattr(tokens, "_MOST", 50)
    e = tokens.Encoder(default_path())
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}x{i}, 🙂{i}" if i % 2 else f"b{chr(97 + j)}c{i}!" for j in range(9))
             for i in range(120)]
    assert [x.tolist() for x in e(texts + texts)] == [e.whole(t).tolist() for t in texts + texts]
    for table in (e.pieces, e.words):
        assert len(table) + len(table.old) < 4 * 50
    monkeypatch.setattr(tokens, "_IDLE", 0.2)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    held = tokens.encoder(default_path())
    assert tokens.encoder(default_path()) is held
    time.sleep(1)
    assert not tokens._ENCODERS and held(["a b"])[0].tolist() == held.whole("a b").tolist()
