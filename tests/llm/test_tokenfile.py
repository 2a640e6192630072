import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from penprint.llm import coder, tokenfile
from penprint.llm.tokens import default_path, encoder


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=60), st.integers(1, 90))
def test_round_trip(ids, times):
    x = np.array(ids * times, np.int64)
    assert np.array_equal(coder.decode(coder.encode(x), len(x)), x)


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 7000])
def test_block_sizes(n):
    x = np.random.default_rng(n).zipf(1.3, n) % 50257
    blocks = coder.encode(x)
    assert len(blocks) == -(-n // coder.BLOCK) and np.array_equal(coder.decode(blocks, n), x)


def test_blocks_are_independent():
    x = np.random.default_rng(1).integers(0, 900, 3 * coder.BLOCK)
    blocks = coder.encode(x)
    assert np.array_equal(coder.decode(blocks[1:2], coder.BLOCK), x[coder.BLOCK:2 * coder.BLOCK])


def test_it_compresses_and_adapts():
    x = np.tile(np.random.default_rng(2).integers(0, 50000, 200), 40)
    assert sum(map(len, coder.encode(x))) < 0.5 * 2 * len(x)


def test_damage_is_seen():
    x = np.random.default_rng(3).integers(0, 900, 5000)
    blocks = coder.encode(x)
    bad = bytearray(blocks[1])
    bad[40] ^= 4
    with pytest.raises(ValueError):
        coder.decode([blocks[0], bytes(bad), blocks[2]], len(x))
    with pytest.raises(ValueError):
        coder.decode(blocks[:2], len(x))
    with pytest.raises(ValueError):
        coder.encode(np.array([1 << 16]))
    directory, sizes, body = tokenfile.pack_segment([1, None], [2, 3], np.arange(5))
    assert tokenfile.unpack_segment(2, 5, directory, sizes, body)[0] == [1, None]
    with pytest.raises(ValueError):
        tokenfile.unpack_segment(2, 5, directory[:6] + b"\xff" + directory[7:], sizes, body)


def test_files_round_trip(make, hostile, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 3000)
    rows = hostile + [hostile[6]]
    tokenfile.write_tokens(make(rows, extra=True), str(tmp_path / "t"))
    got = sorted(tokenfile.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect(), key=lambda r: r.start)
    e, at = encoder(default_path()), 0
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    left = [(i, np.append(e.whole(t or ""), np.uint32(0)).astype("<u4").tobytes()) for i, t in rows]
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        left.remove((r.doc_id, bytes(r.ids)))
        at += r.n_tokens
    assert not left


def test_empty_table(make, spark, tmp_path):
    tokenfile.write_tokens(make([]), str(tmp_path / "t"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "t")).count() == 0
