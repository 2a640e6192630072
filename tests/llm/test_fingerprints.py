import hashlib

import numpy as np
import pytest

from penprint.llm import fingerprints as fp
from penprint.llm.arrays import U, ascii_lower, mix, word_hashes, words


def plain(text):
    """The fingerprint by the definition, bit by bit."""
    buf = ascii_lower(np.frombuffer(text.encode(), np.uint8))
    s, e, _ = words(buf, np.array([0, len(buf)]))
    h = word_hashes(buf, s, e)
    terms = [(int(x), float(min(b - a, 12))) for x, a, b in zip(h, s, e)]
    pairs = mix(h[:-1] * U(3) + h[1:], 1) if len(h) > 1 else []
    terms += [(int(x), (a[1] + b[1]) / 2) for x, a, b in zip(pairs, terms, terms[1:])]
    total = np.zeros(fp.BITS)
    for h, w in terms:
        wide = b"".join(int(mix(np.array([h], U), 11 + k)[0]).to_bytes(8, "little") for k in range(fp.BITS // 64))
        total += w * (np.unpackbits(np.frombuffer(wide, np.uint8)).astype(float) * 2 - 1)
    return np.packbits(total > 0).tobytes()


def test_fingerprint_and_edits_against_brute_force(make, hostile):
    rows = [r for r in hostile if r[0] is not None]
    got = {r.doc_id: r for r in fp.with_next(make(rows, extra=True)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        changed = t[:len(t) - n] + nxt[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == plain(t).hex() and r.edited_fingerprint == plain(changed).hex()
        assert r.near_next == pytest.approx(fp.likeness(plain(t), plain(nxt)))
        assert r.near_edited == pytest.approx(fp.likeness(plain(t), plain(changed)))


def test_one_row_repeated_rows_nulls_empty_table(make):
    one = fp.with_next(make([(1, "a b c")])).first()
    assert one.near_next == 1.0
    got = fp.with_next(make([(1, "a b c d"), (1, "a b c d"), (None, None), (2, "x")])).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert fp.with_next(make([])).count() == 0


def test_edited_texts_are_nearer_than_neighbours(spark):
    from tests.conftest import SF001
    got = fp.op9_fingerprints(spark, SF001).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.95


@pytest.mark.parametrize("radius", [0, 3, 20])
def test_search_finds_all_within_the_radius(spark, radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2, (6, fp.BITS)).astype(np.uint8)
    prints = set()
    for b in base:
        for flips in (0, 1, radius, radius + 1, 2 * radius + 1):
            x = b.copy()
            x[r.choice(fp.BITS, flips, replace=False)] ^= 1
            prints.add(np.packbits(x).tobytes().hex())
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {(x.query, x.found): x.distance for x in fp.within_radius(df, df, radius).collect()}
    far = lambda a, b: int(round((1 - fp.likeness(bytes.fromhex(a), bytes.fromhex(b))) * fp.BITS))
    want = {(a, b): far(a, b) for a in prints for b in prints if far(a, b) <= radius}
    assert got == want


def test_bad_radius(spark):
    df = spark.createDataFrame([("00" * 32,)], "fingerprint string")
    with pytest.raises(ValueError):
        fp.within_radius(df, df, fp.BITS)
