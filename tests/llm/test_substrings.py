import hashlib

import numpy as np
import pytest

from penprint.llm import substrings, suffixes


def words_brute(rows, window):
    """{position in rows: (n_words, n_removed, kept)} by the definition."""
    seen, out = {}, []
    key = lambda i: -1 << 63 if i is None else i
    split = [(t or "").encode().split() for _, t in rows]
    for (i, _), ws in zip(rows, split):
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s:s + window])
            seen[w] = min(seen.get(w, 1 << 63), key(i))
    for (i, _), ws in zip(rows, split):
        gone = set()
        for s in range(len(ws) - window + 1):
            if seen[tuple(ws[s:s + window])] < key(i):
                gone.update(range(s, s + window))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()
        out.append((i, len(ws), len(gone), kept))
    return sorted(out, key=repr)


def test_word_windows_against_brute_force(make, hostile):
    for window in (50, 3):
        got = substrings.remove_repeats(make(hostile, extra=True), window=window).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == words_brute(
            hostile, window)


def test_word_windows_repeated_rows_and_empty_table(make):
    text = " ".join(f"w{i}" for i in range(60))
    got = substrings.remove_repeats(make([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 60)]
    spans = [r.spans for r in got if r.doc_id == 2][0]
    assert [(s.first, s.after) for s in spans] == [(0, 60)]
    assert substrings.remove_repeats(make([])).count() == 0


def test_byte_strings_against_brute_force(make, hostile):
    rows = [r for r in hostile if r[0] is not None]
    for width in (100, 20):
        want = suffixes.brute_force(dict(rows), width)
        got = suffixes.remove_repeats(make(rows, extra=True), width=width).collect()
        assert len(got) == len(rows)
        for r in got:
            assert [(s.first, s.after) for s in r.spans] == want[r.doc_id], r.doc_id
            raw = (dict(rows)[r.doc_id] or "").encode()
            mask = np.zeros(len(raw), bool)
            for a, b in want[r.doc_id]:
                mask[a:b] = True
            assert r.n_bytes == len(raw)
            assert bytes(r.kept) == bytes(np.frombuffer(raw, np.uint8)[~mask])


def test_byte_strings_null_ids_repeated_rows_empty_table(make):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    got = suffixes.remove_repeats(make([(None, text), (1, text), (1, text), (2, text)])).collect()
    size = len(text.encode())
    assert sorted(((r.doc_id, len(r.kept)) for r in got), key=repr) == sorted(
        [(None, size), (1, 0), (1, 0), (2, 0)], key=repr)
    assert suffixes.remove_repeats(make([])).count() == 0


def test_hot_passage_over_many_buckets(make, monkeypatch):
    """A passage of a third of all documents with other neighbours each time,
    and splitters that fall inside its runs."""
    monkeypatch.setattr(suffixes, "_UNIT", 1 << 12)
    r = np.random.default_rng(5)
    hot = "".join(map(chr, r.integers(97, 123, 180)))
    rows = {i: "".join(map(chr, r.integers(97, 100, 60))) + (hot if i % 3 == 0 else "") +
            "".join(map(chr, r.integers(97, 100, 50))) for i in range(300)}
    want = suffixes.brute_force(rows)
    got = {x.doc_id: [(s.first, s.after) for s in x.spans] for x in suffixes.remove_repeats(make(rows)).collect()}
    assert got == want


def test_multikey_order_is_lexicographic():
    r = np.random.default_rng(1)
    cols = [r.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order = suffixes.multikey_order(cols)
    rows = list(zip(*(c[order].tolist() for c in cols)))
    assert rows == sorted(rows)


def test_splitters_divide_runs_by_place():
    split = [(5, 1, 1, 10), (5, 1, 2, 0)]
    cols = [np.array([4, 5, 5, 5, 6], np.uint64), np.array([9, 1, 1, 1, 0], np.uint64), np.array([0, 1, 1, 2, 0]),
            np.array([0, 9, 10, 0, 0])]
    heads = np.array([s[0] for s in split], np.uint64)
    assert suffixes.bucket_of(split, heads, *cols).tolist() == [0, 0, 1, 2, 2]


def test_boundary_between_buckets(spark):
    """The first window of a bucket is a repeat if the bucket before ends with it."""
    def row(grp, kind, block):
        return (grp, kind, bytearray(block))

    def first(token, key, p):
        return np.uint64(token).tobytes() + suffixes._dump(
            [np.array([key]), np.array([p]), np.zeros(1), np.array([7])], suffixes._MARK)

    level2 = spark.createDataFrame([
        row(0, suffixes.FIRST, first(1, 1, 0)), row(0, suffixes.LAST, np.uint64(9).tobytes()),
        row(3, suffixes.FIRST, first(9, 2, 5)), row(3, suffixes.LAST, np.uint64(11).tobytes()),
        row(4, suffixes.FIRST, first(12, 3, 6)), row(4, suffixes.LAST, np.uint64(13).tobytes())], suffixes._ROW)
    got = suffixes.across_boundaries(level2, 8).collect()
    cols = suffixes._load([bytes(r.block) for r in got], suffixes._MARK)
    assert [c.tolist() for c in cols] == [[2], [5], [0], [7]]


def test_texts_lose_whole_characters_only(make):
    text = "é" * 120 + "tail of the first"
    rows = make([(1, text), (2, "xx" + "é" * 120), (3, "é" * 120)])
    got = {r.doc_id: r for r in suffixes.rewrite(rows, "doc_id", rows.columns).collect()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert got[2].text.startswith("xx") and 3 not in got


@pytest.mark.parametrize("bad", [0, 251])
def test_widths(make, bad):
    with pytest.raises(ValueError):
        suffixes.remove_repeats(make([(1, "a")]), width=bad)


def test_kept_hash_matches(make):
    from penprint.llm.substrings import remove_repeats
    got = remove_repeats(make([(1, "a  b\tc")])).first()
    assert hashlib.sha256(got.kept.encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()
