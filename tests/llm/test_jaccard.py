import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penprint.llm import graph, jaccard


def shingles(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, num, den, size=3):
    """{row number: (set size, smallest id reachable)}."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=repr)


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (1, 2)])
def test_against_brute_force(make, hostile, num, den):
    got = jaccard.link_documents(make(hostile, extra=True), num=num, den=den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(hostile, num, den)


def test_near_copies_around_the_threshold(make, monkeypatch):
    monkeypatch.setattr(jaccard, "_CHUNK", 16)  # many chunk pairs
    r = np.random.default_rng(2)
    base = [f"w{x}" for x in r.integers(0, 10 ** 6, 130)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(int(r.integers(0, 9))):
            w[int(r.integers(0, len(w)))] = f"e{r.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    got = jaccard.link_documents(make(rows)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == brute(rows, 90, 100)


def test_empty_table_and_repeated_rows(make):
    assert jaccard.link_documents(make([])).count() == 0
    got = jaccard.link_documents(make([(7, "a b c d"), (7, "a b c d"), (9, "A b C d"), (None, "q")])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(
        [(7, 7), (7, 7), (9, 7), (None, None)], key=repr)


def test_bands_hold_every_link():
    bands = jaccard.Bands(90, 100)
    for a in range(1, 400):
        for b in range(a, 400):
            inter = a  # the best case: one set inside the other
            if 100 * inter >= 90 * (a + b - inter):
                both = set(bands.of(a)) & set(bands.of(b))
                assert both, (a, b)
                assert max(bands.most(x) for x in both) >= bands.apart(a, b)


@pytest.mark.parametrize("plan", [{}, {"skip": True}])
def test_index_finds_every_pair_within_reach(plan):
    """Sets that differ in at most H elements share an entry, for the plain and
    for a skewed allocation."""
    r = np.random.default_rng(0)
    bands = jaccard.Bands(90, 100)
    for _ in range(200):
        x = np.unique(r.integers(0, 1 << 60, int(r.integers(60, 200))).astype(np.uint64))
        band = bands.of(len(x))[0]
        most = bands.most(band)
        skewed = {band: ((0, 1), (2, 3))} if plan and most >= 3 else {}
        k = int(r.integers(0, most + 1))
        gone = int(r.integers(0, k + 1))
        y = np.unique(np.concatenate([r.permutation(x)[gone:], r.integers(0, 1 << 60, k - gone).astype(np.uint64)]))
        a = jaccard.segment_entries(x, band, most, skewed)
        b = jaccard.segment_entries(y, band, most, skewed)
        assert len(np.intersect1d(a, b)), (len(x), k)


def test_allocation_keeps_the_pigeonhole_sum():
    cost = {3: np.array([10.0 ** 6, 5, 5, 10.0 ** 5, 0, 0])}
    plan = jaccard.allocate(cost, {3: 9}, jaccard.Bands(90, 100))
    skip, wide = plan[3]
    assert set(skip) == {0, 3} and len(wide) == len(skip) and not set(skip) & set(wide)


def test_sketch_never_exceeds_the_difference():
    r = np.random.default_rng(4)
    for _ in range(50):
        x = np.unique(r.integers(0, 1 << 60, 300).astype(np.uint64))
        y = np.unique(np.concatenate([x[30:], r.integers(0, 1 << 60, 20).astype(np.uint64)]))
        a, b = (np.frombuffer(jaccard.sketch(v, 512), np.uint8) for v in (x, y))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160))
    assert graph.components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_blocks_return_a_forest_of_links():
    """Near copies in one block: all pairs link, one row fewer than classes leaves."""
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(np.append(base, r.integers(0, 1 << 60, 4).astype(np.uint64))) for _ in range(50)]
    sets += [np.unique(r.integers(0, 1 << 60, 300).astype(np.uint64)) for _ in range(5)]  # linked with nothing
    table = pa.table({"block": [1] * 55, "cross": [False] * 55, "c": [0] * 55, "cls": list(range(55)),
                      "label": [0] * 10 + list(range(10, 55)), "elements": [x.tobytes() for x in sets]})
    a, b = jaccard._spanning(table, jaccard.Bands(90, 100))
    assert len(a) == 40  # ten of the fifty have one label already
    root = list(table.column("label").to_pylist())
    for x, y in zip(a.tolist(), b.tolist()):
        root = [root[x] if k == root[y] else k for k in root]
    assert len(set(root[:50])) == 1 and len(set(root[50:]) | {root[0]}) == 6


def test_sets_are_fetched_only_for_open_pairs(make, monkeypatch):
    """Texts that share an index entry and nothing else send no sets."""
    r = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 10 ** 9, 30))) for i in range(150)]
    rows += [(1000, rows[0][1] + " one"), (1001, "a b c d e f")]
    asked, fetch = [], jaccard.candidate_sets

    def counted(docs, wanted, size):
        asked.append(wanted.count())
        return fetch(docs, wanted, size)

    monkeypatch.setattr(jaccard, "candidate_sets", counted)
    got = jaccard.link_documents(make(rows), num=90, den=100).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == brute(rows, 90, 100)
    assert asked[0] >= 2 and sum(asked) < 20


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
def test_least_shared_entries_hold_every_link(spark, monkeypatch, num, den):
    """Sets as far apart as a link allows still share an entry once each has
    left out its most shared ones, however many classes share them."""
    monkeypatch.setattr(jaccard, "_POPULAR", 1)
    r = np.random.default_rng(12)
    bands = jaccard.Bands(num, den)
    sets, pairs, met, plan = [], [], [], {}
    for _ in range(150):
        n = int(r.integers(1, 200))
        x = r.integers(0, 1 << 60, n).astype(np.uint64)
        gone = int(r.integers(0, n + 1))
        while num * (n + (more := int(r.integers(0, n + 1)))) > den * (n - gone):
            gone = gone // 2 if more else max(0, gone - 1)
        y = np.concatenate([x[gone:], r.integers(0, 1 << 60, more).astype(np.uint64)])
        pairs.append((len(sets), len(sets) + 1))
        sets += [np.unique(x), np.unique(y)]
    for band in range(8, 12):
        plan[band] = ((0, 1), (2, 3))
    for c, x in enumerate(sets):
        for b in bands.of(len(x)):
            if bands.segments(b):
                assert bands.spare(len(x), b) >= 0
                met += [(e, c) for e in jaccard.segment_entries(x, b, bands.segments(b) - 1, plan).view(np.int64).tolist()]
    table = spark.createDataFrame(met, "entry long, cls long")
    sizes = spark.createDataFrame([(c, len(x)) for c, x in enumerate(sets)], "cls long, n int")
    left = {}
    for e, c in jaccard.rarest(table, sizes, bands, plan).collect():
        left.setdefault(c, set()).add(e)
    assert sum(map(len, left.values())) < 0.9 * len(met)
    checked = 0
    for a, b in pairs:
        both = len(np.intersect1d(sets[a], sets[b]))
        if both < len(sets[a]) + len(sets[b]) - both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            assert left[a] & left[b], (len(sets[a]), len(sets[b]))
            checked += 1
    assert checked > 60


def test_chance_meetings_grow_no_faster_than_the_texts(spark):
    """Unrelated sets share empty segments: four times the sets made sixteen
    times the pairs in groups."""
    r = np.random.default_rng(13)
    bands = jaccard.Bands(80, 100)
    pairs = {"all": [], "rarest": []}
    for n in (200, 800):
        sets = [np.unique(r.integers(0, 1 << 60, int(r.integers(180, 260))).astype(np.uint64)) for _ in range(n)]
        met = pa.table({"entry": pa.array([], pa.int64()), "cls": pa.array([], pa.int64())})
        for c, x in enumerate(sets):
            for b in bands.of(len(x)):
                e = jaccard.segment_entries(x, b, bands.segments(b) - 1, {}).view(np.int64)
                met = pa.concat_tables([met, pa.table({"entry": e, "cls": np.full(len(e), c)})])
        met = spark.createDataFrame(met.to_pandas())
        sizes = spark.createDataFrame([(c, len(x)) for c, x in enumerate(sets)], "cls long, n int")
        for name, one in (("all", met), ("rarest", jaccard.rarest(met, sizes, bands, {}))):
            groups = jaccard.shared_stars(one).where("more").groupBy("a", "band").count()
            pairs[name].append(groups.select(F.sum(F.expr("count * (count - 1)"))).first()[0] or 0)
    assert pairs["all"][1] > 10 * pairs["all"][0] > 0, pairs
    assert pairs["rarest"][1] <= 6 * pairs["rarest"][0] + 1000, pairs
