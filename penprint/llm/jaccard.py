"""Exact n-gram Jaccard join by universe partition and pigeonhole.

A document's set holds its distinct word shingles.  Sets of similar size share a
size band.  In a band two linked sets differ in at most H elements, so if the
universe is hashed into segments whose thresholds t (-1, 0 or 1) satisfy
sum(t + 1) > H, some segment differs in at most t elements.  A segment with
t = 0 is indexed by its content; with t = 1 by its content and every content
with one element deleted (the one-deletion neighbourhood); with t = -1 not at
all.  Thresholds start at 0; where a sample of the sets shows that indexing a
segment by its content would meet in large groups, the segment is skipped and
the cheapest ones take t = 1 instead (cost-based allocation).  Any allocation
finds every link; the costs only choose among them.

Some contents meet by chance however the thresholds are chosen: above all the
empty one, which a fixed share of all sets has in each segment, so its entries
grow with the corpus.  A band therefore has ``spare`` segments more than the sum
needs, and each set leaves out its most shared entries: as many segments as it
has beyond its own H.  Two linked sets share more entries than either leaves
out, and both leave out by the same order (the number of classes that share an
entry), so the least shared entry that they have in common stays in both.

Copies are one class from the start.  Classes that share an index entry are
candidates.  Parity sketches (bitmaps whose Hamming distance never exceeds the
size of the symmetric difference, so nothing linked is lost) go first: the whole
sets of a class are fetched only where a sketch leaves one of its pairs open.
Every class is compared with the smallest one of each of its entries (a star),
exactly where the sketch allows, and the links make components.  The others of
all entries with the same smallest class and band form a group, compared in
blocks of bounded size: first by sketch, which tells the classes that have a
near partner of another component; then these are compared exactly, and a block
returns only links that join two of its components.  So a large group of near
copies never becomes all its pairs, linked or not.

Edge cases: a text with fewer words than a shingle is one shingle; without
words or null, the set is empty and linked with nothing; null ids count as no
id; repeated rows are one class; an empty table gives no rows.  Set elements
and classes are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from penprint.llm.arrays import U, ascii_lower, mix, rolling, slices, utf8, word_hashes, words
from penprint.llm.frames import keyed, parts_for, saved, text_bytes
from penprint.llm.graph import components

SHINGLE = 3
_CHUNK = 1024
_CHUNK_BYTES = 32 << 20
_BAND_MASK = 127  # low bits of an entry: its band
_POPULAR = 4  # an entry that more classes share may be left out
_UNIT = 12 << 20
_SAMPLE_SETS = 20_000


class Bands:
    """Size bands for links where den * |A n B| >= num * |A u B|."""

    def __init__(self, num: int, den: int, ratio: float = 1.4, most: int = 1 << 34):
        if not 0 < num <= den:
            raise ValueError("similarity must lie in (0, 1]")
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < most:
            # the next band starts so high that sets two bands apart cannot link
            edges.append(max(int(edges[-1] * ratio), edges[-1] * den // num) + 1)
        self.edges = np.array(edges)
        if len(edges) > _BAND_MASK:
            raise ValueError("too many size bands")

    def of(self, n: int) -> list[int]:
        """Bands whose index a set of n elements enters: its own and, if a set
        of the band below may link with it, that one."""
        b = int(np.searchsorted(self.edges, n, "right")) - 1
        lower = b > 0 and n * self.num <= (int(self.edges[b]) - 1) * self.den
        return [b, b - 1] if lower else [b]

    def apart(self, a, b):
        """Largest symmetric difference of linked sets of a and b elements."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def most(self, band: int) -> int:
        top = int(self.edges[band + 1]) - 1
        return int(self.apart(top, top * self.den // self.num))

    def segments(self, band: int) -> int:
        """Segments of a band: one more than H, and the spare ones.  A band whose
        links are between equal sets has none."""
        most = self.most(band)
        return most + 1 + 2 + most // 16 if most else 0

    def spare(self, n: int, band: int) -> int:
        """Segments beyond those that a set of n elements needs in a band of
        ``of(n)``: its partners there have at most ``partner`` elements."""
        return self.segments(band) - 1 - int(self.apart(n, self._partner(n, band)))

    def _partner(self, n: int, band: int) -> int:
        most, top = n * self.den // self.num, int(self.edges[band + 1]) - 1
        return most if n <= top else min(most, top)

    def bits(self, n: int) -> list[int]:
        """Sketch width of each band of ``of(n)``: a power of two over 4 H.  Sets
        without common elements differ in half the bits, 2 H or more."""
        return [1 << max(6, (4 * self.most(b)).bit_length()) for b in self.of(n)]

    def chunk(self, band: int) -> int:
        """Classes of a chunk: their sets stay within ``_CHUNK_BYTES``."""
        return max(2, min(_CHUNK, _CHUNK_BYTES // (8 * int(self.edges[min(band + 1, len(self.edges) - 1)]))))


def shingle_sets(buf, off, size: int):
    """(document index, sorted distinct shingle hashes) for each text of a slice."""
    starts, ends, first = words(buf, off)
    w = word_hashes(buf, starts, ends)
    grams = rolling(w, size)
    for d in range(len(off) - 1):
        a, z = int(first[d]), int(first[d + 1])
        if z - a >= size:
            yield d, np.unique(mix(grams[a:z - size + 1], 21))
        elif z > a:
            yield d, mix(rolling(w[a:z], z - a) + U(z - a), 20)
        else:
            yield d, np.empty(0, U)


def class_of(x: np.ndarray) -> int:
    """Class of a set: a hash of its elements and their number."""
    if not len(x):
        return 0
    return int(np.append(mix(x, 22), mix(np.array([len(x)], U), 26)).sum(dtype=U).view(np.int64))


def sketch(x: np.ndarray, bits: int) -> bytes:
    """Parity bitmap: element e flips bit e modulo ``bits``."""
    count = np.bincount((mix(x, 27) % U(bits)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def segment_entries(x: np.ndarray, band: int, most: int, plan: dict) -> np.ndarray:
    """Index entries of a set in one band, which their low bits name."""
    m = most + 1
    seg = ((mix(x, 23) >> U(32)) * U(m) >> U(32)).astype(np.int64)
    each = mix(x, 24)
    value = np.zeros(m, U)
    np.add.at(value, seg, each)
    salt = mix(np.arange(m, dtype=U) + U(band << 40), 28)
    skip, wide = plan.get(band, ((), ()))
    use = np.ones(m, bool)
    use[list(skip)] = False
    out = [mix(value + salt, 25)[use]]
    if len(wide):
        hit = np.isin(seg, list(wide))
        out.append(mix(value[seg[hit]] - each[hit] + salt[seg[hit]], 25))
    return np.concatenate(out) & ~U(_BAND_MASK) | U(band)


def allocate(cost: dict, width: dict, bands: Bands) -> dict:
    """{band: (skipped segments, segments with one deletion)}.  ``cost``: pairs
    that meet in a segment of the sample; ``width``: mean elements of a segment.
    A skip is worth it where it saves more pairs than the deletions of the
    cheapest free segment add as entries."""
    plan = {}
    for band, costs in cost.items():
        order = np.argsort(-costs, kind="stable")
        low, high, skip, wide = 0, len(costs) - 1, [], []
        while low < high and costs[order[low]] > 50 * (costs[order[high]] + width[band] + 1):
            skip.append(int(order[low])), wide.append(int(order[high]))
            low, high = low + 1, high - 1
        if skip:
            plan[band] = (tuple(skip), tuple(wide))
    return plan


def _scan(rows: DataFrame, fn, schema: str, size: int) -> DataFrame:
    """mapInArrow over the sets of each document; fn(iterator of ((_key, _at),
    set, bytes)) yields record batches."""
    def run(batches):
        def each():
            for b in batches:
                key, at = (b.column(i).to_pylist() for i in (0, 1))
                buf, off = utf8(b.column(2))
                for i, j in slices(off):
                    part = off[i:j + 1] - off[i]
                    for d, x in shingle_sets(ascii_lower(buf[off[i]:off[j]]), part, size):
                        yield (key[i + d], at[i + d]), x, int(part[d + 1] - part[d])
        yield from fn(each())
    return rows.select("_key", "_at", "_text").mapInArrow(run, schema)


def _batch(schema: str, cols) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)],
                                      [n for n, _ in fields])


def _batches(rows, schema: str, size: int = 2000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(schema, list(zip(*held)))
            held = []
    if held:
        yield _batch(schema, list(zip(*held)))


def plan_segments(rows: DataFrame, n_docs: int, bands: Bands, size: int) -> dict:
    """Allocation from a sample of about ``_SAMPLE_SETS`` classes: pairs that
    meet in each (band, segment).  It changes the work, never the result."""
    def entries(each):
        def out():
            for _, x, _ in each:
                if len(x):
                    c = class_of(x)
                    for b in bands.of(len(x)):
                        m = bands.segments(b)
                        if m:
                            seg = ((mix(x, 23) >> U(32)) * U(m) >> U(32)).astype(np.int64)
                            value = np.zeros(m, U)
                            np.add.at(value, seg, mix(x, 24))
                            yield from ((b, s, int(v), c) for s, v in enumerate(value.view(np.int64).tolist()))
        yield from _batches(out(), "b int, s int, v long, c long", 20000)

    got = (_scan(rows.sample(min(1.0, _SAMPLE_SETS / max(n_docs, 1)), 11), entries,
                 "b int, s int, v long, c long", size)
           .distinct().groupBy("b", "s", "v").agg(F.count("*").alias("n"))
           .where("n > 1").groupBy("b", "s").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("cost")).collect())
    cost, width = {}, {}
    for r in got:
        if r.b not in cost:
            cost[r.b] = np.zeros(bands.segments(r.b))
            width[r.b] = int(bands.edges[r.b + 1]) / len(cost[r.b])
        cost[r.b][r.s] = r.cost
    return allocate(cost, width, bands)


def members(rows: DataFrame, bands: Bands, plan: dict, n_buckets: int, size: int) -> DataFrame:
    """(entry, cls): index entries that at least two classes share."""
    schema = "bucket int, block binary"

    def scatter(each):
        entry, cls, got = [], [], 0

        def flush():
            e = np.concatenate(entry)
            c = np.repeat(np.array([x for x, _ in cls], np.int64), [n for _, n in cls])
            pair = np.unique(np.stack([e, c.view(U)], axis=1), axis=0) if len(e) else np.empty((0, 2), U)
            e, c = pair[:, 0], pair[:, 1]
            to = ((e >> U(32)) * U(n_buckets) >> U(32)).astype(np.int64)
            order = np.lexsort((c, to))
            e, c, to = e[order], c[order], to[order]
            cut = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            rows_ = [(int(to[a]), e[a:z].tobytes() + c[a:z].tobytes()) for a, z in zip(cut, cut[1:]) if z > a]
            entry.clear(), cls.clear()
            return _batch(schema, list(zip(*rows_)) or [[], []])

        for _, x, n in each:
            got += n
            if len(x):
                c = class_of(x)
                for b in bands.of(len(x)):
                    if bands.segments(b):
                        e = segment_entries(x, b, bands.segments(b) - 1, plan)
                        entry.append(e), cls.append((c, len(e)))
            if got >= _UNIT:
                if entry:
                    yield flush()
                got = 0
        if entry:
            yield flush()

    def meet(table):
        blobs = table.column("block").to_pylist()
        e = np.concatenate([np.frombuffer(b, U, len(b) // 16) for b in blobs])
        c = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in blobs])
        order = np.lexsort((c, e))
        e, c = e[order], c[order]
        keep = np.ones(len(e), bool)
        keep[1:] = (e[1:] != e[:-1]) | (c[1:] != c[:-1])
        e, c = e[keep], c[keep]
        new = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        many = np.repeat(np.diff(np.append(new, len(e))), np.diff(np.append(new, len(e)))) > 1
        return pa.table({"entry": pa.array(e[many].view(np.int64)), "cls": pa.array(c[many])})

    return (_scan(rows, scatter, schema, size).groupBy("bucket")
            .applyInArrow(meet, "entry long, cls long"))


def rarest(met: DataFrame, sizes: DataFrame, bands: Bands, plan: dict) -> DataFrame:
    """``met`` without the most shared entries of each class in each band, as far
    as its spare segments allow.  ``sizes``: (cls, n), a row for each class.  Only
    entries of more than ``_POPULAR`` classes go: these come first in the order,
    so what goes is its beginning either way.  In a band with deletions an entry
    may stand for a segment of two."""
    many = met.groupBy("entry").agg(F.count("*").alias("_many")).where(F.col("_many") > _POPULAR)
    found = met.join(many, "entry", "left")
    places = range(len(bands.edges) - 1)
    band = F.col("entry").bitwiseAND(_BAND_MASK).cast("int")

    def of_band(values):
        return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), band)

    top = of_band(bands.edges[1:] - 1)
    n = F.col("n").cast("long")
    partner = F.floor(n * bands.den / bands.num)
    partner = F.when(n > top, F.least(partner, top)).otherwise(partner)
    apart = F.floor((n + partner) * (bands.den - bands.num) / (bands.den + bands.num))
    spare = of_band([bands.segments(b) for b in places]) - 1 - apart
    cost = of_band([2 if b in plan else 1 for b in places])
    order = Window.partitionBy("cls", band).orderBy(F.col("_many").desc(), "entry")
    popular = (found.where("_many IS NOT NULL").join(sizes, "cls")
               .withColumn("_spent", F.row_number().over(order) * cost).where(F.col("_spent") > spare))
    return found.where("_many IS NULL").select("entry", "cls").unionByName(popular.select("entry", "cls"))


def candidate_sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, elements) of one document of each class in ``wanted`` (_at, cls)."""
    schema = "cls long, elements binary"

    def run(batches):
        def out():
            for b in batches:
                buf, off = utf8(b.column(0))
                want = b.column(1).to_pylist()
                for d, x in shingle_sets(ascii_lower(buf), off, size):
                    if class_of(x) == want[d]:
                        yield want[d], x.tobytes()
        yield from _batches(out(), schema, 200)

    return (rows.select("_at", "_text").join(wanted.select("_at", "cls"), "_at")
            .select("_text", "cls").mapInArrow(run, schema).dropDuplicates(["cls"]))


def shared_stars(met: DataFrame) -> DataFrame:
    """(a, b, band, more): each class b with the smallest one that shares an entry
    with it, a row once for all their entries of a band.  ``more``: one of these
    has a third class."""
    least = met.groupBy("entry").agg(F.min("cls").alias("a"), F.count("*").alias("_n"))
    return (met.join(least, "entry").where("cls <> a")
            .groupBy("a", F.col("cls").alias("b"), F.col("entry").bitwiseAND(_BAND_MASK).cast("int").alias("band"))
            .agg(F.max(F.col("_n") > 2).alias("more")))


def _mark():
    """The sketch of the band of the row."""
    return F.when(F.col("band") == F.col("_own"), F.col("own")).otherwise(F.col("lower"))


def star_pairs(stars: DataFrame, marks: DataFrame, bands: Bands) -> DataFrame:
    """(a, b): the pairs of ``stars`` whose sketches do not rule out a link."""
    pairs = stars.select("a", "b", "band")
    for c in "ab":
        side = marks.select(F.col("cls").alias(c), F.col("n").alias(f"{c}_n"), F.col("band").alias("_own"), "own", "lower")
        pairs = pairs.join(side, c).withColumn(f"{c}_mark", _mark()).drop("_own", "own", "lower")

    def run(batches):
        for b in batches:
            keep = _near_pairs([b.column(i) for i in range(2, 6)], bands)
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    return (pairs.select("a", "b", "a_n", "a_mark", "b_n", "b_mark").mapInArrow(run, "a long, b long").distinct())


def _near_pairs(columns, bands: Bands) -> pa.Array:
    """Places of the pairs that sizes and sketches leave open."""
    n = [columns[i].to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2)]
    blobs = [columns[i].to_pylist() for i in (1, 3)]
    near = np.minimum(*n) * bands.den >= np.maximum(*n) * bands.num
    by_width: dict[int, list] = {}
    for i in np.flatnonzero(near).tolist():
        by_width.setdefault(len(blobs[0][i]), []).append(i)
    keep = []
    for found in by_width.values():
        at = np.array(found)
        x, y = (np.frombuffer(b"".join(k[i] for i in found), U).reshape(len(found), -1) for k in blobs)
        apart = np.bitwise_count(x ^ y).sum(axis=1)
        keep.append(at[apart <= bands.apart(n[0][at], n[1][at])])
    return pa.array(np.sort(np.concatenate(keep)) if keep else np.empty(0, np.int64))


def near_classes(groups: DataFrame, marks: DataFrame, bands: Bands) -> DataFrame:
    """(block, cross, c, cls, label): the classes of a block that have a partner
    with another label in it whose sketch does not rule out a link.  ``groups``:
    (a, band, cls, label).  A group (a, band) is cut into chunks of about
    ``_CHUNK`` classes, and each pair of chunks is a block."""
    by = ["a", "band"]
    sizes = groups.groupBy(*by).agg(F.count("*").alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    chunk = F.array(*[F.lit(bands.chunk(b)) for b in range(len(bands.edges))])
    dealt = (groups.join(sizes.where("_n > 1 AND _lo <> _hi"), by)
             .withColumn("_k", F.ceil(F.col("_n") / F.get(chunk, F.col("band"))).cast("int"))
             .withColumn("c", F.pmod(F.xxhash64("cls"), F.col("_k")).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
             .withColumn("_i", F.least("c", "_o")).withColumn("_j", F.greatest("c", "_o")))
    # many blocks share a task: a call for each of them would cost more than its work
    n_parts = 4 * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = (dealt.withColumn("block", F.xxhash64("a", "band", "_i", "_j"))
            .withColumn("_part", F.pmod(F.col("block"), F.lit(n_parts)))
            .join(marks.select("cls", "n", F.col("band").alias("_own"), "own", "lower"), "cls")
            .select("_part", "block", "band", (F.col("_i") != F.col("_j")).alias("cross"), "c", "cls", "label", "n",
                    _mark().alias("mark")))

    def run(table):
        return table.select(["block", "cross", "c", "cls", "label"]).filter(pa.array(_near_in_blocks(table, bands)))

    return full.groupBy("_part").applyInArrow(run, "block long, cross boolean, c int, cls long, label long")


def _near_in_blocks(table, bands: Bands) -> np.ndarray:
    """Which rows have a near partner in their block.  Pairs are compared for all
    blocks of a band at once: those that stand k rows apart, for k = 1, 2, ..."""
    block, cls, label, band = (table.column(c).to_numpy() for c in ("block", "cls", "label", "band"))
    n, chunk = table.column("n").to_numpy().astype(np.int64), table.column("c").to_numpy()
    cross, blobs = table.column("cross").to_numpy(zero_copy_only=False), table.column("mark").to_pylist()
    found = np.zeros(len(block), bool)
    for one in np.unique(band).tolist():
        at = np.flatnonzero(band == one)
        at = at[np.lexsort((cls[at], block[at]))]
        marks = np.frombuffer(b"".join(blobs[i] for i in at.tolist()), U).reshape(len(at), -1)
        new = np.concatenate([[True], block[at][1:] != block[at][:-1]])
        after = np.append(np.flatnonzero(new), len(at))[np.cumsum(new)] - np.arange(len(at))  # rows of the block from here on
        for k in range(1, int(after.max())):
            x = np.flatnonzero(after > k)
            u, v = at[x], at[x + k]
            small, large = np.minimum(n[u], n[v]), np.maximum(n[u], n[v])
            ok = (label[u] != label[v]) & (~cross[u] | (chunk[u] != chunk[v])) & (small * bands.den >= large * bands.num)
            x, most = x[ok], bands.apart(n[u[ok]], n[v[ok]])
            for i in range(0, len(x), 1 << 15):
                p = x[i:i + (1 << 15)]
                p = p[np.bitwise_count(marks[p] ^ marks[p + k]).sum(axis=1) <= most[i:i + (1 << 15)]]
                found[at[p]] = found[at[p + k]] = True
    return found


def block_links(near: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """(a, b): links between classes of a block (``near_classes``), exactly
    verified; only those that join two labels not joined by others of the block."""
    def run(table):
        return pa.table(_spanning(table, bands), names=["a", "b"])

    return near.join(sets, "cls").groupBy("block").applyInArrow(run, "a long, b long").distinct()


def _spanning(table, bands: Bands) -> list[np.ndarray]:
    table = table.sort_by("cls")
    cls, chunk = table.column("cls").to_numpy(), table.column("c").to_numpy()
    cross = bool(table.column("cross")[0].as_py())
    group = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]  # labels, then what they join to
    sets = [np.frombuffer(x, U) for x in table.column("elements").to_pylist()]
    n = np.array([len(x) for x in sets])
    # rows that hold each element, so the sizes of a row's intersections are one count
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holder = np.repeat(np.arange(len(sets)), n)[np.argsort(ids, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    ends = np.cumsum(n)
    out = [[], []]
    for i in range(len(sets) - 1):
        own = ids[ends[i] - n[i]:ends[i]]
        many = first[own + 1] - first[own]
        at = np.arange(int(many.sum())) + np.repeat(first[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        both = np.bincount(holder[at], minlength=len(sets))
        link = (bands.den * both >= bands.num * (n[i] + n - both)) & (group != group[i])
        link[:i] = False
        if cross:
            link &= chunk != chunk[i]
        j = np.flatnonzero(link)
        if len(j):
            joined, one = np.unique(group[j], return_index=True)
            out[0].append(np.full(len(one), cls[i])), out[1].append(cls[j[one]])
            group[np.isin(group, joined)] = group[i]
    return [np.concatenate(o) if o else np.empty(0, np.int64) for o in out]


def verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    one = sets.select(F.col("cls").alias("a"), F.col("elements").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("elements").alias("y"))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bands.den * both >= bands.num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return (pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                   num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row; class_id is
    null for an empty set."""
    spark = docs.sparkSession
    bands = Bands(num, den)
    rows = keyed(docs, id_col, text_col).select("_key", F.xxhash64("_key", "_text").alias("_at"), "_text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(2 * parts, int(text_bytes(docs, text_col) / 24e6) + 1)
    schema = "_key long, _at long, cls long, n int, band int, own binary, lower binary"

    def measure(each):
        def out():
            for at, x, _ in each:
                marks = [sketch(x, k) for k in bands.bits(len(x))] if len(x) else []
                yield (*at, class_of(x), len(x), bands.of(len(x))[0] if marks else None,
                       marks[0] if marks else None, marks[1] if len(marks) > 1 else None)
        yield from _batches(out(), schema, 500)

    base = saved(_scan(rows, measure, schema, size))
    plan = plan_segments(rows, base.count(), bands, size)
    met = saved(members(rows, bands, plan, n_buckets, size))
    marks = saved(base.where("n > 0").join(met.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
                  .drop("_key"))
    stars = saved(shared_stars(saved(rarest(met, marks.select("cls", "n"), bands, plan))))

    def sets_of(classes):
        return saved(candidate_sets(rows, marks.join(classes.distinct(), "cls", "left_semi"), size))

    pairs = saved(star_pairs(stars, marks, bands))
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")))
    first = saved(verified(pairs, sets, bands).coalesce(parts_for(50 * pairs.count())))
    roots = components(first)
    groups = (stars.where("more").select("a", "band", F.col("b").alias("cls"))
              .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
              .select("a", "band", "cls", F.coalesce("root", "cls").alias("label")))
    near = saved(near_classes(groups, marks, bands))
    rest = saved(block_links(near, sets_of(near.select("cls")), bands))
    links = first.unionByName(rest)
    roots = components(links)
    own = F.when(F.col("_key") != F.lit(-(1 << 63)), F.col("_key"))
    placed = (base.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
              .withColumn("root", F.coalesce("root", "cls")))
    least = placed.where("n > 0").groupBy("root").agg(F.min(own).alias("least"))
    return (placed.join(least, "root", "left")
            .select(own.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("cls")).alias("class_id"),
                    F.when(F.col("n") > 0, F.col("least")).otherwise(own).alias("component_id")))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return (link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
            .select("doc_id", "n_shingles", "component_id", "class_id"))
