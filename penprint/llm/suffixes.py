"""Exact removal of repeated byte strings by a sparse, distributed suffix array.

A 100-byte string occurs twice only if its *anchor* does: the leftmost smallest
``CORE``-byte hash among those inside it, a choice that depends on nothing but
the string's own bytes.  Neighbouring windows that share an anchor form a
*cell*, so about one position in 30 needs a suffix.

1. The suffixes at all anchors are keyed by leading tokens: the core they start
   with, then the fingerprint of their whole cell.  A sample of them gives
   splitters; (tokens, place) is range-partitioned by these, each bucket is
   sorted by multikey quicksort, and neighbours are compared.  A cell that
   equals an earlier one is removed, and a core that has a single cell, all of
   it inside one bucket, is settled.
2. What is left are the rims of copied passages, and runs that touch a bucket's
   boundary.  The suffixes at *every* position of those cells (token: the
   window) are sorted the same way; the first run of a bucket is compared
   across the boundary with the last one of the bucket before.

Each task first combines equal cells (windows) of its own, and splitters are
whole records, so a run of equal tokens can be divided between buckets by place:
neither a hot core nor thousands of copies meet in one task.

Edge cases: a null text is empty; texts shorter than the width keep all bytes;
an empty table gives no rows; null ids sort before all others.  Rows that share
an id are one document to the order: of two equal strings at the same start
neither is earlier; a removal found in one of them is applied to another only
where its bytes are the same (checked by fingerprint).
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from penprint.llm.arrays import BYTE_CODES, U, mix, rolling, slices, sliding_min, utf8
from penprint.llm.frames import NULL_KEY, bounded_batches, keyed, saved, text_bytes

WIDTH = 100
CORE = 40
_UNIT = 12 << 20
_PIECE = 4 << 20
_SLICE = 1 << 18  # text bytes hashed at a time: ten arrays of 8 bytes for each
_SAMPLE_BYTES = 16 << 20
_PER_BUCKET = 64


def cell_token(h: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprint of the windows p .. p+n: of their first and last one, which
    cover the whole stretch, and of their number."""
    return mix(mix(h[p], 1) ^ (h[p + n] * U(0xD6E8FEB86659FD93)) + n.astype(U), 2)


def cells(buf: np.ndarray, off: np.ndarray, width: int, core: int):
    """(p, n, t0, t1) of each cell: first window, windows after it, the core's
    token and the cell's token.  Places count from the start of ``buf``."""
    codes = BYTE_CODES[buf]
    h = rolling(codes, width)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
    hk = rolling(codes, core)
    rank = (mix(hk, 3) & U(0xFFFFFFFF00000000)) | np.arange(len(hk), dtype=U)
    anchor = sliding_min(rank, width - core + 1)[:len(h)] & U(0xFFFFFFFF)
    del rank, codes
    valid = np.ones(len(h), bool)  # windows that do not cross a document's end
    for e in off[1:-1].tolist():
        valid[max(0, e - width + 1):min(e, len(h))] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    p, q = np.flatnonzero(new), np.flatnonzero(last)
    return p, q - p, mix(hk[anchor[p].astype(np.int64)], 4), cell_token(h, p, q - p)


def _cells_of(buf, off, width, core):
    """Cells of a slice of documents, long documents piece by piece:
    (document index, place in the document, n, t0, t1)."""
    for i, j in slices(off, _SLICE):
        if j == i + 1 and off[j] - off[i] > _PIECE:
            whole = buf[off[i]:off[j]]
            for s in range(0, len(whole) - width + 1, _PIECE):
                part = whole[s:s + _PIECE + width - 1]
                p, n, t0, t1 = cells(part, np.array([0, len(part)]), width, core)
                yield np.full(len(p), i), p + s, n, t0, t1
        else:
            own = off[i:j + 1] - off[i]
            p, n, t0, t1 = cells(buf[off[i]:off[j]], own, width, core)
            doc = np.searchsorted(own, p, "right") - 1
            yield doc + i, p - own[doc], n, t0, t1


def window_tokens(raw: bytes, p: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """``cell_token`` of cells of one text, reading it piece by piece."""
    buf = np.frombuffer(raw, np.uint8)
    out = np.zeros(len(p), U)
    for s in range(0, max(len(buf) - width + 1, 0), _PIECE):
        part = buf[s:s + _PIECE + 4 * width]
        here = (p >= s) & (p < s + _PIECE) & (p + n + width <= len(buf))
        if here.any():
            out[here] = cell_token(rolling(BYTE_CODES[part], width), p[here] - s, n[here])
    return out


# --- blocks: columns one after the other -------------------------------------------------
_CELL = ("<u8", "<u8", "<i8", "<u4", "u1")     # t0, t1, key, p, n
_MARK = ("<i8", "<u4", "u1", "<u4")            # key, p, n, low half of the cell's token


def _dump(cols, kinds) -> bytes:
    return b"".join(np.ascontiguousarray(c).astype(k).tobytes() for c, k in zip(cols, kinds))


def _load(blobs, kinds) -> list[np.ndarray]:
    size = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list] = [[] for _ in kinds]
    for b in blobs:
        n, at = len(b) // size, 0
        for got, k in zip(out, kinds):
            got.append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) if x else np.empty(0, k) for x, k in zip(out, kinds)]


def _parts(to: np.ndarray, cols, kinds):
    """(target, block) for each target."""
    order = np.argsort(to, kind="stable")
    to, cols = to[order], [c[order] for c in cols]
    cut = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(to)]):
        if b > a:
            yield int(to[a]), _dump([c[a:b] for c in cols], kinds)


def group_of(keys: np.ndarray, n: int) -> np.ndarray:
    """crc32 of the key as text, modulo: the same as ``group_column``."""
    own, back = np.unique(keys, return_inverse=True)
    return np.array([zlib.crc32(str(k).encode()) % n for k in own.tolist()], np.int64)[back]


def group_column(n: int):
    return (F.crc32(F.col("_key").cast("string").cast("binary")) % n).cast("int")


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: order by the first column; runs of equal entries, and
    only these, are ordered by the next one, and so on."""
    order = np.argsort(columns[0], kind="quicksort")
    run = np.zeros(len(order), np.int64)
    same = None
    for c in columns[1:]:
        before = columns[0][order] if same is None else same
        new = np.ones(len(order), bool)
        new[1:] = before[1:] != before[:-1]
        if same is not None:
            new[1:] |= run[1:] != run[:-1]
        run = np.cumsum(new)
        tied = np.zeros(len(order), bool)
        tied[:-1] |= ~new[1:]
        tied[1:] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        inner = np.lexsort((c[order[at]], run[at]))
        order[at] = order[at][inner]
        same = c[order]
    return order


def _starts(*columns) -> np.ndarray:
    """Where a run of equal entries begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _not_first(new: np.ndarray, key: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Entries of sorted runs whose place is later than the run's first one."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (key > key[first]) | (p > p[first])


def bucket_of(splitters: list[tuple], heads: np.ndarray, *columns) -> np.ndarray:
    """How many splitters are not above each record.  Only records whose first
    token equals a splitter's are compared further."""
    low = np.searchsorted(heads, columns[0], "left")
    out = np.searchsorted(heads, columns[0], "right")
    for i in np.flatnonzero(low < out).tolist():
        out[i] = bisect.bisect_right(splitters, tuple(int(c[i]) for c in columns), int(low[i]), int(out[i]))
    return out


def _pick(records: list[tuple], n: int) -> list[tuple]:
    records = sorted(set(records))
    return sorted({records[len(records) * i // n] for i in range(1, n)}) if records else []


def sample_splitters(rows: DataFrame, total: int, n: int, width: int, core: int):
    """(splitters of cells, splitters of windows) from a sample of about 16 MB of
    text; the driver gets at most 64 records for each bucket."""
    share = min(1.0, _SAMPLE_BYTES / max(total, 1))
    thin = max(1, int(min(total, _SAMPLE_BYTES) / 30 / (_PER_BUCKET * n)))

    def run(batches):
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            buf, off = utf8(b.column(1))
            for doc, p, m, t0, t1 in _cells_of(buf, off, width, core):
                at = np.flatnonzero(mix(t1 + p.astype(U), 8) % U(thin) == 0)
                w = np.zeros(len(at), U)
                for d in np.unique(doc[at]).tolist():
                    mine = doc[at] == d
                    w[mine] = window_tokens(buf[off[d]:off[d + 1]].tobytes(), p[at][mine],
                                            np.zeros(int(mine.sum()), np.int64), width)
                cols = [t0[at].view(np.int64), t1[at].view(np.int64), key[doc[at]], p[at], w.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["t0", "t1", "key", "p", "w"])

    got = (rows.select("_key", "_text").sample(share, 7)
           .mapInArrow(run, "t0 long, t1 long, key long, p long, w long").collect())
    big = (1 << 64) - 1
    return (_pick([(r.t0 & big, r.t1 & big, r.key, r.p) for r in got], n),
            _pick([(r.w & big, r.key, r.p) for r in got], n))


_ROW = "grp int, kind int, block binary"


def _rows(*parts):
    rows = [(t, kind, b) for kind, got in parts for t, b in got]
    return pa.table({"grp": pa.array([r[0] for r in rows], pa.int32()),
                     "kind": pa.array([r[1] for r in rows], pa.int32()),
                     "block": pa.array([r[2] for r in rows], pa.binary())})


MARKS, OPEN, FIRST, LAST = 0, 1, 2, 3


def settle_cells(rows: DataFrame, splitters, n_groups: int, width: int, core: int) -> DataFrame:
    """Stage 1: (grp, kind, block) with cells to remove (MARKS) and cells that
    stage 2 compares window by window (OPEN)."""
    n = len(splitters) + 1
    shared = rows.sparkSession.sparkContext.broadcast(  # bounded by the number of buckets
        (splitters, np.array([s[0] for s in splitters], U)))

    def scatter(batches):
        held, size = [], 0

        def flush():
            t0, t1, key, p, m = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = multikey_order([t0, t1, key, p])
            t0, t1, key, p, m = t0[order], t1[order], key[order], p[order], m[order]
            late = _not_first(_starts(t0, t1), key, p)
            live = [c[~late] for c in (t0, t1, key, p, m)]
            # place order again: ids that repeat compress well
            live = [c[np.lexsort((live[3], live[2]))] for c in live]
            told = [key[late], p[late], m[late], t1[late] & U(0xFFFFFFFF)]
            yield _rows((OPEN, _parts(bucket_of(*shared.value, *live[:4]), live, _CELL)),
                        (MARKS, _parts(group_of(told[0], n), told, _MARK)))

        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            buf, off = utf8(b.column(1))
            for doc, p, m, t0, t1 in _cells_of(buf, off, width, core):
                held.append((t0, t1, key[doc], p, m))
                size += int(m.sum())
                if size >= _UNIT:
                    yield from (t.to_batches()[0] for t in flush() if t.num_rows)
                    size = 0
        if held:
            yield from (t.to_batches()[0] for t in flush() if t.num_rows)

    def settle(table):
        kind = np.array(table.column("kind").to_pylist())
        blobs = table.column("block").to_pylist()
        t0, t1, key, p, m = _load([b for b, k in zip(blobs, kind) if k == OPEN], _CELL)
        told = _load([b for b, k in zip(blobs, kind) if k == MARKS], _MARK)
        order = multikey_order([t0, t1, key, p])
        t0, t1, key, p, m = t0[order], t1[order], key[order], p[order], m[order]
        new = _starts(t0, t1)
        late = _not_first(new, key, p)
        run = np.cumsum(_starts(t0)) - 1
        several = np.bincount(run, weights=new, minlength=1) > 1 if len(run) else np.zeros(1, bool)
        several[0] = several[-1] = True  # may go on in a neighbouring bucket
        low = t1 & U(0xFFFFFFFF)
        todo = ~late & several[run] if len(run) else late
        marks = [np.concatenate([a, b]) for a, b in zip(told, (key[late], p[late], m[late], low[late]))]
        left = [key[todo], p[todo], m[todo], low[todo]]
        return _rows((MARKS, _parts(group_of(marks[0], n_groups), marks, _MARK)),
                     (OPEN, _parts(group_of(left[0], n_groups), left, _MARK)))

    return (rows.select("_key", "_text").mapInArrow(scatter, _ROW)
            .groupBy("grp").applyInArrow(settle, _ROW))


def _by_key(blobs):
    key, *rest = _load(blobs, _MARK)
    order = np.argsort(key, kind="stable")
    key, rest = key[order], [c[order] for c in rest]
    cut = np.flatnonzero(_starts(key)) if len(key) else np.empty(0, int)
    return {int(key[a]): [c[a:b] for c in rest] for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)])}


def settle_windows(rows: DataFrame, level1: DataFrame, splitters, n_groups: int, width: int) -> DataFrame:
    """Stage 2: MARKS for single windows of open cells; FIRST and LAST hold the
    first record and the last token of each bucket."""
    n = len(splitters) + 1
    shared = rows.sparkSession.sparkContext.broadcast((splitters, np.array([s[0] for s in splitters], U)))
    kinds = ("<u8", "<i8", "<u4")

    def scatter(own, todo):
        wanted = _by_key(todo.column("block").to_pylist())
        cols: list[tuple] = []
        for key, text in zip(own.column("_key").to_pylist(), own.column("_text").to_pylist()):
            if key not in wanted:
                continue
            raw = text.encode()
            p, m, low = wanted[key]
            p, m = p.astype(np.int64), m.astype(np.int64)
            true = (window_tokens(raw, p, m, width) & U(0xFFFFFFFF)) == low
            p, m = p[true], m[true]
            at = np.unique(np.repeat(p - np.concatenate([[0], np.cumsum(m + 1)[:-1]]), m + 1)
                           + np.arange(int((m + 1).sum()))) if len(p) else p
            w = window_tokens(raw, at, np.zeros(len(at), np.int64), width)
            cols.append((w, np.full(len(at), key, np.int64), at))
        if not cols:
            return _rows()
        w, key, p = (np.concatenate(c) for c in zip(*cols))
        order = multikey_order([w, key, p])
        w, key, p = w[order], key[order], p[order]
        late = _not_first(_starts(w), key, p)
        told = [key[late], p[late], np.zeros(int(late.sum())), w[late] & U(0xFFFFFFFF)]
        live = [c[~late] for c in (w, key, p)]
        return _rows((OPEN, _parts(bucket_of(*shared.value, *live), live, kinds)),
                     (MARKS, _parts(group_of(told[0], n), told, _MARK)))

    def settle(bucket, table):
        kind = table.column("kind").to_pylist()
        blobs = table.column("block").to_pylist()
        w, key, p = _load([b for b, k in zip(blobs, kind) if k == OPEN], kinds)
        told = _load([b for b, k in zip(blobs, kind) if k == MARKS], _MARK)
        order = multikey_order([w, key, p])
        w, key, p = w[order], key[order], p[order]
        late = _not_first(_starts(w), key, p)
        marks = [np.concatenate([a, b]) for a, b in zip(
            told, (key[late], p[late], np.zeros(int(late.sum()), np.uint8), w[late] & U(0xFFFFFFFF)))]
        ends = []
        if len(w):
            b = bucket[0].as_py()
            ends = [(b, np.uint64(w[0]).tobytes() + _dump([key[:1], p[:1], np.zeros(1), w[:1] & U(0xFFFFFFFF)], _MARK)),
                    (b, np.uint64(w[-1]).tobytes())]
        return _rows((MARKS, _parts(group_of(marks[0], n_groups), marks, _MARK)),
                     (FIRST, ends[:1]), (LAST, ends[1:]))

    docs = rows.select("_key", "_text", group_column(n_groups).alias("grp"))
    return (docs.groupBy("grp").cogroup(level1.where(F.col("kind") == OPEN).groupBy("grp"))
            .applyInArrow(scatter, _ROW).groupBy("grp").applyInArrow(settle, _ROW))


def across_boundaries(level2: DataFrame, n_groups: int) -> DataFrame:
    """MARKS for the first record of each bucket whose window is also the last
    one of the bucket before (two small rows for each bucket are compared)."""
    ends = level2.where(F.col("kind") != MARKS)
    by = Window.orderBy("grp")
    one = (ends.groupBy("grp").agg(F.max(F.when(F.col("kind") == FIRST, F.col("block"))).alias("first"),
                                   F.max(F.when(F.col("kind") == LAST, F.col("block"))).alias("last"))
           .withColumn("before", F.lag("last").over(by))
           .where(F.expr("before = substring(first, 1, 8)")).select(F.expr("substring(first, 9)").alias("block")))

    def put(batches):
        for b in batches:
            blobs = b.column(0).to_pylist()
            if blobs:
                cols = _load(blobs, _MARK)
                yield _rows((MARKS, _parts(group_of(cols[0], n_groups), cols, _MARK))).to_batches()[0]

    return one.mapInArrow(put, _ROW)


def removed_mask(raw: bytes, marks, width: int) -> np.ndarray:
    """Bytes covered by the marked windows of a text; marks whose fingerprint is
    another one's are passed over."""
    p, n, low = marks[0].astype(np.int64), marks[1].astype(np.int64), marks[2]
    true = (window_tokens(raw, p, n, width) & U(0xFFFFFFFF)) == low
    step = np.zeros(len(raw) + 1, np.int32)
    np.add.at(step, p[true], 1)
    np.add.at(step, p[true] + n[true] + width, -1)
    return np.cumsum(step[:-1]) > 0


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repeated_marks(docs: DataFrame, id_col: str, text_col: str, width: int, core: int | None):
    """(grp, block) of all repeated windows, and the number of groups."""
    spark = docs.sparkSession
    core = core or max(1, width * CORE // WIDTH)
    if not 1 <= core <= width <= 250:
        raise ValueError("width must lie in [1, 250] and core in [1, width]")
    bounded_batches(spark)
    total = text_bytes(docs, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, int(total / 24e6) + 1)
    rows = keyed(docs, id_col, text_col).select("_key", "_text")
    cell_splits, window_splits = sample_splitters(rows, total, n, width, core)
    level1 = saved(settle_cells(rows, cell_splits, n, width, core))
    level2 = saved(settle_windows(rows, level1, window_splits, n, width))
    marks = (level1.unionByName(level2).where(F.col("kind") == MARKS)
             .unionByName(across_boundaries(level2, n)).select("grp", "block"))
    return marks, n


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   core: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: maximal removed byte spans
    [first, after) of the UTF-8 text, and its other bytes."""
    marks, n = repeated_marks(docs, id_col, text_col, width, core)

    def finish(own, marked):
        wanted = _by_key(marked.column("block").to_pylist())
        sizes, spans, kept = [], [], []
        for key, text in zip(own.column("_key").to_pylist(), own.column("_text").to_pylist()):
            raw = text.encode()
            sizes.append(len(raw))
            if key in wanted:
                mask = removed_mask(raw, wanted[key], width)
                spans.append([{"first": a, "after": b} for a, b in spans_of(mask)])
                raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            else:
                spans.append([])
            kept.append(raw)
        return pa.table({"doc_id": own.column("_id"), "n_bytes": pa.array(sizes, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))),
                         "kept": pa.array(kept, pa.binary())})

    grouped = keyed(docs, id_col, text_col).select("_id", "_key", "_text", group_column(n).alias("grp"))
    return (grouped.groupBy("grp").cogroup(marks.groupBy("grp"))
            .applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<first:long,after:long>>, kept binary"))


def whole_characters(raw: bytes, mask: np.ndarray) -> np.ndarray:
    """A character goes only if all its bytes do."""
    buf = np.frombuffer(raw, np.uint8)
    starts = np.flatnonzero((buf & 0xC0) != 0x80)
    gone = np.logical_and.reduceat(mask, starts)
    return np.repeat(gone, np.diff(np.append(starts, len(buf))))


def rewrite(docs: DataFrame, id_col: str, columns: list[str], text_col: str = "text",
            width: int = WIDTH) -> DataFrame:
    """``columns`` of every row with the repeated strings taken out of the text
    (at whole characters); ``n_chars``, if among them, is counted anew.  A row
    that loses all its text goes; an empty or null text stays as it is."""
    marks, n = repeated_marks(docs, id_col, text_col, width, None)
    out = docs.select(*columns).schema
    own_rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("_key"), F.struct(*columns).alias("_row"))
    at = columns.index(text_col)

    def finish(own, marked):
        wanted = _by_key(marked.column("block").to_pylist())
        fields = own.column("_row").combine_chunks().flatten()
        texts, keep = fields[at].to_pylist(), []
        for i, (key, text) in enumerate(zip(own.column("_key").to_pylist(), texts)):
            if text and key in wanted:
                raw = text.encode()
                mask = whole_characters(raw, removed_mask(raw, wanted[key], width))
                texts[i] = np.frombuffer(raw, np.uint8)[~mask].tobytes().decode()
            keep.append(not text or bool(texts[i]))
        fields[at] = pa.array(texts, fields[at].type)
        if "n_chars" in columns:
            k = columns.index("n_chars")
            fields[k] = pa.array([None if t is None else len(t) for t in texts], fields[k].type)
        return pa.Table.from_arrays(fields, names=list(columns)).filter(pa.array(keep, pa.bool_()))

    return (own_rows.withColumn("grp", group_column(n)).groupBy("grp").cogroup(marks.groupBy("grp"))
            .applyInArrow(finish, out))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def brute_force(texts: dict, width: int = WIDTH) -> dict:
    """{id: removed byte spans}, the definition itself; for small fixtures."""
    seen, out = set(), {}
    for doc_id in sorted(texts):
        raw = (texts[doc_id] or "").encode()
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            w = raw[i:i + width]
            if w in seen:
                mask[i:i + width] = True
            seen.add(w)
        out[doc_id] = spans_of(mask)
    return out
