"""Substring dedup over word windows.

Every window of ``window`` consecutive words is hashed (Rabin-Karp by doubling).
Spark counts the hashes: each task combines its own windows first, the rest is
shuffled to ranges of the hash as compact blocks, where the smallest document of
every hash is found.  A window that also starts in a document with a smaller id
goes back to its document, and the marked windows merge into maximal intervals
of removed words.

A very common window is combined in each task before the shuffle, so its range
gets at most one entry for each task and smallest document.  Hashes have 64 bits;
two different windows of a corpus of n windows share one with a chance of about
n**2 / 2**65.

Edge cases: a null text is the empty text and has no words; a text with fewer
words than a window is kept whole; an empty table gives no rows; null ids sort
before all others.  Rows that share an id are one document for the comparison
of ids: a window is never removed because of a row with the same id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from penprint.llm.arrays import U, mix, rolling, slices, utf8, word_hashes, words
from penprint.llm.frames import keyed, text_bytes

WINDOW = 50
_UNIT = 12 << 20  # text bytes whose windows are combined at a time in a task


def window_hashes(buf, off, window: int):
    """Hash of every word window, its document's index, and (words per document,
    first word of each document, word starts, word ends)."""
    starts, ends, first = words(buf, off)
    h = rolling(word_hashes(buf, starts, ends), window)
    count = np.diff(first)
    inside = np.zeros(len(starts) + 1, np.int64)  # windows that do not cross a document's end
    long = count >= window
    np.add.at(inside, first[:-1][long], 1)
    np.add.at(inside, (first[1:] - window + 1)[long], -1)
    at = np.flatnonzero(np.cumsum(inside)[:len(h)] > 0)
    doc = np.searchsorted(first, at, "right") - 1
    return mix(h[at], 3), doc, at, first, starts, ends


def _range(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


# A block: sorted distinct keys, how many hashes each has, and the low 7 bytes of
# the hashes (the highest one follows from the range, up to its width).
def _write(keys: np.ndarray, h: np.ndarray) -> bytes:
    own, at = np.unique(keys, return_index=True)
    counts = np.diff(np.append(at, len(keys))).astype("<u4")
    return (np.uint32(len(own)).tobytes() + own.astype("<i8").tobytes() + counts.tobytes()
            + np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes())


def _read(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    keys = np.frombuffer(blob, "<i8", n, 4)
    counts = np.frombuffer(blob, "<u4", n, 4 + 8 * n)
    low = np.frombuffer(blob, np.uint8, offset=4 + 12 * n).reshape(-1, 7)
    h = np.zeros((len(low), 8), np.uint8)
    h[:, :7] = low
    return np.repeat(keys, counts), h.view("<u8").ravel()


_LOW = U((1 << 56) - 1)


def _blocks(to: np.ndarray, keys: np.ndarray, h: np.ndarray):
    """(target, block) for each target; entries ordered by key within a block."""
    order = np.lexsort((h, keys, to))
    to, keys, h = to[order], keys[order], h[order]
    cut = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(to)]):
        if b > a:
            yield int(to[a]), _write(keys[a:b], h[a:b])


def _later(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Entries whose hash also has a smaller key."""
    order = np.lexsort((keys, h))
    hs, ks = h[order], keys[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    least = ks[new][np.cumsum(new) - 1] if len(hs) else ks
    out = np.empty(len(hs), bool)
    out[order] = ks > least
    return out


def repeated_windows(docs: DataFrame, window: int, n_ranges: int, n_groups: int) -> DataFrame:
    """(grp, marks): for each group of documents, blocks of (key, window hash)
    that also start in a document with a smaller key."""

    def scatter(batches):
        held, size = [], 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            keys = np.concatenate([x[1] for x in held])
            held.clear()
            pair = np.lexsort((h, keys))  # one entry for a document and hash
            h, keys = h[pair], keys[pair]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (keys[1:] != keys[:-1])
            h, keys = h[keep], keys[keep]
            later = _later(h, keys)
            live = [(t, b, None) for t, b in _blocks(_range(h[~later], n_ranges), keys[~later], h[~later])]
            told = [(t, None, b) for t, b in _blocks(
                (mix(keys[later].astype(U), 5) % U(n_ranges)).astype(np.int64), keys[later], h[later])]
            rows = live + told
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary())], ["bucket", "live", "told"])

        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            buf, off = utf8(b.column(1))
            for i, j in slices(off):
                h, doc, *_ = window_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i], window)
                held.append((h, key[i:j][doc]))
                size += int(off[j] - off[i])
                if size >= _UNIT:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def settle(table):
        h, keys = [], []
        for blob in table.column("live").drop_null().to_pylist():
            k, x = _read(blob)
            keys.append(k), h.append(x)
        marked_k, marked_h = [], []
        if h:
            h, keys = np.concatenate(h), np.concatenate(keys)
            later = _later(h, keys)
            marked_k.append(keys[later]), marked_h.append(h[later])
        for blob in table.column("told").drop_null().to_pylist():
            k, x = _read(blob)
            marked_k.append(k), marked_h.append(x)
        k = np.concatenate(marked_k) if marked_k else np.empty(0, np.int64)
        x = np.concatenate(marked_h) if marked_h else np.empty(0, U)
        rows = list(_blocks(group_of(k, n_groups), k, x))
        return pa.table({"grp": pa.array([r[0] for r in rows], pa.int32()),
                         "marks": pa.array([r[1] for r in rows], pa.binary())})

    return (docs.select("_key", "_text").mapInArrow(scatter, "bucket int, live binary, told binary")
            .groupBy("bucket").applyInArrow(settle, "grp int, marks binary"))


def group_of(keys: np.ndarray, n_groups: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(U), 9) % U(n_groups)).astype(np.int64)


def with_group(docs: DataFrame, n_groups: int) -> DataFrame:
    """Adds grp, the group of the row's key, as ``group_of`` has it."""
    def put(batches):
        for b in batches:
            key = b.column(b.schema.get_field_index("_key")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(group_of(key, n_groups).astype(np.int32))], [*b.schema.names, "grp"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(put, kinds + ", grp int")


def intervals(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in a run of ``width`` from one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step)[:n] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row: ``spans`` are the
    maximal removed intervals of words, ``kept`` the text of the other words."""
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(2 * parts, int(total / 24e6) + 1)
    rows = keyed(docs, id_col, text_col).select("_id", "_key", "_text")
    marks = repeated_windows(rows, window, n, n)

    def finish(own, marked):
        by_key: dict[int, list] = {}
        for blob in marked.column("marks").to_pylist():
            k, h = _read(blob)
            cut = np.flatnonzero(np.diff(k)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(k)]):
                if b > a:
                    by_key.setdefault(int(k[a]), []).append(h[a:b])
        n_words, removed, kept, spans = [], [], [], []
        for key, text in zip(own.column("_key").to_pylist(), own.column("_text").to_pylist()):
            raw = text.encode()
            parts_ = raw.split()
            gone, cuts = 0, []
            if key in by_key:
                buf = np.frombuffer(raw, np.uint8)
                h, _, at, *_ = window_hashes(buf, np.array([0, len(buf)], np.int64), window)
                hit = at[np.isin(h & _LOW, np.concatenate(by_key[key]))]
                mask = cover(hit, window, len(parts_))
                a, b = intervals(mask)
                cuts = [{"first": int(x), "after": int(y)} for x, y in zip(a, b)]
                gone = int(mask.sum())
                parts_ = [w for w, m in zip(parts_, mask.tolist()) if not m]
            n_words.append(len(parts_) + gone), removed.append(gone), spans.append(cuts)
            kept.append(b" ".join(parts_).decode())
        return pa.table({"doc_id": own.column("_id"), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))),
                         "kept": pa.array(kept, pa.string())})

    return (with_group(rows, n).groupBy("grp").cogroup(marks.groupBy("grp"))
            .applyInArrow(finish, "doc_id long, n_words long, n_removed long, "
                                  "spans array<struct<first:long,after:long>>, kept string"))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"),
                      F.size("spans").alias("n_spans"))


OP3_SQL = """
WITH w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT md5(s) AS h, min(doc_id) AS m FROM win GROUP BY 1),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least ON md5(win.s) = least.h WHERE win.doc_id > least.m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
one AS (
  SELECT w.doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM w),
kept AS (
  SELECT one.doc_id, string_agg(one.word, ' ' ORDER BY one.p) AS s, count(*) AS k
  FROM one LEFT JOIN gone ON one.doc_id = gone.doc_id AND one.p = gone.p WHERE gone.p IS NULL GROUP BY 1),
runs AS (
  SELECT doc_id, count(*) AS n FROM
    (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone)
  WHERE q IS NULL OR q < p - 1 GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256, CAST(coalesce(runs.n, 0) AS INTEGER) AS n_spans
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN runs ON w.doc_id = runs.doc_id
"""
