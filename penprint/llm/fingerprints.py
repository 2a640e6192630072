"""Document fingerprints: SimHash with permuted block tables.

Every term (a word, and a pair of neighbouring words) is hashed to ``BITS``
bits; each bit of the fingerprint is the sign of the terms' weighted votes.
``within_radius`` finds all fingerprints within a Hamming radius: the bits are
permuted by a fixed rule and cut into ``radius + 1`` blocks, of which two such
fingerprints share at least one, so an equi-join on (block, value) has every
candidate; the distance is then checked exactly.

Edge cases: a null text is the empty text; a text without a word has the
fingerprint of no votes (all bits 0); equal texts have equal fingerprints;
repeated rows each get a row.  With one row, the next document is the row
itself.  Null ids come after all others in descending order; rows that share an
id follow each other by a hash of their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from penprint.llm.arrays import U, ascii_lower, mix, word_hashes, words
from penprint.llm.frames import bucket_count, text_bytes

BITS = 256
_VOTES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)
_CHUNK = 2048


def votes(text: bytes) -> np.ndarray:
    """Signed votes of the terms of a text for each bit.  A word weighs its
    length (at most 12), a pair of neighbours the mean of its words."""
    buf = ascii_lower(np.frombuffer(text, np.uint8))
    starts, ends, _ = words(buf, np.array([0, len(buf)], np.int64))
    out = np.zeros(BITS, np.float64)
    if not len(starts):
        return out
    h = word_hashes(buf, starts, ends)
    weight = np.minimum(ends - starts, 12).astype(np.float32)
    h = np.concatenate([h, mix(h[:-1] * U(3) + h[1:], 1)])
    weight = np.concatenate([weight, (weight[:-1] + weight[1:]) / 2])
    for i in range(0, len(h), _CHUNK):
        part = h[i:i + _CHUNK]
        wide = np.stack([mix(part, 11 + k) for k in range(BITS // 64)], axis=1).view(np.uint8)
        out += weight[i:i + _CHUNK] @ _VOTES[wide].reshape(len(part), BITS)
    return out


def fingerprint(text: str) -> bytes:
    return np.packbits(votes(text.encode()) > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    return 1.0 - float(np.unpackbits(x).sum()) / (8 * len(a))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the
    following document."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n] if n else text


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _row(doc_id, text: str, following: str, own: bytes, next_print: bytes) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), other.hex(),
            likeness(own, other), likeness(own, next_print))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``_OUT``).

    One range shuffle by descending id puts each document beside the next one.
    The last row of a partition needs the first row of the following one: the
    first and last rows of all partitions (two for each partition) are matched
    in a window of their own."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
            bucket_count(spark, text_bytes(docs, text_col)) // 4)
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    dealt = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"),
                         text.alias("text"))
             .repartitionByRange(n, *order).sortWithinPartitions(*order))

    def inside(batches):
        last = None
        for b in batches:
            rows = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                own = fingerprint(t) if last is None or last[1] != t else last[2]
                if last is not None:
                    rows.append(_row(last[0], last[1], t, last[2], own))
                last = (doc_id, t, own)
            yield _batch(rows)

    def ends(batches):
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first if first is not None else b.slice(0, 1)
                last = b.slice(b.num_rows - 1, 1)
        for end, b in ((0, first), (1, last)):
            if b is not None:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([end], pa.int32())],
                                                 ["doc_id", "tie", "text", "end"])

    def across(batches):
        for b in batches:
            rows = []
            for doc_id, t, following in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows.append(_row(doc_id, t, following, fingerprint(t), fingerprint(following)))
            yield _batch(rows)

    by = Window.orderBy(*order, "end")
    edge = (dealt.mapInArrow(ends, "doc_id long, tie long, text string, end int")
            .withColumn("following", F.coalesce(
                F.lead("text").over(by),
                F.first("text").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
            .where("end = 1").select("doc_id", "text", "following"))
    return dealt.mapInArrow(inside, _OUT).unionByName(edge.mapInArrow(across, _OUT))


def within_radius(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(query, found, distance) for all pairs of fingerprints at most ``radius``
    bits apart.  Both inputs hold one distinct hexadecimal column
    ``fingerprint``; copies stay with their fingerprint, so a group of equal
    texts is one row here.  A radius of BITS or more matches everything and is
    refused."""
    if not 0 <= radius < BITS:
        raise ValueError(f"radius must lie in [0, {BITS})")
    blocks = radius + 1
    # fixed permutation of the bits (steps of 89, odd, so every bit comes once)
    bits = [(89 * i) % BITS for i in range(BITS)]
    cuts = [bits[k * BITS // blocks:(k + 1) * BITS // blocks] for k in range(blocks)]

    def keys(df, name):
        flat = F.concat_ws("", F.transform(
            F.split(F.col("fingerprint"), ""),
            lambda c: F.when(c == "", "").otherwise(F.lpad(F.conv(c, 16, 2), 4, "0"))))
        one = df.select(F.col("fingerprint").alias(name), flat.alias("_bits"))
        return one.select(name, F.posexplode(F.array(
            *[F.concat(*[F.substring("_bits", b + 1, 1) for b in cut]) for cut in cuts])).alias("_block", "_value"))

    def distance(a, b):
        parts = [F.bit_count(F.conv(F.substring(a, 1 + 8 * i, 8), 16, 10).cast("long")
                             .bitwiseXOR(F.conv(F.substring(b, 1 + 8 * i, 8), 16, 10).cast("long")))
                 for i in range(BITS // 32)]
        return sum(parts[1:], parts[0])

    return (keys(queries, "query").join(keys(prints, "found"), ["_block", "_value"])
            .select("query", "found").distinct()
            .withColumn("distance", distance(F.col("query"), F.col("found")).cast("int"))
            .where(F.col("distance") <= radius))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
