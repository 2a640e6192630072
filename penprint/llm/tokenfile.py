"""Token files: the ids of all documents in ascending order of their id.

The documents are range-partitioned by id; each partition becomes a file of
*segments*.  A segment holds whole documents, about ``SEGMENT`` ids: a directory
(document ids and lengths, with a checksum) and the coded blocks of
``coder.py``, each of them reset and checksummed on its own.  Segments are rows
of a Parquet table, so they are written and read wherever Spark can write and
read; ``part`` and ``before`` (ids before the segment in its part) give the
order.  Reading decodes segments independently; a part's first place follows
from the totals of the parts before it.

Edge cases: a null or empty text holds only the end id; null ids sort before
all others and stay null; repeated rows are written one by one; rows that share
an id follow each other by a hash of their text; an empty table makes files
without segments.  Ids must lie below 65,536.  A damaged directory or block
raises ValueError.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from penprint.llm import coder
from penprint.llm.frames import text_bytes
from penprint.llm.tokens import default_path, encoder
from penprint.session import ensure_checkpoint_dir

SEGMENT = 1024 * coder.BLOCK
END_ID = 0
ROW = "part int, before long, n_ids long, n_docs long, directory binary, sizes binary, blocks binary"


def pack_segment(ids: list, lengths: list[int], tokens: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(directory, block sizes, blocks)."""
    null = np.array([i is None for i in ids], bool)
    body = (np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes()
            + np.packbits(null).tobytes())
    blocks = coder.encode(tokens)
    return (np.array([zlib.crc32(body)], "<u4").tobytes() + body,
            np.array([len(b) for b in blocks], "<u4").tobytes(), b"".join(blocks))


def unpack_segment(n_docs: int, n_ids: int, directory: bytes, sizes: bytes, blocks: bytes):
    """(document ids, lengths, token ids)."""
    body = directory[4:]
    if np.array([zlib.crc32(body)], "<u4").tobytes() != directory[:4]:
        raise ValueError("directory: checksum does not match")
    ids = np.frombuffer(body, "<i8", n_docs)
    lengths = np.frombuffer(body, "<u4", n_docs, 8 * n_docs).astype(np.int64)
    null = np.unpackbits(np.frombuffer(body, np.uint8, offset=12 * n_docs), count=n_docs).astype(bool)
    cut = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))]).tolist()
    tokens = coder.decode([blocks[a:z] for a, z in zip(cut, cut[1:])], n_ids)
    return [None if x else int(i) for i, x in zip(ids, null)], lengths, tokens


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write the files under ``path``."""
    tok = tokenizer or default_path()
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(text_bytes(docs, text_col) / 24e6) + 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    dealt = (docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
             .repartitionByRange(n, *order).sortWithinPartitions(*order))

    def run(batches):
        encode, part, before = encoder(tok), TaskContext.get().partitionId(), 0
        ids, lengths, tokens, size = [], [], [], 0

        def flush():
            nonlocal before, size
            made = pack_segment(ids, lengths, np.concatenate(tokens))
            row = (part, before, size, len(ids), *made)
            before, size = before + size, 0
            ids.clear(), lengths.clear(), tokens.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)],
                                              [c.split()[0] for c in ROW.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                own, texts = (c.to_pylist() for c in b.slice(at, 256).columns[:2])
                for i, x in zip(own, encode(texts)):
                    x = np.append(x, np.uint32(end_id))
                    if size and size + len(x) > SEGMENT:
                        yield flush()
                    ids.append(i), lengths.append(len(x)), tokens.append(x)
                    size += len(x)
        if ids:
            yield flush()

    dealt.mapInArrow(run, ROW).write.parquet(path)


_OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files;
    ``with_ids`` adds the ids as little-endian unsigned 32-bit ``ids``."""
    files = spark.read.schema(ROW).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    by = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    first = totals.select("part", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("first"))
    schema = _OUT + (", ids binary" if with_ids else "")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, lengths, tokens = unpack_segment(r["n_docs"], r["n_ids"], r["directory"], r["sizes"], r["blocks"])
                ends = np.cumsum(lengths)
                begins = (ends - lengths).tolist()
                own = [tokens[a:z].tobytes() for a, z in zip(begins, ends.tolist())]
                cols = [pa.array(ids, pa.int64()), pa.array([r["first"] + r["before"] + a for a in begins], pa.int64()),
                        pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(own, pa.binary())] if with_ids else []),
                                                 [c.split()[0] for c in schema.split(", ")])

    return files.join(F.broadcast(first), "part").mapInArrow(run, schema)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path)
