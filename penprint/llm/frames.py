"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, functions as F

from penprint.session import cut_lineage

#: Order key of a null id: before every other id.
NULL_KEY = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, _fp, _text) of every row.  _key orders ids with null first;
    _fp tells rows apart that share an id, so rows equal in id and text count
    as one document that is returned as often as it came.  No other column is
    carried, so clashing names of extra columns do no harm."""
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("_key"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_fp"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: the measure from which bucket counts are derived."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def bucket_count(spark, total_bytes: float, per_bucket: float = 16e6) -> int:
    """Buckets of at most about ``per_bucket`` bytes, several for each shuffle
    partition so that hashing them onto partitions stays even."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * parts, int(total_bytes / per_bucket) + 1)


def parts_for(rows: int, per_part: int = 200_000) -> int:
    """Partitions (files) for a table of about so many short rows."""
    return max(4, -(-rows // per_part))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark, most: int = 4 << 20) -> None:
    """Rows go to Python in Arrow batches of at most about ``most`` bytes, unless the
    session has a bound of its own.  By default a batch of texts takes 64 MB, and
    while it grows twice that, outside the heap, for each task."""
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, most)


def saved(df: DataFrame) -> DataFrame:
    """Checkpointed to the shared folder: cuts lineage.  Nothing refers to the
    finished step afterwards, so its shuffle files go as soon as the driver
    collects its garbage; that is asked for here, because a driver with a quiet
    heap may not do so before the job ends.  Later collections find what the
    cleanup after an earlier one let go."""
    spark, out = df.sparkSession, cut_lineage(df)
    del df
    gc.collect()
    for _ in range(4):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return out
