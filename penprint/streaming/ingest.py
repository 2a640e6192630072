"""Incremental ingest of newly arriving submission files (Structured Streaming).

The reference has no event-time processing; what grows over time is the
corpus itself.  This job watches a submission tree with the ``binaryFile``
streaming source, applies the same extension / size filters and decoding as
the batch ingest, and appends each micro-batch to a Parquet table.  Writes
are idempotent per epoch (one folder per ``epoch_id``, overwritten on
retry), and progress lives in a checkpoint folder on shared storage, so a
restarted job neither loses nor duplicates files.  The last-wins choice
between solutions (J3) is a batch step over the ingested table
(``operators.dedup.keep_last``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.functions.text import file_extension
from penprint.sources.files import decode_bytes, extension_glob, relative_path


def submissions_stream(spark: SparkSession, root: str, extensions, min_size: int = 100,
                       max_files_per_trigger: int = 10000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    src = (spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
           .option("pathGlobFilter", extension_glob(extensions))
           .option("maxFilesPerTrigger", max_files_per_trigger).load(root))
    rel = relative_path(F.col("path"), root)
    parts = F.split(rel, "/")
    df = src.where(F.col("length") > min_size).select(
        rel.alias("filepath"), parts[0].alias("contest"), parts[1].alias("username"),
        parts[2].alias("problem"), parts[3].alias("solution"), "modificationTime",
        decode_bytes(F.col("content")).alias("file_content"))
    return df.where(file_extension(F.col("filepath")).isin(list(extensions)) & F.col("file_content").isNotNull())


def run_ingest(spark: SparkSession, root: str, out: str, checkpoint: str, extensions,
               min_size: int = 100, available_now: bool = True):
    """Start (and with ``available_now`` run to completion) the ingest query."""
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")

    w = (submissions_stream(spark, root, extensions, min_size).writeStream
         .foreachBatch(write_batch).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
