"""Access to the input tables (one Parquet file/folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(author, file_id) view of ``orders``: customer = author, order = file."""
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS author", "o_orderkey AS file_id")


def files_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, author, embedding) view of ``embeddings``: label = author."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS file_id", "label AS author", "embedding")


def files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, author, text) view of ``documents``: source = author."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS file_id", "source AS author", "text", "lang")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition before CPU-heavy per-row work when the scan
    yields fewer partitions than the cluster can run at once (e.g. a table
    stored as one row group).  Large multi-file inputs already have enough
    splits and are left alone, so no shuffle is added at scale."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def fan_out_ready(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread a small key table (e.g. authors) over the cluster before an
    ``explode`` multiplies its rows.  An explicit partition count is kept by
    AQE, unlike a small aggregate's output, which AQE coalesces into one task."""
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
