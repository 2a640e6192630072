"""Sinks (S11, S12, S13, S16): partitioned Parquet/text writes and readers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.operators.histogram import Histogram


def write_split_tables(df: DataFrame, out: str, split_col: str = "split") -> None:
    """One folder per split (``split=train/val/test``), overwritten."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(out)


def read_split(spark: SparkSession, out: str, split: str) -> DataFrame:
    """Partition pruning: only the requested split's files are listed/read."""
    return spark.read.parquet(out).where(F.col("split") == split)


def write_pairs(pairs: DataFrame, out: str) -> None:
    """Pair sets partitioned by split."""
    pairs.write.mode("overwrite").partitionBy("split").parquet(out)


def read_pairs(spark: SparkSession, out: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(out)
    return df.where(F.col("split") == split) if split else df


def write_corpus_text(lines: DataFrame, out: str, col: str = "line") -> None:
    """One text line per row (vocabulary-training corpus)."""
    lines.select(F.regexp_replace(F.col(col), "\n$", "").alias("value")).write.mode("overwrite").text(out)


def save_distribution(h: Histogram, out: str, kind: str) -> None:
    """The bin table plus its edge parameters (Parquet + JSON side file)."""
    h.bins.withColumn("kind", F.lit(kind)).write.mode("overwrite").parquet(f"{out}/{kind}")
    spark = h.bins.sparkSession
    meta = json.dumps({"first_edge": h.first_edge, "last_edge": h.last_edge, "n_bins": h.n_bins, "n": h.n})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{kind}.meta")


def load_distribution(spark: SparkSession, out: str, kind: str) -> Histogram:
    meta = json.loads(spark.read.text(f"{out}/{kind}.meta").first()[0])
    bins = spark.read.parquet(f"{out}/{kind}").drop("kind")
    return Histogram(meta["first_edge"], meta["last_edge"], meta["n_bins"], meta["n"], bins)
