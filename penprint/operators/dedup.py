"""Duplicate handling (S5, J2, J3, A11, U3, K5) and the ingest audit.

All per-key choices are aggregates (``min``, ``max_by``) with map-side partial
aggregation — never a window over a key — so one duplicate cluster holding a
third of the corpus is combined per map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.operators.ranking import sorted_index


def content_clusters(df: DataFrame, id_col: str = "file_id", text: str = "text") -> DataFrame:
    """Exact-duplicate clusters: (cluster = md5(text), id, is_first) where the
    first member (kept entry) is the smallest id."""
    c = df.select(F.md5(F.col(text)).alias("cluster"), F.col(id_col))
    first = c.groupBy("cluster").agg(F.min(id_col).alias("_first"))
    return c.join(first, "cluster").withColumn("is_first", F.col(id_col) == F.col("_first")).drop("_first")


def duplicates_from_clusters(clusters: DataFrame, id_col: str = "file_id") -> DataFrame:
    """The non-first members of every cluster."""
    return clusters.where(~F.col("is_first")).select(id_col).distinct()


def cluster_members(blocks: DataFrame, language: str, cluster: str = "cluster", block: str = "block") -> DataFrame:
    """Members of clusters given as text blocks, one ``path:...`` a line; the
    submission id is extracted by ``.*/{language}/(.*)\\..*:.*``, and every member
    but the first (``pos`` > 0) is a duplicate.  Output (cluster, pos, path,
    submission_id)."""
    lines = blocks.select(cluster, F.posexplode(F.split(F.trim(F.col(block)), "\n")).alias("pos", "path"))
    lines = lines.where(F.length("path") > 0)
    return lines.withColumn("submission_id",
                            F.regexp_extract("path", f".*/{language}/(.*)\\..*:.*", 1))


def read_duplicate_cluster_text(spark, path: str, language: str) -> DataFrame:
    """S5 (file form): clusters parted by blank lines.  The blank line is the
    record separator, so a large file is many rows in many tasks; ``cluster``
    orders the blocks by their place in the file's splits."""
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    blocks = blocks.where(F.length(F.trim("value")) > 0).select(
        F.monotonically_increasing_id().alias("cluster"), F.trim(F.col("value"), F.lit("\n")).alias("block"))
    return cluster_members(blocks, language)


def drop_duplicates_by_cluster(df: DataFrame, duplicates: DataFrame, id_col: str = "file_id",
                               keep_repeats: bool = False) -> DataFrame:
    """Anti-join on the duplicate ids (unless ``keep_repeats``)."""
    return df if keep_repeats else df.join(duplicates, id_col, "left_anti")


def union_duplicates(*dups: DataFrame) -> DataFrame:
    """Duplicate ids over several languages."""
    out = dups[0]
    for d in dups[1:]:
        out = out.unionByName(d)
    return out.distinct()


def keep_last(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Per key the row with the largest ``order_cols`` (lexicographically
    last wins), as a ``max_by`` aggregate: partial per map task, no window."""
    rest = [c for c in df.columns if c not in key_cols]
    agg = df.groupBy(*key_cols).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order_cols])).alias("_r"))
    return agg.select(*key_cols, *[F.col(f"_r.{c}").alias(c) for c in rest])


def cross_author_duplicates(df: DataFrame, id_col: str = "file_id", author: str = "author",
                            text: str = "text") -> DataFrame:
    """Clusters whose copies belong to more than one author, with their
    number of copies and authors and the text's length.  The members of a
    cluster are rows (``cluster_rows``), never one array."""
    c = df.select(F.md5(F.col(text)).alias("cluster"), F.col(author), F.length(text).alias("length"))
    g = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("copies"),
                                 F.countDistinct(author).alias("authors"),
                                 F.max("length").alias("length"))
    return g.where(F.col("authors") > 1)


def cluster_rows(df: DataFrame, clusters: DataFrame, id_col: str = "file_id", author: str = "author",
                 text: str = "text") -> DataFrame:
    """The member rows (cluster, id, author) of the given clusters."""
    rows = df.select(F.md5(F.col(text)).alias("cluster"), F.col(id_col), F.col(author))
    return rows.join(clusters.select("cluster"), "cluster", "left_semi")


def order_clusters_by_length(clusters: DataFrame, tie: str = "cluster") -> DataFrame:
    """K5: clusters with their 0-based place ``rank`` in order of text length
    (ties by cluster), without a single-partition window."""
    return sorted_index(clusters, ["length", tie], out="rank")


def ingest_audit(df: DataFrame, min_size: int, duplicates: DataFrame, id_col: str = "file_id",
                 text: str = "text", size_col: str | None = None) -> DataFrame:
    """One pass, one ``reject_reason`` per row (size first, then duplicate,
    in the reference's order), replacement-character count for kept files."""
    size = F.col(size_col) if size_col else F.octet_length(F.col(text))
    d = duplicates.select(F.col(id_col), F.lit(True).alias("_dup"))
    t = df.join(d, id_col, "left")
    reason = (F.when(size <= min_size, "too_small").when(F.col("_dup"), "duplicate").otherwise("loaded"))
    t = t.withColumn("reject_reason", reason)
    return t.groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col(text).contains("�")).alias("with_replacement_chars"))
