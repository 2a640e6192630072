"""Pair look-up by (author, ordinal).

Samplers draw file *positions*; the files behind them come from an index that is
shuffled and sorted once, when it is written.  It is bucketed by (author, ordinal)
together, so the files of one author lie in all buckets and a hot author makes no
hot bucket.  Every later look-up moves only the drawn pairs (keys and whatever
columns they carry), never the files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.session import ensure_checkpoint_dir

ROWS_PER_BUCKET = 1_000_000


def write_file_index(ordinals: DataFrame, name: str | None = None, author: str = "author", ordinal: str = "ordinal",
                     path: str | None = None, buckets: int | None = None) -> str:
    """Writes (author, ordinal, …) as a bucketed, sorted table and returns its
    name.  It lies below the shared checkpoint folder unless ``path`` is given.
    ``buckets``: at least the session's shuffle partitions (fewer would make Spark
    shuffle the index again), and more for more than a million rows each."""
    spark = ordinals.sparkSession
    name = name or f"file_index_{uuid.uuid4().hex}"
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    if buckets is None:
        rows = ordinals.count()
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BUCKET))
    (ordinals.repartition(buckets, author, ordinal)  # the hash of the buckets: one file each
     .write.format("parquet").bucketBy(buckets, author, ordinal).sortBy(author, ordinal)
     .mode("overwrite").option("path", path).saveAsTable(name))
    return name


def drop_file_index(spark: SparkSession, name: str) -> None:
    """Forgets the table; its files stay in the folder it was written to."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def pair_lookup(pairs: DataFrame, index: str, author: str = "author", i: str = "i", j: str = "j",
                columns: dict[str, tuple[str, str]] | None = None, author_2: str | None = None,
                ordinal: str = "ordinal") -> DataFrame:
    """``pairs`` with the columns of both files.  ``columns`` maps a column of the
    index to its names for the first and the second file (default: the file id as
    file_1 and file_2).  ``author_2`` names the second file's author where it is
    another column.  Pairs whose author or ordinal is null or not in the index are
    dropped; other columns of ``pairs`` are kept; i and j are not."""
    columns = columns or {"file_id": ("file_1", "file_2")}
    files, out = pairs.sparkSession.table(index), pairs
    for side, (who, at) in enumerate(((author, i), (author_2 or author, j))):
        one = files.select(F.col(author).alias("_author"), F.col(ordinal).alias("_ordinal"),
                           *[F.col(c).alias(names[side]) for c, names in columns.items()])
        out = out.join(one, (F.col(who) == F.col("_author")) & (F.col(at) == F.col("_ordinal"))).drop(
            "_author", "_ordinal", at)
    return out
