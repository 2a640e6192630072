"""Skew-safe ranking inside groups.

``row_number() over (partition by author ...)`` puts a whole author into one
task.  When one author holds a third of all rows that task is the job.  The
helpers below split every group into ordered buckets:

1. count rows per (group, bucket) — partial aggregation, tiny shuffle;
2. running sum over buckets inside each group, in levels of 1024 buckets, gives
   each bucket its offset;
3. ``row_number`` only inside (group, bucket) — a hot group is spread over many
   tasks.

The result equals ``row_number() over (partition by group order by ...)``
exactly, so the SQL oracle uses that plain form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions.rng import HASH_BITS
from penprint.operators.scan import range_offsets, running_start

DEFAULT_BUCKET_BITS = 10
ROWS_PER_BUCKET = 1 << 16


def bits_for(rows: int) -> int:
    """Hash bits that cut so many rows into buckets of about ``ROWS_PER_BUCKET``."""
    return min(HASH_BITS, max(0, -(-rows // ROWS_PER_BUCKET) - 1).bit_length())


def bucketed_ordinal(df: DataFrame, group_cols: Sequence[str], bucket_cols: Sequence[str],
                     order: Sequence[Column], out: str = "ordinal") -> DataFrame:
    """0-based rank inside ``group_cols`` ordered by (bucket_cols, order).

    ``bucket_cols`` must be coarse leading sort keys whose value range per group
    is bounded (e.g. the top bits of a uniform hash), so the per-group offset
    table stays small while each (group, bucket) holds a slice of the group.
    """
    group_cols, bucket_cols = list(group_cols), list(bucket_cols)
    counts = df.groupBy(*group_cols, *bucket_cols).agg(F.count(F.lit(1)).alias("_bo_n"))
    wb = (Window.partitionBy(*group_cols) if group_cols else Window).orderBy(*bucket_cols)
    counts = counts.withColumn("_bo_off", F.sum("_bo_n").over(wb) - F.col("_bo_n")).drop("_bo_n")
    joined = df.join(counts, on=group_cols + bucket_cols, how="inner")
    wr = Window.partitionBy(*group_cols, *bucket_cols).orderBy(*order)
    return joined.withColumn(out, F.col("_bo_off") + F.row_number().over(wr) - 1).drop("_bo_off")


def hash_ordinal(df: DataFrame, group_cols: Sequence[str], hash_col: str,
                 tie_cols: Sequence[str], out: str = "ordinal", rows: int | None = None,
                 bucket_bits: int = DEFAULT_BUCKET_BITS) -> DataFrame:
    """0-based rank inside ``group_cols`` ordered by (hash_col, tie_cols).

    ``hash_col`` holds uniform values in [0, 2^52) (see ``rng.h``); its top bits
    are the bucket, as many as ``rows`` (all rows of the table) ask for, or
    ``bucket_bits`` where the count is not given.  No task ranks more than a
    bucket or sums more than 1024 of them.
    """
    bits = bucket_bits if rows is None else bits_for(rows)
    keys = [*group_cols, "_ho_b"]
    staged = df.withColumn("_ho_b", F.shiftright(F.col(hash_col), HASH_BITS - bits))
    counts = staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ho_n"))
    starts = range_offsets(counts, group_cols, "_ho_b", ["_ho_n"], 1 << bits)
    w = Window.partitionBy(*keys).orderBy(F.col(hash_col), *(F.col(c) for c in tie_cols))
    return (staged.join(starts, keys).withColumn(out, F.col("_ho_n") + F.row_number().over(w) - 1)
            .drop("_ho_b", "_ho_n"))


def first_k(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
            out: str | None = None) -> DataFrame:
    """Rows ranked 1..k inside each group (k is a constant).

    Spark plans ``row_number() <= k`` with a partial WindowGroupLimit before the
    shuffle, so a hot group ships at most k rows per map task.
    """
    w = (Window.partitionBy(*group_cols) if group_cols else Window).orderBy(*order)
    rn = out or "_fk_rn"
    res = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return res if out else res.drop(rn)


def sorted_index(df: DataFrame, order_cols: Sequence[str], out: str = "idx") -> DataFrame:
    """Dense 0-based index of rows in ``order_cols`` order: a distributed running
    count over ranges of the order (``scan.py``)."""
    one = df.withColumn("_si_1", F.lit(1).cast("bigint"))
    return running_start(one, [F.col(c).asc() for c in order_cols], "_si_1", out).drop("_si_1")
