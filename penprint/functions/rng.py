"""Deterministic, partition-independent randomness.

``h(seed, tag, ids...)`` is the first 52 bits of ``md5("seed:tag:id1:id2...")``
read as a non-negative BIGINT.  It is a pure function of its inputs, so a
sample never changes with the number of partitions, with retries after an
executor is lost, or between Spark and the SQL oracle (DuckDB computes the same
md5).  ``rand()`` is never used: its stream depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52
HASH_SCALE = float(2 ** HASH_BITS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed, tag: str, *ids) -> Column:
    parts = [F.lit(str(seed)), F.lit(str(tag))] + [_col(c).cast("string") for c in ids]
    return F.concat_ws(":", *parts)


def h(seed, tag: str, *ids) -> Column:
    """Uniform integer in [0, 2^52)."""
    return F.conv(F.substring(F.md5(hash_key(seed, tag, *ids)), 1, 13), 16, 10).cast("bigint")


def u01(seed, tag: str, *ids) -> Column:
    """Uniform double in [0, 1)."""
    return h(seed, tag, *ids) / F.lit(HASH_SCALE)


def draw(seed, tag: str, n, *ids) -> Column:
    """Uniform integer in [0, n) (n a Column or int, n >= 1)."""
    return F.pmod(h(seed, tag, *ids), _col(n) if not isinstance(n, int) else F.lit(n))


# ---- SQL (DuckDB) spellings of the same functions, used by the oracle --------

def sql_h(seed, tag: str, *id_exprs: str) -> str:
    parts = ", ".join([f"'{seed}'", f"'{tag}'"] + [f"CAST({e} AS VARCHAR)" for e in id_exprs])
    return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 13))::BIGINT"


def sql_u01(seed, tag: str, *id_exprs: str) -> str:
    return f"({sql_h(seed, tag, *id_exprs)} / {HASH_SCALE!r})"
