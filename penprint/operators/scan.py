"""Running sums and neighbouring rows over a table in some order, distributed.

``sum() over (order by ...)`` without a partition, or over one group that holds
most rows, runs in one task.  ``scan`` cuts the order into ranges instead:

1. range-partition by (group, order) into as many ranges as the row count asks
   for, sort, number the rows, and checkpoint: a row's number holds its range, so
   later reads agree on the ranges whatever is run again;
2. one row for each (range, group): its sums, its first and its last row;
3. exclusive running sums of these rows give each range its offset (in levels of
   ``FAN`` ranges, so no task reads more than that), and the rows of the range
   before and behind (joined by range number) are the neighbours at its borders;
4. windows inside (range, group) give the rest.

Group columns must not hold nulls.  An order that leaves ties is allowed; rows
that are equal in it are ordered as they arrive.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.session import cut_lineage

ROWS_PER_RANGE = 200_000
FAN = 1024


def range_offsets(parts: DataFrame, by: Sequence[str], number: str, sums: Sequence[str], n: int) -> DataFrame:
    """(by, number, sums) with every sum replaced by the total of the smaller
    numbers (0 .. n - 1) of its group."""
    by, kept, block = list(by), [], f"{number}_block"
    if n > FAN:
        parts = parts.withColumn(block, F.floor(F.col(number) / FAN).cast("long"))
        blocks = parts.groupBy(*by, block).agg(*(F.sum(c).alias(c) for c in sums))
        above = range_offsets(blocks, by, block, sums, -(-n // FAN))
        parts = parts.join(above.select(*by, block, *(F.col(c).alias(f"_up_{c}") for c in sums)), [*by, block])
        kept = [block]
    w = (Window.partitionBy(*by, *kept) if by or kept else Window).orderBy(number)
    own = [F.sum(c).over(w) - F.col(c) + (F.col(f"_up_{c}") if kept else F.lit(0)) for c in sums]
    return parts.select(*by, number, *(o.alias(c) for o, c in zip(own, sums)))


def scan(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column] | None = None,
         lag: dict[str, str] | None = None, lead: dict[str, str] | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with inclusive running sums (out -> column) and the values of the
    row before (``lag``) and behind (``lead``; out -> column name, null at the ends)
    within ``by``.  A grouped table that fits in one range takes plain windows."""
    by, sums, lag, lead = list(by), sums or {}, lag or {}, lead or {}
    n = max(1, math.ceil((df.count() if rows is None else rows) / ROWS_PER_RANGE))
    if by and n == 1:
        w = Window.partitionBy(*by).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *(F.sum(c).over(upto).alias(o) for o, c in sums.items()),
                         *(F.lag(c).over(w).alias(o) for o, c in lag.items()),
                         *(F.lead(c).over(w).alias(o) for o, c in lead.items()))
    keys = [*(F.col(c).asc() for c in by), *order]
    cut = cut_lineage(df.select("*", *(c.alias(f"_add_{o}") for o, c in sums.items()))
                      .repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                      .withColumn("_at", F.monotonically_increasing_id())
                      .withColumn("_range", F.shiftright("_at", 33)))
    adds = [f"_add_{o}" for o in sums]
    edges = cut.groupBy(*by, "_range").agg(
        *(F.sum(c).alias(c) for c in adds),
        *(F.max_by(c, "_at").alias(f"_last_{o}") for o, c in lag.items()),
        *(F.min_by(c, "_at").alias(f"_first_{o}") for o, c in lead.items()))
    w = Window.partitionBy("_range", *by).orderBy("_at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = cut.select("*", *(F.sum(c).over(upto).alias(f"_in_{c}") for c in adds),
                     *(F.lag(c).over(w).alias(o) for o, c in lag.items()),
                     *(F.lead(c).over(w).alias(o) for o, c in lead.items()),
                     F.row_number().over(w).alias("_nth"), F.lead(F.lit(1)).over(w).alias("_more"))
    if adds:
        off = range_offsets(edges.select(*by, "_range", *adds), by, "_range", adds, n)
        out = out.join(off.select(*by, "_range", *(F.col(c).alias(f"_off_{c}") for c in adds)), [*by, "_range"])
        out = out.select("*", *(((F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(o)) for o, c in zip(sums, adds)))
    if lag:
        before = edges.select(*by, (F.col("_range") + 1).alias("_range"), *(f"_last_{o}" for o in lag))
        out = out.join(before, [*by, "_range"], "left")
        out = out.withColumns({o: F.when(F.col("_nth") == 1, F.col(f"_last_{o}")).otherwise(F.col(o)) for o in lag})
    if lead:
        behind = edges.select(*by, (F.col("_range") - 1).alias("_range"), *(f"_first_{o}" for o in lead))
        out = out.join(behind, [*by, "_range"], "left")
        out = out.withColumns({o: F.when(F.col("_more").isNull(), F.col(f"_first_{o}")).otherwise(F.col(o)) for o in lead})
    return out.select(*df.columns, *sums, *lag, *lead)


def running_start(df: DataFrame, order: Sequence[Column], size: str, out: str, rows: int | None = None) -> DataFrame:
    """``df`` with the total ``size`` of all rows before each, over the whole table."""
    done = scan(df, [], order, sums={out: F.col(size)}, rows=rows)
    return done.withColumn(out, F.col(out) - F.col(size))
