"""Plan guards: no registered query plans a cross join, or a window over all
rows in one task."""

import re

import pytest

from penprint.plans.registry import load_all
from tests.conftest import SF001

REG = load_all()
SLOW = {"m2_random_forest_cv", "m4_mlp_holdout",
        "x22_grid_results", "a21_best_per_k", "m13_leaderboard"}
#: Order columns of windows without a partition whose rows are bounded by a
#: constant: range and bucket numbers (at most FAN rows), and the top-k reports.
BOUNDED = re.compile(r"^(_ho_b\w*|_range\w*|_b)#|TakeOrdered")


def ungrouped_windows(plan: str) -> list[str]:
    """Orders of the windows without a partition, except over the rows of a limit."""
    lines, out = plan.splitlines(), []
    for i, line in enumerate(lines):
        if " Window [" not in line or re.search(r"\], \[[^\[\]]*\], \[[^\[\]]*\]$", line):
            continue
        order = line.rsplit("[", 1)[1].rstrip("]")
        below = " ".join(lines[i + 1:i + 8])
        if not BOUNDED.search(order) and "TakeOrdered" not in below and "WindowGroupLimit" not in below:
            out.append(order)
    return out


def test_guard_sees_ungrouped_windows(spark):
    from pyspark.sql import Window, functions as F
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert ungrouped_windows(plan(df.withColumn("n", F.sum("v").over(Window.orderBy("id")))))
    assert not ungrouped_windows(plan(df.withColumn("n", F.sum("v").over(Window.partitionBy("v").orderBy("id")))))


@pytest.mark.parametrize("name", sorted(n for n in REG if n not in SLOW))
def test_plan(spark, name):
    df = REG[name][0](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not ungrouped_windows(plan)
