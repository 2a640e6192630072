"""Connected components of a links table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from penprint.llm.frames import parts_for, saved
from penprint.session import cut_lineage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``links``
    (a, b).  Alternating large-star and small-star steps; each step is a grouped
    minimum and a join, so a node with very many links is split by the join, and
    every round is written to the shared checkpoint folder."""
    edges = saved(links.select("a", "b").where("a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, state = edges.count(), None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = cut_lineage(edges.coalesce(parts_for(n)))
        n, *now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (n, *now) == state:
            break
        state = (n, *now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
