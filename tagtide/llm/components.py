"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregate and a join on the node, so a hot node is pre-aggregated and its join can be
split by AQE; nothing is gathered by a task or by the driver but two numbers that tell whether the
edges still change. Steps are cut into the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import cut, reshuffled, tidy


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v). Large: link every greater neighbour of u to u's least one; small: link u's lesser ones and u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # merged, not broadcast: a broadcast for each step of each round would pile up in the driver
    joined = pairs.join(reshuffled(least, "u").hint("merge"), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long), any direction, repeats and loops allowed -> (node, component).

    component is the least node that links reach; nodes without an edge to another node are absent.
    Nulls take no part. An empty table gives an empty result.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = _mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.selectExpr("a u", "b v").unionByName(now.selectExpr("b u", "a v"))
        big = _star(both, True)
        now = cut(_star(big.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False))
        mark = _mark(now)
        tidy(edges.sparkSession)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.selectExpr("a node", "b component").unionByName(now.selectExpr("b node", "b component")).distinct()
