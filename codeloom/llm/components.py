"""Connected components in DataFrame operations, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: link each node's larger neighbours (large) or smaller ones (small) to the least node around it."""
    both = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.union(both) if large else both.where("u > v").union(edges.where("u > v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    found = near.join(least, "u")
    if large:
        return found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return found.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (node, root): the least node of its component, for each node that has an edge to another.

    A node's edges are never gathered in one task: minima are aggregated before the shuffle and a hot node's
    join is left to adaptive skew splitting. Each round is written to the shared folder and the one before it deleted. The
    driver sees a count and a sum per round. Nodes are of any ordered type.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    for _ in range(most_rounds if seen[0] else 0):
        last, now = now, written(_star(_star(now, True), False), "edges")
        discard(last)
        before, seen = seen, _digest(now)
        if before == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
