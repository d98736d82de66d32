"""Connected components by alternating large-star and small-star steps.

Every step is a combinable groupBy-min and a join on the same key. Hubs, keys with more than a
thousandth of all rows, get their least neighbour by broadcast, so that no task holds a hub's rows.
State is cut with checkpoint() in the shared folder after each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import shared_dir, spread_join


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above u points to the least of u and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("rows")).where("rows > 0").checkpoint()
    return spread_join(both.where("v > u"), least, "u", "rows", total=total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    """u (the larger end) and its smaller neighbours all point to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).checkpoint()
    moved = spread_join(edges, least, "u", "rows", total=total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges(u, v); the component is its least node.

    Null ends and self-loops make no link. Repeated edges count once. Nodes without a link
    are absent. Raises RuntimeError if it has not settled after `rounds` rounds.
    """
    shared_dir(edges.sparkSession)
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    mark = digest(now)
    for _ in range(rounds if mark[0] else 0):
        # both steps give edges from the larger to the smaller end
        middle = _large(now, mark[0]).checkpoint()
        now = _small(middle, mark[0]).checkpoint()
        got = digest(now)
        if got == mark:
            break
        mark = got
    else:
        if mark[0]:
            raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
