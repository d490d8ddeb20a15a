"""Connected components of an edge table, by alternating large-star and small-star steps.

No neighbourhood is ever gathered: a step takes each node's least neighbour by a partial aggregate and sends it
back over the edges by an equi-join, which skew handling can split where a node has very many edges.  Each
round is written to the shared folder.  The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), any direction, no loops -> the edges after one step, u > v, distinct."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if large:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = stage(e.groupBy("u").agg(F.min("v").alias("m")))
        out = e.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
    return stage(out.where("u <> v").distinct())


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): for every node of an edge, the least node of its component."""
    now, was = stage(edges.select("u", "v").where("u <> v").distinct()), None
    for _ in range(rounds):
        now = _star(_star(now, True), False)
        # Stars do not change any more once every edge points to a root, which is a sum that stays the same.
        is_now = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if is_now == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        was = is_now
    raise RuntimeError("components did not settle")
