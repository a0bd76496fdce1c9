"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.lineage import cut


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first())


def _with_minimum(directed: DataFrame) -> DataFrame:
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    return directed.join(least, "u")


def connected_components(edges: DataFrame, left: str, right: str, *, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Every round joins edges with the smallest neighbour of one end: no group is gathered in one task, and a hub's rows can be
    split by adaptive execution. Rounds are logarithmic in practice; each one is written to the shared folder. Self loops give
    components of one node; null ends are left out; repeated edges count once.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna()
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    now = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        sign = _signature(now)
        if sign == before or sign[0] == 0:
            break
        before = sign
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _with_minimum(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
