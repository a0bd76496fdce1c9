"""Merkle roots by aligned blocks of leaves; inclusion proofs, level by level as joins, and their verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.hashing import EMPTY_SHA256
from attesta.plans.lineage import cut
from attesta.plans.prefix import running_sums


#: Levels that a block of nodes climbs at once: a task holds two to this power of digests.
CLIMB = 10


def numbered(leaves: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Leaves with ``idx`` from 0 in ``order`` (unique within ``keys``), numbered by ranges."""
    rows = leaves.withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    return cut(running_sums(rows, [*keys] or ["_all"], [order], {"idx": "_one"}).withColumn("idx", F.col("idx") - 1).drop("_all", "_one"))


def _climbed(nodes: Column, levels: Column) -> Column:
    """The nodes, an array in order, after so many levels; an odd last node is its own right neighbour."""
    at = lambda a, k: F.get(a, k)
    pair = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: F.sha2(F.concat(at(a, 2 * i), F.coalesce(at(a, 2 * i + 1), at(a, 2 * i))), 256))
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, nodes.cast("array<string>"), lambda a, _: pair(a).cast("array<string>"))


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes up to one."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _up(level: DataFrame) -> DataFrame:
    """Pairs to parents; an odd last node is its own right neighbour."""
    side = F.col("idx") % 2
    pair = level.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(F.max(F.when(side == 0, F.col("hash"))).alias("l"), F.max(F.when(side == 1, F.col("hash"))).alias("r"))
    return pair.select("idx", F.sha2(F.concat("l", F.coalesce("r", "l")), 256).alias("hash"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels from the leaves (idx, hash) to the root; each is half as large as the one before and written once."""
    out = [leaves.select("idx", "hash")]
    n = out[0].count()
    while n > 1:
        out.append(cut(_up(out[-1])))
        n = (n + 1) // 2
    return out


def root(leaves: DataFrame) -> DataFrame:
    """One row: root, leaves. No leaves give the digest of nothing."""
    tops = grouped_roots(leaves.select(F.lit(0).alias("_all"), "idx", "hash"), ["_all"])
    return tops.agg(F.coalesce(F.max("root"), F.lit(EMPTY_SHA256)).alias("root"))


def grouped_roots(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """The root of each group at once: keys, root. ``idx`` runs from 0 in each group.

    Aligned blocks of nodes climb :data:`CLIMB` levels in one shuffle, so a group of a million leaves takes two; a group whose
    top is reached within a block stops there.
    """
    sizes = leaves.groupBy(*keys).agg(F.max("idx").alias("_n"))
    height = (sizes.agg(F.max("_n")).first()[0] or 0).bit_length()
    now = leaves.join(sizes.withColumn("_n", F.col("_n") + 1), keys).select(*keys, "_n", "idx", "hash")
    for done in range(0, max(height, 1), CLIMB):
        left = F.least(F.greatest(_height(F.col("_n")) - done, F.lit(0)), F.lit(CLIMB)).cast("int")
        nodes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
        blocks = now.groupBy(*keys, "_n", F.shiftright("idx", CLIMB).alias("_block")).agg(nodes.alias("nodes"))
        now = blocks.select(*keys, "_n", F.col("_block").alias("idx"), F.get(_climbed(F.col("nodes"), left), F.lit(0)).alias("hash"))
    return now.select(*keys, F.col("hash").alias("root"))


def proofs(leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """idx, hash, proof: for each wanted leaf the siblings (hash, left) from the bottom up."""
    tree = levels(leaves)[:-1]
    steps = None
    for k, level in enumerate(tree):
        sibling = level.select(F.col("idx").alias("_s"), F.col("hash").alias("_h"))
        own = level.select(F.col("idx").alias("_o"), F.col("hash").alias("_oh"))
        at = wanted.select("idx", F.shiftright("idx", k).alias("_i"))
        j = at.join(sibling, F.col("_i").bitwiseXOR(F.lit(1).cast("long")) == F.col("_s"), "left").join(own, F.col("_i") == F.col("_o"))
        step = j.select("idx", F.struct(F.lit(k).alias("level"), F.coalesce("_h", "_oh").alias("hash"), (F.col("_i") % 2 == 1).alias("left")).alias("step"))
        steps = step if steps is None else steps.union(step)
    base = leaves.join(wanted.select("idx"), "idx", "left_semi").select("idx", "hash")
    if steps is None:
        return base.withColumn("proof", F.expr("cast(array() as array<struct<level:int,hash:string,left:boolean>>)"))
    return base.join(steps.groupBy("idx").agg(F.array_sort(F.collect_list("step")).alias("proof")), "idx")


def verify(rows: DataFrame, root_hash: str = "root") -> DataFrame:
    """Adds ``valid``: folding the proof into the leaf gives the root."""
    folded = F.aggregate("proof", F.col("hash"), lambda acc, s: F.sha2(F.when(s["left"], F.concat(s["hash"], acc)).otherwise(F.concat(acc, s["hash"])), 256))
    return rows.withColumn("valid", folded == F.col(root_hash))
