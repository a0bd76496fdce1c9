"""Near duplicates of 64-bit hashes: a join on choices of bands with full recall, clusters and what they exempt."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.hashing import hamming
from attesta.operators.components import connected_components
from attesta.plans.lineage import cut


def _masks(rows: int, budget: int, width: int) -> list[int]:
    """Masks of which two hashes within ``budget`` bits share one at least: a hash is cut into ``budget`` bands and some more, and a mask
    is all but a choice of ``budget`` bands. The number of bands is what makes the fewest comparisons: masks to a row,
    times one and the rows that agree by chance under each."""
    cost = lambda n: comb(n, budget) * (1 + rows / 2 ** (width * (n - budget) // n))
    bands = min(range(budget + 1, min(2 * budget + 4, width) + 1), key=cost)
    edges = [width * k // bands for k in range(bands + 1)]
    piece = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(bands)]
    whole = [sum(piece[k] for k in range(bands) if k not in out) for out in combinations(range(bands), budget)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def hash_pairs(hashes: DataFrame, bits: str, budget: int, width: int = 64) -> DataFrame:
    """Pairs a < b of distinct hashes at ``budget`` or fewer differing bits, all of them.

    Hashes are distinct before they are joined, so copies make no pairs. Each hash is keyed under every mask (see :func:`_masks`: for 4 bits 5 for
    ten thousand rows, 15 for a million, 35 for tens of millions); rows that agree under a mask are compared, and a
    pair is kept at its first common mask only. Rows to a key stay few whatever the number of rows, unless hashes are close.
    """
    distinct = cut(hashes.select(F.col(bits).cast("long").alias("h")).where("h is not null").distinct())
    masks = _masks(distinct.count(), budget, width)
    masked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("h").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(masks)]))
    keyed = distinct.select("h", masked.alias("x")).select("h", "x.k", "x.v")
    a, b = keyed.withColumnRenamed("h", "a"), keyed.withColumnRenamed("h", "b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    joined = a.join(b, ["k", "v"]).where("a < b").where(hamming(F.col("a"), F.col("b")) <= budget)
    first = F.array_position(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: apart.bitwiseAND(m) == 0), True) - 1
    return joined.where(first == F.col("k")).select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


def classes(rows: DataFrame, key: str, *alike: str) -> DataFrame:
    """representative (the smallest key), size and ``alike`` of each class of rows that agree in ``alike``: copies, which are never paired."""
    return rows.where(F.col(alike[0]).isNotNull()).groupBy(*alike).agg(F.min(key).alias("representative"), F.count("*").alias("size"))


def membership(rows: DataFrame, key: str, *alike: str) -> DataFrame:
    """key, representative: the class of each row."""
    named = classes(rows, key, *alike).drop("size")
    return rows.join(named, list(alike)).select(key, "representative")


def class_pairs(of: DataFrame, bits: str, differ: str, budget: int, width: int = 64) -> DataFrame:
    """left, right, distance: representatives of classes at ``budget`` or fewer differing bits, equal hashes too, which differ in
    another column."""
    near = hash_pairs(of, bits, budget, width)
    same = of.select(F.col(bits).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("distance"))
    l = of.select(F.col("representative").alias("x"), F.col(bits).alias("a"), F.col(differ).alias("_l"))
    r = of.select(F.col("representative").alias("y"), F.col(bits).alias("b"), F.col(differ).alias("_r"))
    j = near.union(same).join(l, "a").join(r, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).where("_l <> _r")
    return j.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "distance")


def near_duplicates(rows: DataFrame, key: str, bits: str, exact: str, budget: int = 4, width: int = 64) -> DataFrame:
    """left, right, distance: pairs between classes of exact copies, by their representatives, at ``budget`` or fewer bits.

    Copies are members of a class (see :func:`membership`); no link between different ones is lost.
    """
    return class_pairs(classes(rows, key, bits, exact), bits, exact, budget, width)


def clusters(rows: DataFrame, key: str, bits: str, exact: str, budget: int = 4, width: int = 64) -> tuple[DataFrame, DataFrame]:
    """(cluster, key) for each row of a cluster, and per cluster avg_distance and max_distance of its links and confidence.

    A cluster is what links between classes connect, named by its smallest key; its members are those of its classes.
    """
    pairs = cut(near_duplicates(rows, key, bits, exact, budget, width))
    found = cut(connected_components(pairs, "left", "right"))
    members = membership(rows, key, bits, exact).join(found.select(F.col("node").alias("representative"), F.col("component").alias("cluster")), "representative").select("cluster", key)
    own = pairs.join(found, pairs["left"] == found["node"]).groupBy(F.col("component").alias("cluster")).agg(F.avg("distance").alias("d"), F.max("distance").alias("max_distance"))
    return members, own.select("cluster", F.round("d", 4).alias("avg_distance"), "max_distance", F.round(1 - F.col("d") / 64, 4).alias("confidence"))


def label_conflicts(rows: DataFrame, key: str, bits: str, label: str, budget: int = 3, width: int = 64) -> DataFrame:
    """left, right, distance, confidence: pairs between classes of one hash and one label, by their representatives, at
    ``budget`` or fewer bits, byte-identical ones too, whose labels differ."""
    out = class_pairs(classes(rows.where(F.col(label).isNotNull()), key, bits, label), bits, label, budget, width)
    return out.withColumn("confidence", F.round(1 - F.col("distance") / 64, 4))


def exempt_triggers(members: DataFrame, finding: str, sample: str, bits: str, mirrored: str, budget: int = 10, pivots: int = 8) -> DataFrame:
    """(finding, sample, counts): a finding does not count against a sample if every other sample in it is a near duplicate, as it
    is or mirrored. A sample that is alone in a finding counts.

    Samples of a finding are compared by the distinct pairs of their hashes (kinds), so copies are compared once. A kind that is far from one
    of ``pivots`` kinds of its finding counts. One is near to all if no more than ``budget`` of its bits are other in any of them. Only
    kinds that neither settles are compared with all of their finding.
    """
    names = {"f": finding, "hx": bits, "mx": mirrored}
    kinds = cut(members.groupBy(*[F.col(c).alias(n) for n, c in names.items()]).agg(F.count("*").alias("size")))
    near = lambda x, h, m: (hamming(x, h) <= budget) | (hamming(x, m) <= budget)
    place = F.row_number().over(Window.partitionBy("f").orderBy(F.xxhash64("hx"), "hx", "mx"))
    some = kinds.withColumn("_k", place).where(F.col("_k") <= pivots).groupBy("f").agg(F.collect_list(F.struct("hx", "mx")).alias("_some"))
    spans = kinds.groupBy("f").agg(F.bit_or("hx").alias("_any"), F.bit_and("hx").alias("_all"), F.count("*").alias("kinds"))
    met = kinds.join(spans.join(some, "f", "left"), "f")
    other = F.bitwise_not(F.col("hx")).bitwiseAND(F.col("_any")).bitwiseOR(F.col("hx").bitwiseAND(F.bitwise_not(F.col("_all"))))
    settled = F.when(F.exists("_some", lambda p: ~near(F.col("hx"), p["hx"], p["mx"])), False).when(F.bit_count(other) <= budget, True)
    met = cut(met.select(*names, "size", "kinds", settled.alias("near")))
    b = kinds.select("f", F.col("hx").alias("hy"), F.col("mx").alias("my"))
    rest = met.where("near is null").drop("near").join(b, "f").groupBy(*names, "size", "kinds").agg(F.bool_and(near(F.col("hx"), F.col("hy"), F.col("my"))).alias("near"))
    exempt = F.col("near") & ((F.col("kinds") > 1) | (F.col("size") > 1))
    verdict = met.where("near is not null").unionByName(rest).select(*[F.col(n).alias(c) for n, c in names.items()], (~exempt).alias("counts"))
    return members.join(verdict, [finding, bits, mirrored]).select(finding, sample, "counts")
