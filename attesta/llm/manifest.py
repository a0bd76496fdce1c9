"""Merkle manifests: a tree a part of a table and one tree over the parts, of which only every few levels are kept.

Leaves of a part are numbered in order and hashed upwards in runs of :data:`ARITY`. Of each tree the levels 0, ``EVERY``,
2 ``EVERY`` and so on are written; what lies between is worked out again, an aligned subtree at a time, when proofs are taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.plans.lineage import cut
from attesta.plans.prefix import running_sums

#: Nodes of a run, which become one node of the next level.
ARITY = 16
#: Levels from one stored level to the next: a subtree that is worked out again has ``ARITY ** EVERY`` nodes at its foot.
EVERY = 2
_BITS = 4 * EVERY
_STEPS = "array<struct<before:string,after:string>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of values as text, each told apart by its length in bytes; null is a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def part_key(column: Column) -> Column:
    """A text for each value of a part's name: null comes before all others, which keep their order in bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Manifest:
    """``stored``: the kept levels of the parts' trees, (part, idx, hash) each and the leaves' ``carry``; ``tops``: those of the tree over parts."""

    stored: list[DataFrame]
    tops: list[DataFrame]
    root: str | None

    def subroots(self) -> DataFrame:
        """part, hash: the root of each part."""
        return self.stored[-1].select("part", "hash")

    def table(self) -> DataFrame:
        """tree (parts or top), level, part, idx, hash of every stored node: what a manifest file holds."""
        levels = [("parts", k, d) for k, d in enumerate(self.stored)] + [("top", k, d) for k, d in enumerate(self.tops)]
        frames = [d.select(F.lit(tree).alias("tree"), F.lit(k * EVERY).alias("level"), "part", "idx", "hash") for tree, k, d in levels]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def _subtree(nodes: Column, left: Column) -> Column:
    """The nodes of an aligned subtree, an array in order, and its next ``left`` levels: an array of levels."""
    run = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / ARITY).cast("int")), lambda k: F.sha2(F.array_join(F.slice(a, k * ARITY + 1, ARITY), ""), 256))
    steps = F.when(left > 0, F.sequence(F.lit(1), left)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes).cast("array<array<string>>"), lambda a, _: F.concat(a, F.array(run(F.element_at(a, -1)))).cast("array<array<string>>"))


def _blocks(level: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """part, block, nodes, levels: the aligned subtrees over a stored level (those in ``only``), each in one row; ``levels`` goes up to
    the next stored level, or to the part's only node where that comes before."""
    last = level.groupBy("part").agg(F.max("idx").alias("_last"))
    foot = level.withColumn("block", F.shiftright("idx", _BITS))
    foot = foot if only is None else foot.join(only, ["part", "block"], "left_semi")
    nodes = F.array_sort(F.collect_list(F.struct("idx", *[c for c in level.columns if c not in ("part", "idx")])))
    blocks = foot.groupBy("part", "block").agg(nodes.alias("nodes"))
    left = F.lit(EVERY)
    for k in reversed(range(EVERY)):
        left = F.when(F.col("_last") < ARITY**k, k).otherwise(left)
    rows = blocks.join(last, "part").withColumn("_left", left.cast("int"))
    return rows.withColumn("levels", _subtree(F.transform("nodes", lambda x: x["hash"]), F.col("_left"))).drop("_last", "_left")


def _climbed(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels over ``leaves``, up to one node a part. A part whose top is reached keeps it on all further levels."""
    stored, largest = [leaves], leaves.agg(F.max("idx")).first()[0] or 0
    while largest > 0:
        up = _blocks(stored[-1])
        stored.append(cut(up.select("part", F.col("block").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("hash"))))
        largest >>= _BITS
    return stored


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``idx`` from 0 within each part; dealt by ranges, so that a part may spread over many tasks."""
    placed = running_sums(rows.withColumn("_one", F.lit(1)), ["part"], order, {"idx": "_one"})
    return cut(placed.withColumn("idx", F.col("idx") - 1).drop("_one", *[c for c in order if c.startswith("_")]))


def build(leaves: DataFrame, order: Sequence[str]) -> Manifest:
    """The manifest of ``leaves``: part, hash, carry (any struct that proofs hand on) and the columns of ``order``.

    Leaves of a part ascend by ``order``, nulls first, then by hash; equal ones are interchangeable. A lone leaf is its part's
    root. Parts ascend in bytes and have a tree of their own. No leaves give no root.
    """
    keys = {f"_o{k}": F.col(c) for k, c in enumerate(order)}
    rows = cut(leaves.withColumns(keys).withColumn("_tie", F.monotonically_increasing_id()).select("part", "hash", "carry", *keys, "_tie"))
    stored = _climbed(_numbered(rows.withColumn("_h", F.col("hash")), [*keys, "_h", "_tie"]))
    parts = stored[-1].select(F.lit("").alias("part"), "hash", F.struct(F.col("part").alias("name")).alias("carry"), F.col("part").alias("_o"))
    tops = _climbed(_numbered(parts, ["_o"]))
    top = tops[-1].select("hash").first()
    return Manifest(stored, tops, top[0] if top else None)


def _steps(levels: Column, at: Column) -> Column:
    """For the node at place ``at`` of a subtree's foot: the siblings left and right of its path, level by level."""

    def step(level: Column, k: Column) -> Column:
        own = F.call_function("shiftright", at, 4 * k)
        begin = own - own % ARITY
        before = F.array_join(F.slice(level, begin + 1, own % ARITY), "")
        after = F.array_join(F.slice(level, own + 2, ARITY - 1 - own % ARITY), "")
        return F.struct(before.alias("before"), after.alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step).cast(_STEPS)


def _descend(stored: list[DataFrame], above: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """part, idx, hash, carry and steps of the leaves under the tops in ``above`` (part, idx 0, steps and more, which is handed on)."""
    more = [c for c in above.columns if c not in ("part", "idx", "steps")]
    down = above
    for k in reversed(range(len(stored) - 1)):
        only = None if wanted is None else wanted.select("part", F.shiftright("idx", _BITS * (k + 1)).alias("block")).distinct()
        over = down.select("part", F.col("idx").alias("block"), F.col("steps").alias("_above"), *more)
        each = F.transform("nodes", lambda x, i: F.struct(x.alias("node"), F.concat(_steps(F.col("levels"), i), F.col("_above")).alias("steps")))
        met = _blocks(stored[k], only).join(over, ["part", "block"]).select("part", F.explode(each).alias("_x"), *more)
        down = met.select("part", "_x.node.*", "_x.steps", *more)
    if len(stored) == 1:
        down = stored[0].join(above.drop("idx"), "part")
    if wanted is not None:
        down = down.join(wanted.select("part", "idx").distinct(), ["part", "idx"], "left_semi")
    return down


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """part, idx, hash, carry, subroot, steps of every leaf, or of the ``wanted`` ones (part, idx).

    ``steps``: for each level from the leaf to the root the digests of its run's other nodes, those before it and those after it,
    as one text each. Going down from the stored tops, each aligned subtree is worked out again from the stored nodes at its foot
    and dropped once its nodes' siblings are taken; the steps above a subtree are shared by all nodes in it.
    """
    top = F.array().cast(_STEPS)
    crown = manifest.tops[-1].select("part", "idx", top.alias("steps"))
    names = _descend(manifest.tops, crown, None).select(F.col("carry.name").alias("part"), F.lit(0).cast("long").alias("idx"), "steps", F.col("hash").alias("subroot"))
    return _descend(manifest.stored, names, wanted)


def proof_text(steps: str = "steps") -> Column:
    """All siblings of a proof, level by level, from left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf: Column, steps: str = "steps") -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """part, hash, carry, doc_id of rows of ``documents``: a part a source; ``carry`` holds the id and, for rows that are to be tampered
    with (5 divides the CRC-32 of the id in decimals), the leaf that results when A-Z of the text become lower case.

    Null fields are dashes; a null id is never tampered with and comes first in its source. Repeated rows are leaves of their own. Very
    long texts are hashed whole. Other columns aren't read; an empty table gives no leaves.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = leaf_digest([*[F.col(c) for c in fields[:-1]], F.translate("text", upper, lower)])
    return docs.select(part_key(F.col("source")).alias("part"), leaf_digest([F.col(c) for c in fields]).alias("hash"), F.struct("doc_id", F.when(hit, changed).alias("tampered")).alias("carry"), "doc_id")
