"""Lineage over node and edge tables: traces, blast radius, integrity, subgraphs and contributor risk.

Edges point from what depends to what it depends on, but for PROVIDED, CONTAINS_SAMPLE and PRODUCED. They are first brought to
one directed table, and a trace then joins its frontier with it, level by level, for any number of roots at once: 64 roots are
the bits of one word, so roots that reach the same nodes travel together. Words are taken block by block, and what a block needed is
deleted before the next, so the disk that a trace needs follows its tables and its result, not all that it passes through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.tiers import lookup, tier
from attesta.plans.lineage import cut, passing
from attesta.plans.prefix import dealt, scanned

OUTWARD = ("GENERATED_BY", "TRAINED_ON", "AUTHORED_BY", "VERSION_OF", "USED_PREPROCESSING")


def _typed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between existing nodes, with the types of both ends; written."""
    n = nodes.select("id", "node_type")
    with passing(edges.sparkSession):
        begun = cut(edges.join(n.withColumnsRenamed({"id": "source_id", "node_type": "source_type"}), "source_id"))
        return cut(begun.join(n.withColumnsRenamed({"id": "target_id", "node_type": "target_type"}), "target_id"), keep=1)


def dependencies(edges: DataFrame, nodes: DataFrame, downstream: bool = False) -> DataFrame:
    """(src, dst): the steps of an upstream trace, or of a downstream one. PROVIDED is followed both ways upstream, outwards only downstream."""
    return all_steps(edges, nodes, downstream).distinct()


def all_steps(edges: DataFrame, nodes: DataFrame, downstream: bool = False) -> DataFrame:
    """:func:`dependencies`, with steps that several edges make as often as they do."""
    e = _typed(edges, nodes)
    run = (F.col("source_type") == "MODEL") & (F.col("target_type") == "TRAINING_RUN")
    kind = F.col("edge_type")
    made = kind == "PRODUCED"
    out = e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), kind, run.alias("run"), F.col("target_type").alias("t"))
    back = e.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), kind, run.alias("run"))
    if downstream:
        steps = out.where(kind.isin("PROVIDED", "CONTAINS_SAMPLE") | made & ~F.col("run")).select("src", "dst").union(back.where(kind.isin(*OUTWARD) | made & F.col("run")).select("src", "dst"))
    else:
        steps = out.where(kind.isin("PROVIDED", *OUTWARD) | made & (F.col("t") == "TRAINING_RUN")).select("src", "dst").union(back.where(kind.isin("PROVIDED", "CONTAINS_SAMPLE") | made & ~F.col("run")).select("src", "dst"))
    return steps


def words_of(roots: DataFrame) -> DataFrame:
    """root, word, bit: distinct roots numbered by ranges of their ids, 64 to a word."""
    rows = roots.select("id").distinct().withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("long")})
    at = F.col("_at") - 1
    return cut(scanned(dealt(rows, ["_all"], ["id"]), ["_all"], ["id"], sums={"_at": "_one"}).select(F.col("id").alias("root"), F.shiftright(at, 6).alias("word"), (at % 64).cast("int").alias("bit")))


def fans(steps: DataFrame, only: DataFrame | None = None, width: int = 1024, *, keep: int = 0) -> DataFrame:
    """(src, to, own, last): the ends of each node's steps, ``width`` at most to a row: those that have steps themselves, those that one root alone
    may enter (``only``: id, oword, obit; left out where ``oword`` is null), and those where all ways end. ``steps`` may hold copies and is
    read twice. ``keep``: as in :func:`cut`."""
    met = steps.select("src", "dst").join(steps.select(F.col("src").alias("dst"), F.lit(True).alias("on")).distinct(), "dst", "left")
    barred = F.lit(False)
    if only is not None:
        barred = F.col("oword").isNotNull()
        met = met.join(only.select(F.col("id").alias("dst"), "oword", "obit", F.lit(True).alias("_barred")), "dst", "left").where("_barred is null or oword is not null").drop("_barred")
    met = cut(met).repartition("src").distinct()
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    those = lambda which, what: F.collect_list(F.when(which, what))
    own = those(barred, F.struct(F.col("dst").alias("id"), "oword", "obit")) if only is not None else F.array().cast("array<struct<id:string,oword:bigint,obit:int>>")
    ends = [those(~barred & F.col("on").isNotNull(), F.col("dst")).alias("to"), own.alias("own"), those(~barred & F.col("on").isNull(), F.col("dst")).alias("last")]
    return cut(met.withColumn("_c", F.floor(place / width)).groupBy("src", "_c").agg(*ends).select("src", "to", "own", "last"), keep=keep)


def seeded(words: DataFrame) -> DataFrame:
    """(word, id, mask): each root as the bit of its word."""
    return words.groupBy("word", F.col("root").alias("id")).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))


def spread(ends: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(word, id, mask, depth): the roots, as bits of a word, that reach a node in ``depth`` steps and no fewer, over the :func:`fans` of the
    steps; ``seeds`` (word, id, mask) are there in 0."""
    return DataFrame.unionByName(*_spread(ends, seeds, max_depth))


def _spread(ends: DataFrame, seeds: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`spread` for nodes that have steps, written, and for those where all ways end, which lie by words.

    A level joins the frontier with the fans and sends each frontier row once, with all its ends, to its word's task, where
    the bits that meet at a node are joined and those that were there before taken away: what is shuffled follows the frontier, not
    the ends that it reaches. Nodes where all ways end are no frontier: they are met once, after the last level, and never written here.
    """
    none = F.lit(0).cast("long")
    inner, outer = ends.where("size(to) > 0 or size(own) > 0").select("src", "to", "own"), ends.where("size(last) > 0").select("src", "last")
    seeds = cut(seeds.select("word", "id", "mask", F.lit(0).alias("depth")))
    seen = frontier = seeds
    depth = 0
    while depth < max_depth:
        met = frontier.join(inner, F.col("id") == F.col("src")).select("word", "mask", "to", "own")
        held = met.select("word", "mask", F.explode("own").alias("o")).where("o.oword = word")
        held = held.select("word", F.col("mask").bitwiseAND(F.expr("shiftleft(1L, o.obit)")).alias("mask"), F.array("o.id").alias("to"))
        sent = cut(met.where("size(to) > 0").select("word", "mask", "to").union(held).where("mask <> 0"))
        if sent.isEmpty():
            break
        depth += 1
        known = seen.select("word", none.alias("mask"), F.array("id").alias("to"), F.col("mask").alias("old"))
        met = sent.withColumn("old", none).union(known).repartition("word").select("word", "mask", "old", F.explode("to").alias("id"))
        met = met.groupBy("word", "id").agg(F.bit_or("mask").alias("mask"), F.bit_or("old").alias("old"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.col("old")))
        frontier = cut(met.select("word", "id", fresh.alias("mask")).where("mask <> 0").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    sent = cut(seen.where(F.col("depth") < max_depth).join(outer, F.col("id") == F.col("src")).select("word", "mask", "depth", "last"))
    begun = seeds.select("word", "mask", F.lit(-1).alias("depth"), F.array("id").alias("last"))
    met = sent.union(begun).repartition("word").select("word", "mask", "depth", F.explode("last").alias("id"))
    at = [F.coalesce(F.bit_or(F.when(F.col("depth") == k, F.col("mask"))), none).alias(f"_{k + 1}") for k in range(-1, depth + 1)]
    met = met.groupBy("word", "id").agg(*at)
    first = [F.struct(F.col(f"_{k}").bitwiseAND(F.bitwise_not(reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"_{j}") for j in range(k)]))).alias("mask"), F.lit(k).alias("depth")) for k in range(1, depth + 2)]
    return seen, met.select("word", "id", F.inline(F.array(*first))).where("mask <> 0")


def in_blocks(words: DataFrame, run: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], *, keep: int = 0, first: int = 1024, size: int = 1 << 27) -> DataFrame:
    """What ``run`` makes of all words, block after block: it is given a function that keeps the rows of the block's words. Results stay
    (``keep``: as in :func:`cut`), all else that a block wrote goes with it. A block has as many words as make about ``size`` bytes of
    tables, going by the one before."""
    spark, out, at, width = words.sparkSession, [], 0, first
    most = words.agg(F.max("word")).first()[0] or 0
    while at <= most:
        with passing(spark) as written:
            within = lambda df, a=at, b=at + width: df.where((F.col("word") >= a) & (F.col("word") < b))
            out.append(cut(run(within), keep=keep + 1))
            at += width
            width = max(1, min(8 * width, width * size // max(written(), 1)))
    return reduce(DataFrame.unionByName, out)


def _rosters(words: DataFrame) -> DataFrame:
    """(word, roots): the roots of a word, each at its bit."""
    return words.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("bit", "root"))).alias("_roots"))


def each_root(masked: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of words as rows of roots: ``root`` in place of ``word`` and ``mask``. A word's roots come to its rows before these multiply."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1)) == 1)
    rest = [c for c in masked.columns if c not in ("word", "mask")]
    met = masked.join(_rosters(words), "word")
    return met.select(*rest, F.explode(F.transform(bits, lambda b: F.element_at("_roots", b))).alias("root"))


def counted(masked: DataFrame, words: DataFrame, name: str, *more: str) -> DataFrame:
    """root, ``more``, ``name``: how many of the rows have a root's bit; roots that no row has are left out.

    A word's rows are counted bit by bit where they lie, so rows never multiply.
    """
    sums = [F.sum(F.shiftright("mask", b).bitwiseAND(F.lit(1))) for b in range(64)]
    g = masked.groupBy("word", *more).agg(F.array(*sums).alias("_n")).join(_rosters(words), "word")
    return g.select(*more, F.inline(F.transform(F.map_entries("_roots"), lambda e: F.struct(e["value"].alias("root"), F.get("_n", e["key"]).alias(name))))).where(F.col(name) > 0)


def once(masked: DataFrame, what: str = "id") -> DataFrame:
    """word, ``what``, mask: the bits that meet at each value."""
    return masked.groupBy("word", what).agg(F.bit_or("mask").alias("mask"))


def trace(steps: DataFrame, roots: DataFrame, max_depth: int = 10, *, keep: int = 0) -> DataFrame:
    """(root, id, depth): what is reached from each root in at most ``max_depth`` steps, at its least depth; roots left out. ``keep``: as in
    :func:`cut`."""
    with passing(steps.sparkSession):
        with passing(steps.sparkSession):
            ends = fans(cut(steps), keep=1)
        return traced(ends, roots, max_depth, keep=keep + 1)


def traced(ends: DataFrame, roots: DataFrame, max_depth: int = 10, *, keep: int = 0) -> DataFrame:
    """:func:`trace` over the :func:`fans` of the steps."""
    with passing(ends.sparkSession):
        words = words_of(roots)

        def rows(within: Callable[[DataFrame], DataFrame]) -> DataFrame:
            # each part meets its roots where it lies
            found = [each_root(p.where("depth > 0"), within(words)) for p in _spread(ends, within(seeded(words)), max_depth)]
            return found[0].unionByName(found[1]).select("root", "id", "depth").sortWithinPartitions("root")

        return in_blocks(words, rows, keep=keep + 1)


def upsert_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each (source, target, type): metadata of later ones is merged into that of the first, key by key."""
    keys = ["source_id", "target_id", "edge_type"]
    items = edges.select(*keys, order, F.explode_outer("metadata").alias("k", "v"))
    last = items.where("k is not null").groupBy(*keys, "k").agg(F.max_by("v", order).alias("v"))
    merged = last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    return edges.select(*keys).distinct().join(merged, keys, "left")


def attach_evidence(evidence: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (FLAGGED_WITH out, ABOUT back) for evidence (finding_id, subject) whose subject exists."""
    known = evidence.join(nodes.select(F.col("id").alias("subject")), "subject", "left_semi")
    new = known.select(F.col("finding_id").alias("id"), F.lit("FINDING").alias("node_type"))
    edge = lambda a, b, t: known.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(t).alias("edge_type"))
    return new, edge("subject", "finding_id", "FLAGGED_WITH").union(edge("finding_id", "subject", "ABOUT"))


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, evidence): evidence and findings of each node, by edges out or in."""
    ev = nodes.where(F.col("node_type").isin("EVIDENCE", "FINDING")).select(F.col("id").alias("evidence"))
    out = edges.where(F.col("edge_type").isin("FLAGGED_WITH", "EVALUATED_BY")).select(F.col("source_id").alias("id"), F.col("target_id").alias("evidence"))
    back = edges.where(F.col("edge_type").isin("FLAGGED_WITH", "ABOUT", "EVALUATED_BY")).select(F.col("target_id").alias("id"), F.col("source_id").alias("evidence"))
    return out.union(back).distinct().join(ev, "evidence", "left_semi").select("id", "evidence")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n_in, n_out, n_neighbours) of every node.

    Edges meet once, as pairs of ends whichever way they point, and each pair then counts for both. Neighbours that are no nodes are
    taken off again, by the pairs of those ids alone.
    """
    s, t = F.col("source_id"), F.col("target_id")
    held = F.coalesce(s <= t, F.lit(True))
    ends = edges.select(F.when(held, s).otherwise(t).alias("a"), F.when(held, t).otherwise(s).alias("b"), held.cast("long").alias("to"), (~held).cast("long").alias("fro"))
    pairs = cut(ends.groupBy("a", "b").agg(F.sum("to").alias("to"), F.sum("fro").alias("fro")))
    two = F.coalesce((F.col("a") != F.col("b")).cast("long"), F.lit(0).cast("long")).alias("near")
    at = lambda i, n_in, n_out: F.struct(F.col(i).alias("id"), F.col(n_in).alias("n_in"), F.col(n_out).alias("n_out"), two, F.lit(0).alias("node"))
    each = pairs.select(F.inline(F.array(at("a", "fro", "to"), at("b", "to", "fro")))).where("id is not null")
    none = F.lit(0).cast("long")
    both = each.union(nodes.select("id", none, none, none, F.lit(1))).groupBy("id").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.sum("near").alias("near"), F.sum("node").alias("node"))
    both = cut(both)
    gone = cut(both.where("node = 0").select(F.col("id").alias("gone")))
    lost = [pairs.where("a <> b").join(gone, F.col(x) == F.col("gone"), "left_semi").select(F.col(y).alias("id")) for x, y in (("a", "b"), ("b", "a"))]
    lost = lost[0].union(lost[1]).groupBy("id").agg(F.count("*").alias("lost"))
    known = both.where("node > 0").join(lost, "id", "left")
    return known.select("id", "n_in", "n_out", (F.col("near") - F.coalesce("lost", F.lit(0))).alias("n_neighbours"), F.explode(F.array_repeat(F.lit(0), F.col("node").cast("int"))).alias("_")).drop("_")


def quarantines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, quarantine): quarantine records of each node, by QUARANTINES edges either way and RESULTED_FROM edges out."""
    record = nodes.where("node_type = 'QUARANTINE_RECORD'").select(F.col("id").alias("quarantine"))
    out = edges.where("edge_type in ('QUARANTINES', 'RESULTED_FROM')").select(F.col("source_id").alias("id"), F.col("target_id").alias("quarantine"))
    back = edges.where("edge_type = 'QUARANTINES'").select(F.col("target_id").alias("id"), F.col("source_id").alias("quarantine"))
    return out.union(back).distinct().join(record, "quarantine", "left_semi").select("id", "quarantine")


def blast_radius(edges: DataFrame, nodes: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """Per root: runs, models, inferences, downstream, evidence, quarantines, direct (its edges), total and status.

    Evidence and quarantines are those of the root and of all downstream of it; quarantine records that lie downstream count too.
    """
    with passing(edges.sparkSession):
        edges, nodes, words = cut(edges), cut(nodes), words_of(roots)
        with passing(edges.sparkSession):
            ends = fans(all_steps(edges, nodes, downstream=True), keep=1)
        evidence, held = cut(attached(edges, nodes)), cut(quarantines(edges, nodes))
        kinds = {"runs": ("TRAINING_RUN",), "models": ("MODEL", "MODEL_VERSION"), "inferences": ("INFERENCE", "INFERENCE_RECORD")}
        kind = F.coalesce(*[F.when(F.col("node_type").isin(*t), k) for k, t in kinds.items()])

        def counts(within: Callable[[DataFrame], DataFrame]) -> DataFrame:
            own, area = within(words), cut(spread(ends, within(seeded(words)), max_depth))
            typed = area.where("depth > 0").join(nodes.select("id", "node_type"), "id")
            g = counted(typed.withColumn("kind", kind), own, "n", "kind").groupBy("root")
            g = g.agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds], F.sum("n").alias("downstream"))
            ev = counted(once(area.join(evidence, "id"), "evidence"), own, "evidence")
            at = area.join(held, "id").select("word", "quarantine", "mask").union(typed.where("node_type = 'QUARANTINE_RECORD'").select("word", "id", "mask"))
            at = counted(once(at, "quarantine"), own, "quarantines")
            return own.select("root").join(g, "root", "left").join(ev, "root", "left").join(at, "root", "left")

        found = in_blocks(words, counts)
        degree = edges.select(F.explode(F.array("source_id", "target_id")).alias("root")).groupBy("root").agg(F.count("*").alias("direct"))
        out = cut(found.join(degree, "root", "left").na.fill(0), keep=1)
    status = F.when(F.col("quarantines") > 0, "QUARANTINED").when(F.col("evidence") > 0, "UNDER_REVIEW").otherwise("ACCEPTED")
    return out.withColumns({"total": F.col("runs") + F.col("models") + F.col("inferences"), "status": status})


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: total nodes and edges, broken edges (an end is missing), orphans (no edge), valid.

    One grouping by id of nodes and edges' ends tells for each id whether it is a node and how many ends name it; an edge with both
    ends missing is counted once, as its ends are looked up by number.
    """
    numbered = cut(edges.select("source_id", "target_id").withColumn("_e", F.monotonically_increasing_id()))
    ends = numbered.select(F.explode(F.array("source_id", "target_id")).alias("id"), "_e")
    known = nodes.select("id").withColumn("_node", F.lit(True))
    met = ends.join(known, "id", "full")
    per_id = met.agg(F.count_if(F.col("_e").isNull()).alias("orphans"))
    bad = met.where("_node is null").agg(F.count_distinct("_e").alias("broken"))
    counts = nodes.agg(F.count("*").alias("total_nodes")).join(numbered.agg(F.count("*").alias("total_edges"))).join(bad).join(per_id)
    return counts.select("total_nodes", "total_edges", "broken", "orphans", (F.col("broken") == 0).alias("valid"))


def subject_mismatches(edges: DataFrame, nodes: DataFrame, subject: str) -> DataFrame:
    """Edges from evidence that names another subject than the edge's target."""
    ev = nodes.where("node_type = 'EVIDENCE'").select(F.col("id").alias("source_id"), F.col(subject).alias("_s"))
    return edges.join(ev, "source_id").where(F.col("_s").isNotNull() & (F.col("_s") != F.col("target_id"))).drop("_s")


#: What of a word's block a subgraph or cluster holds, as (word, id, mask) with each root once at a node.
Area = Callable[[Callable[[DataFrame], DataFrame]], DataFrame]


def subgraph_area(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, stops: Column, passes: Column, max_depth: int = 10) -> tuple[Area, DataFrame]:
    """:func:`subgraph` block by block, and the words (root, word, bit) of the seeds. Called within :func:`passing`."""
    with passing(edges.sparkSession):
        kinds = cut(nodes.select("id", stops.alias("stop"), passes.alias("through")).distinct())
        both = cut(_both(edges).join(kinds.where("not stop").select(F.col("id").alias("dst")).distinct(), "dst", "left_semi"))
        both = cut(both.join(kinds.where("through").select(F.col("id").alias("src")).distinct(), "src", "left_semi"))
        ends = fans(both, keep=1)
    words = words_of(seeds)
    return lambda within: spread(ends, within(seeded(words)), max_depth).select("word", "id", "mask"), words


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).union(edges.select("target_id", "source_id"))


def members(area: Area, words: DataFrame, name: str = "members", *, keep: int = 0) -> DataFrame:
    """root, ``name``: how many nodes the area of each root holds."""
    return in_blocks(words, lambda within: counted(area(within), within(words), name), keep=keep)


def subgraph(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, stops: Column, passes: Column, max_depth: int = 10) -> DataFrame:
    """(root, id): what each seed's neighbourhood holds, over edges in both directions.

    Nodes where ``stops`` is true are not entered; nodes where ``passes`` is false are entered but not left.
    """
    with passing(edges.sparkSession):
        area, words = subgraph_area(edges, nodes, seeds, stops, passes, max_depth)
        return in_blocks(words, lambda within: each_root(area(within), within(words)).select("root", "id"), keep=1)


def batch_area(edges: DataFrame, nodes: DataFrame, batches: DataFrame, max_depth: int = 32) -> tuple[Area, DataFrame]:
    """:func:`batch_subgraph` block by block, and the words (root, word, bit) of the batches. Called within :func:`passing`."""
    words = words_of(batches)
    named = [nodes.select(F.col(c).alias("root"), "id") for c in ("batch_id", "dataset_id", "scan_id")]
    begun = named[0].union(named[1]).union(named[2]).union(nodes.select(F.col("id").alias("root"), "id")).join(words, "root")
    seeds = cut(begun.groupBy("word", "id").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")))
    last = nodes.where("node_type = 'CONTRIBUTOR'").select(F.col("id").alias("src"))
    # what a batch begins at is left even if it is a contributor
    begins = not seeds.select(F.col("id").alias("src")).join(last, "src", "left_semi").isEmpty() and max_depth > 0
    with passing(edges.sparkSession):
        # a batch, and what names a batch or dataset, is entered by that root only; by none if it names two
        whose = F.array_distinct(F.filter(F.array(F.when(F.col("node_type").isin("DATASET", "DATASET_BATCH"), F.col("id")), F.when(F.col("batch_id") != "", F.col("batch_id")), F.when(F.col("dataset_id") != "", F.col("dataset_id"))), lambda x: x.isNotNull()))
        held = nodes.select("id", whose.alias("_whose")).where("size(_whose) > 0").select("id", F.when(F.size("_whose") == 1, F.get("_whose", F.lit(0))).alias("root"))
        only = cut(held.join(words, "root", "left").select("id", F.col("word").alias("oword"), F.col("bit").alias("obit")))
        both = cut(_both(edges).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"))
        ends = fans(cut(both.join(last, "src", "left_anti")), only, keep=1)
        every = fans(both, only, keep=1) if begins else None

    def area(within: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if not begins:
            return spread(ends, within(seeds), max_depth).select("word", "id", "mask")
        return spread(ends, once(cut(spread(every, within(seeds), 1))), max_depth - 1).select("word", "id", "mask")

    return area, words


def batch_subgraph(edges: DataFrame, nodes: DataFrame, batches: DataFrame, max_depth: int = 32) -> DataFrame:
    """(root, id): the subgraph of each batch (``batches``: id), over edges in both directions.

    It begins at the batch and at all nodes that name it (columns batch_id, dataset_id or scan_id of ``nodes``). Other datasets
    and batches are not entered, nor nodes whose batch_id or dataset_id is another; contributors are entered but not left.
    """
    with passing(edges.sparkSession):
        area, words = batch_area(edges, nodes, batches, max_depth)
        return in_blocks(words, lambda within: each_root(area(within), within(words)).select("root", "id"), keep=1)


def digest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: graph digest, over the digests of buckets of rows in order, so that no task holds the graph."""
    rows = nodes.select(F.concat_ws("|", F.lit("n"), "id", "node_type").alias("t")).union(edges.select(F.concat_ws("|", F.lit("e"), "source_id", "target_id", "edge_type")))
    hashed = rows.select(F.sha2("t", 256).alias("h"))
    buckets = hashed.groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("graph_digest"))


def build(wide: DataFrame, nodes: list[tuple[str, str]], edges: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (column, type) and edges (source column, target column, type) of wide rows of ids; missing ids leave theirs out."""
    n = F.array(*[F.struct(F.col(c).alias("id"), F.lit(t).alias("node_type")) for c, t in nodes])
    e = F.array(*[F.struct(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(t).alias("edge_type")) for a, b, t in edges])
    return wide.select(F.inline(n)).where("id is not null").distinct(), wide.select(F.inline(e)).where("source_id is not null and target_id is not null").distinct()


def contributor_risk(edges: DataFrame, nodes: DataFrame, severity_of: DataFrame, properties: DataFrame) -> DataFrame:
    """Risk of every contributor from the findings on it, on what it provided, on that's samples, and on the models and runs downstream.

    ``severity_of`` (evidence, severity) and ``properties`` (id, contributor_id, sample_count) describe nodes: a dataset is its
    contributor's by an edge or by its property, and has as many samples as its property or its CONTAINS_SAMPLE edges say,
    whichever is more. Penalties are damped by the logarithm of the samples; a quarantine of anything in reach and critical
    findings set floors.
    """
    with passing(edges.sparkSession):
        edges, nodes = cut(edges), cut(nodes)
        out = _risks(edges, nodes, severity_of, properties)
        return cut(out, keep=1)


def toward(steps: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """The steps (src, dst) on ways of at most ``max_depth`` steps to one of ``targets`` (id)."""
    near = new = cut(targets.select("id").distinct())
    for _ in range(max_depth - 1):
        before = steps.join(new.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        new = cut(before.join(near, "id", "left_anti"))
        if new.isEmpty():
            break
        near = near.union(new)
    return steps.join(near.select(F.col("id").alias("dst")), "dst", "left_semi")


def _risks(edges: DataFrame, nodes: DataFrame, severity_of: DataFrame, properties: DataFrame) -> DataFrame:
    """:func:`contributor_risk` within :func:`passing`. Only what has evidence or is quarantined tells anything of a contributor, so ways
    that lead to neither are not followed."""
    people = nodes.where("node_type = 'CONTRIBUTOR'").select("id")
    dealt_with = edges.where("edge_type in ('AUTHORED_BY', 'PROVIDED')")
    typed = _typed(dealt_with, nodes)
    given = typed.where("edge_type in ('AUTHORED_BY', 'PROVIDED') and target_type = 'CONTRIBUTOR'").select(F.col("target_id").alias("who"), F.col("source_id").alias("id"))
    given = given.union(typed.where("edge_type = 'PROVIDED' and source_type = 'CONTRIBUTOR'").select(F.col("source_id").alias("who"), F.col("target_id").alias("id")))
    owned = properties.where("contributor_id is not null").join(nodes.where("node_type in ('DATASET', 'DATASET_BATCH')").select("id"), "id", "left_semi")
    given = cut(given.union(owned.select(F.col("contributor_id").alias("who"), "id")).distinct())
    held = edges.where("edge_type = 'CONTAINS_SAMPLE'").select(F.col("source_id").alias("id"), F.col("target_id").alias("sample"))
    words = words_of(people)
    own = given.join(words.withColumnRenamed("root", "who"), "who").groupBy("word", "id").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    own = cut(own)
    evidence = cut(attached(edges, nodes))
    stops = cut(edges.where("edge_type = 'QUARANTINES'").select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct())
    telling = cut(evidence.select("id").union(stops).distinct())
    made = telling.join(nodes.where("node_type in ('MODEL', 'MODEL_VERSION', 'TRAINING_RUN')").select("id"), "id", "left_semi")
    with passing(edges.sparkSession):
        made = cut(made, keep=1)
        ends = fans(cut(toward(all_steps(edges, nodes, downstream=True), made)), keep=1)
    trained = edges.where("edge_type = 'TRAINED_ON'").select(F.col("target_id").alias("id"), F.col("source_id").alias("other"))
    others = cut(trained.union(held.withColumnRenamed("sample", "other")).join(telling.withColumnRenamed("id", "other"), "other", "left_semi").select("id", "other").distinct())

    def marks(within: Callable[[DataFrame], DataFrame]) -> DataFrame:
        mine, roots = within(own), within(words)
        below = spread(ends, mine).where("depth > 0").join(made, "id", "left_semi").select("word", "id", "mask")
        of_given = mine.join(others, "id").select("word", F.col("other").alias("id"), "mask")
        near = mine.union(seeded(roots).select("word", "id", "mask")).join(telling, "id", "left_semi").select("word", "id", "mask")
        reach = cut(once(near.union(of_given).union(below)))
        found = once(reach.join(evidence, "id"), "evidence").join(severity_of, "evidence", "left").withColumn("sev", F.coalesce("severity", F.lit("LOW")))
        stopped = counted(reach.join(stops, "id", "left_semi"), roots, "n").select(F.lit(None).cast("string").alias("sev"), "root", "n")
        return counted(found, roots, "n", "sev").select("sev", "root", "n").union(stopped)

    marked = in_blocks(words, marks, first=64).withColumnRenamed("root", "who")
    found, stopped = marked.where("sev is not null"), marked.where("sev is null").select("who", F.lit(True).alias("held"))
    sizes = given.join(held.groupBy("id").agg(F.count("*").alias("_edges")), "id", "left").join(properties.select("id", "sample_count"), "id", "left")
    size = sizes.groupBy("who").agg(F.sum(F.greatest(F.coalesce("_edges", F.lit(0)), F.coalesce("sample_count", F.lit(0)))).alias("samples"), F.count("*").alias("datasets"))
    weight = lookup(F.col("sev"), {"CRITICAL": 0.35, "HIGH": 0.20, "MEDIUM": 0.08, "LOW": 0.02}, 0.02)
    g = found.groupBy("who").agg(F.sum("n").alias("findings"), F.sum(F.when(F.col("sev") == "CRITICAL", F.col("n")).otherwise(0)).alias("critical"), F.sum(F.col("n") * weight).alias("penalty"))
    out = people.withColumnRenamed("id", "who").join(size, "who", "left").join(g, "who", "left").join(stopped, "who", "left").na.fill(0)
    raw = F.col("penalty") / F.greatest(F.lit(1.0), F.log1p(F.col("samples").cast("double")))
    floor = F.when(F.coalesce("held", F.lit(False)), 0.85).when(F.col("critical") >= 2, 0.75).when(F.col("critical") == 1, 0.40).otherwise(0.0)
    risk = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw, floor)), 4)
    return out.select(F.col("who").alias("contributor"), "datasets", "samples", "findings", "critical", risk.alias("risk")).withColumn("status", tier(F.col("risk"), [(0.70, "QUARANTINED"), (0.30, "UNDER_REVIEW")], "ACCEPTED"))
