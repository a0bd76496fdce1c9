"""Chat formatting over a prefix tree: turns that conversations share at their beginning are emitted once.

A node of the tree is a run of first turns; its key is a running hash. Every node is owned by the smallest conversation that
passes through it, so a conversation owns a chain of nodes that hangs on another's chain. Depth-first, a chain comes first and
then what branches off it, deepest first: chains are contiguous, and what a turn attends to is one interval for each chain on
its way to the root.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.bpe import automaton
from attesta.plans.lineage import cut, shuffle_partitions

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Strings that have a meaning in chat templates; a backslash keeps them apart inside texts.
CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])|<(?=<SYS>>|</SYS>>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text stands in it."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to nodes: one running hash a conversation, kept from batch to batch."""
    conv, key, depth = object(), b"", 0
    for batch in batches:
        out = []
        for c, role, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if c != conv:
                conv, key, depth = c, b"", 0
            key = hashlib.blake2b(b"%s\0%d\0%s%s" % (key, len(role), role.encode(), text.encode()), digest_size=16).digest()
            out.append((c, depth, key.hex(), role, text))
            depth += 1
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], ["conv", "depth", "node", "role", "text"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, with owners: those that the conversation owns, with the branches on the way to its chain."""
    conv, path = object(), []
    for batch in batches:
        rows = {n: [] for n in ("node", "chain", "depth", "way")}
        for c, depth, node, owner in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if c != conv:
                conv, path = c, []
            if not path or path[-1]["owner"] != owner:
                path = [*path, {"up": -depth, "owner": owner}]
            if owner == c:
                rows["node"].append(node)
                rows["chain"].append(c)
                rows["depth"].append(depth)
                rows["way"].append(path)
        way = pa.list_(pa.struct([("up", pa.int32()), ("owner", pa.int64())]))
        yield pa.record_batch([pa.array(rows["node"], pa.string()), pa.array(rows["chain"], pa.int64()), pa.array(rows["depth"], pa.int32()), pa.array(rows["way"], way)], list(rows))


def _formatted(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton(tokenizer).tokens
        total = 0
        for batch in batches:
            roles = batch.column("role").to_pylist()
            cut = [segment(r, t) for r, t in zip(roles, batch.column("text").to_pylist(), strict=True)]
            segments = pa.array([s for s, _, _ in cut], pa.string())
            ids, begins = tokens(segments)
            said = [(a, b) if r == "assistant" else (0, 0) for r, (_, a, b) in zip(roles, cut, strict=True)]
            new = [
                segments, pa.array([a for a, _ in said], pa.int32()), pa.array([b for _, b in said], pa.int32()),
                pa.ListArray.from_arrays(pa.array(begins.astype("int32")), pa.array(ids.astype("int32"))), pa.array(total + begins[:-1]),
            ]
            total += len(ids)
            kept = ["node", "chain", "depth", "way", "role", "part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "segment", "loss_begin", "loss_end", "token_ids", "local"])

    return run


class Packed:
    """``stream``: the emitted turns in depth-first order. ``turns``: which node stands for each turn of each conversation."""

    def __init__(self, stream: DataFrame, turns: DataFrame):
        self.stream, self.turns = stream, turns


def pack(conversations: DataFrame, tokenizer: str, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Packed:
    """Merges conversations with equal first turns into prefix trees and emits each shared turn once.

    Turns are ordered by number (null first), role and text; null roles and texts are empty; a null conversation id is a
    conversation of its own. Columns of ``stream``: node, chain (the owner), depth, role, segment (formatted text),
    loss_begin/loss_end (code points of the segment under the loss mask: an assistant's text), token_ids, begin/end (tokens in
    the stream), position (position id of the first token: tokens on the way from the root), attends (intervals of the stream
    before this turn that its tokens see, oldest first; within the turn attention is causal). Other columns are not read.
    A conversation streams through one task turn by turn; popular first turns only meet in joins and sums that can be split.
    """
    spark = conversations.sparkSession
    n = shuffle_partitions(spark)
    least = -(1 << 63)
    rows = conversations.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(least)).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition(n, "conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    turns = cut(ordered.mapInArrow(_keyed, "conv long, depth int, node string, role string, text string"))
    owners = turns.groupBy("node").agg(F.min("conv").alias("owner"))
    owned = turns.select("conv", "depth", "node").join(owners, "node").repartition(n, "conv").sortWithinPartitions("conv", "depth")
    way = "array<struct<up:int,owner:bigint>>"
    chains = cut(owned.select("conv", "depth", "node", "owner").mapInArrow(_chained, f"node string, chain long, depth int, way {way}"))
    nodes = chains.join(turns.select(F.col("conv").alias("chain"), "depth", "role", "text"), ["chain", "depth"])
    sorted_ = nodes.repartitionByRange(n, "way", "depth").sortWithinPartitions("way", "depth").withColumn("part", F.spark_partition_id())
    emitted = cut(sorted_.select("node", "chain", "depth", "way", "role", "text", "part").mapInArrow(_formatted(tokenizer), f"node string, chain long, depth int, way {way}, role string, part int, segment string, loss_begin int, loss_end int, token_ids array<int>, local long"))
    # one row for each part of the stream: where it begins
    base = emitted.groupBy("part").agg(F.sum(F.size("token_ids")).alias("size"))
    base = base.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    placed = emitted.join(base, "part").withColumn("begin", F.col("base") + F.col("local")).withColumn("end", F.col("begin") + F.size("token_ids"))
    ends = placed.select("chain", "depth", "end")
    first = placed.groupBy("chain").agg(F.min("begin").alias("chain_begin"))
    # the chains above each chain, and the last turn of each that it sees
    heads = chains.groupBy("chain").agg(F.first("way").alias("way"))
    above = heads.select("chain", F.explode(F.expr("transform(slice(way, 1, size(way) - 1), (x, i) -> named_struct('above', x.owner, 'until', -way[i + 1].up - 1))")).alias("x")).select("chain", "x.above", "x.until")
    seen = above.join(ends.withColumnsRenamed({"chain": "above", "depth": "until"}), ["above", "until"]).join(first.withColumnsRenamed({"chain": "above", "chain_begin": "begin"}), "above")
    seen = seen.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("seen"), F.sum(F.col("end") - F.col("begin")).alias("before"))
    stream = placed.join(first, "chain").join(seen, "chain", "left")
    inside = F.when(F.col("begin") > F.col("chain_begin"), F.array(F.struct(F.col("chain_begin").alias("begin"), F.col("begin").alias("end")))).otherwise(F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"))
    stream = stream.select(
        "node", "chain", "depth", "role", "segment", "loss_begin", "loss_end", "token_ids", "begin", "end",
        (F.coalesce("before", F.lit(0)) + F.col("begin") - F.col("chain_begin")).alias("position"),
        F.concat(F.coalesce("seen", F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")), inside).alias("attends"),
    )
    return Packed(stream, turns.select(F.when(F.col("conv") != least, F.col("conv")).alias("conv"), "depth", "node"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted turns in order to one row a conversation, read back from the formatted text."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    state = None

    def close() -> None:
        conv, n, turns, chars, loss, size = state
        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for batch in batches:
        for conv, s, a, b in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(s):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            lost = unescape(s[a:b])
            state[3] += len(lost)
            state[4].update(lost.encode())
            state[5] += len(s)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done.clear()
    if state is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)


def read_back(packed: Packed) -> DataFrame:
    """One row a conversation, from the emitted stream: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    n = shuffle_partitions(packed.stream.sparkSession)
    rows = packed.turns.join(packed.stream.select("node", "segment", "loss_begin", "loss_end"), "node")
    ordered = rows.repartition(n, "conv").sortWithinPartitions("conv", "depth").select("conv", "segment", "loss_begin", "loss_end")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
