"""SimHash near-duplicates: a self-join of binary tries over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import first_rows, order_of, sealed, text_of, unsealed
from attesta.operators.components import connected_components
from attesta.plans.lineage import cut, shuffle_partitions

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_U = np.uint64
#: Pairs of trie nodes that are held at once.
FRONTIER = 1 << 20
#: A pair of nodes with at most so many pairs of leaves is compared leaf by leaf.
LEAVES = 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority of the bits of the hashes of all word shingles, repeats included; 0 without words."""
    words = lowered(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), repeat(42))
    return majority(np.fromiter(hashes, np.uint64, len(words) - shingle + 1))


def lowered(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode().translate(_LOWER).split()


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, shingle: int = 3, text_col: str = "text", out_col: str = "_fp") -> DataFrame:
    """``docs`` with ``out_col``: the fingerprint of the whole text as a signed 64-bit number. Null reads as empty."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(len(names)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], [*names, out_col])

    source = docs.select("*", text_of(f"`{text_col}`").alias("_to_hash"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return source.mapInArrow(run, f"{kept}, `{out_col}` long")


def _halves(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """For sorted ``keys``: where the bit turns from 0 to 1 in each range whose keys agree above it."""
    one = _U(1) << bit.astype(_U)
    first = keys[lo] & ~(one - _U(1)) | one
    return np.clip(np.searchsorted(keys, first), lo, hi)


def _portions(*nodes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of nodes in portions of about ``FRONTIER`` pairs of leaves; a larger pair of nodes in rows."""
    a0, a1, b0, b1 = nodes
    n = (a1 - a0) * (b1 - b0)
    big = n > FRONTIER
    for k in np.flatnonzero(big).tolist():
        rows = max(1, FRONTIER // int(b1[k] - b0[k]))
        for at in range(int(a0[k]), int(a1[k]), rows):
            yield np.array([at]), np.array([min(at + rows, int(a1[k]))]), b0[k : k + 1], b1[k : k + 1]
    a0, a1, b0, b1, n = (x[~big] for x in (a0, a1, b0, b1, n))
    if not len(n):
        return
    edge = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), FRONTIER))
    for lo, hi in zip(edge, [*edge[1:], len(n)], strict=True):
        if lo < hi:
            yield a0[lo:hi], a1[lo:hi], b0[lo:hi], b1[lo:hi]


def trie_links(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, budget: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of keys at ``budget`` or fewer differing bits, from traversing pairs of trie nodes together.

    ``keys`` is sorted; a node is a range of it whose keys share their upper ``depth`` bits. A pair of nodes starts at the same
    node and carries the bits that differ so far; its four (or, at one node, three) pairs of children carry one more where the
    branches differ, and go no further beyond the budget. With ``group``, only keys of different groups link, and nodes that are
    of one group are not entered. Keys may repeat.
    """
    changes = None if group is None else np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))
    stack = [(lo, hi, lo, hi, depth, np.zeros(len(lo), np.int8))]
    while stack:
        a0, a1, b0, b1, d, e = stack.pop()
        if len(a0) > FRONTIER:
            stack += [tuple(x[i : i + FRONTIER] for x in (a0, a1, b0, b1, d, e)) for i in range(0, len(a0), FRONTIER)]
            continue
        leaf = ((a1 - a0) * (b1 - b0) <= LEAVES) | (d >= 64)
        for x0, x1, y0, y1 in _portions(a0[leaf], a1[leaf], b0[leaf], b1[leaf]):
            n = (x1 - x0) * (y1 - y0)
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            width = (y1 - y0)[of]
            i, j = x0[of] + k // width, y0[of] + k % width
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if group is not None:
                near &= group[i] != group[j]
            if near.any():
                yield i[near], j[near]
        rest = ~leaf
        if not rest.any():
            continue
        a0, a1, b0, b1, d, e = (x[rest] for x in (a0, a1, b0, b1, d, e))
        am, bm = _halves(keys, a0, a1, 63 - d), _halves(keys, b0, b1, 63 - d)
        same = a0 == b0
        d = d + 1
        parts = [(a0, am, b0, bm, d, e), (am, a1, bm, b1, d, e), (a0, am, bm, b1, d, e + 1), (*(x[~same] for x in (am, a1, b0, bm, d)), e[~same] + 1)]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        alive = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[5] <= budget)
        if changes is not None and alive.any():
            joined = [x[alive] for x in joined]
            p0, p1, q0, q1 = joined[:4]
            alive = (changes[p0] != changes[p1 - 1]) | (changes[q0] != changes[q1 - 1]) | (group[p0] != group[q0])
        if alive.any():
            stack.append(tuple(x[alive] for x in joined))


def roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that links reach, for each of ``n`` positions."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def turns_of(budget: int, agree: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The orders of the fingerprint's blocks, each with ``agree`` of them on top: (shift, width) from the top down, and bits on top.

    With ``budget + agree`` blocks, two fingerprints that link agree in ``agree`` blocks at least.
    """
    blocks = budget + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for top in combinations(range(blocks), agree):
        order = [parts[k] for k in top] + [parts[k] for k in range(blocks) if k not in top]
        out.append((order, sum(w for _, w in order[:agree])))
    return out


def turned(fp: Column, order: list[tuple[int, int]]) -> Column:
    """A fingerprint with its blocks in another order."""
    key, at = F.lit(0).cast("long"), 64
    for shift, width in order:
        at -= width
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")), at))
    return key


def near_links(prints: DataFrame, fp_col: str, *, budget: int = 3, agree: int | None = None) -> DataFrame:
    """Edges ``(u, v)`` that connect what links connect: distinct fingerprints with ``budget`` or fewer differing bits.

    Fingerprints are cut into ``budget + agree`` blocks (``agree``: 1, and 2 beyond 3 bits). Two that link agree in ``agree``
    blocks at least, so each choice of these is turned to the top in one trie, of which the node pairs without a difference
    over the top are its equal values: these are the keys of one shuffle. Below them the trie is joined with itself. Only the
    edges of a spanning forest leave a task, never all pairs of a group.
    """
    turns = turns_of(budget, agree or (1 if budget <= 3 else 2))
    distinct = prints.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()

    keys = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(top).alias("bits"), turned(F.col("fp"), order).alias("key")) for k, (order, top) in enumerate(turns)])
    rows = distinct.select(F.inline(keys)).withColumn("top", F.expr("shiftrightunsigned(key, 64 - bits)"))
    n = shuffle_partitions(prints.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        turn = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in got])
        key = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in got]).view(np.uint64)
        for k in np.unique(turn):
            order, bits = turns[k]
            keys = np.sort(key[turn == k])
            top = keys >> _U(64 - bits)
            lo = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
            hi = np.append(lo[1:], len(keys))
            more = hi - lo > 1
            root = roots(len(keys), trie_links(keys, lo[more], hi[more], np.full(int(more.sum()), bits), budget))
            at = np.flatnonzero(root != np.arange(len(keys)))
            if len(at):
                yield pa.record_batch([pa.array(back(keys[at], order)), pa.array(back(keys[root[at]], order))], ["u", "v"])

    return rows.repartition(n, "turn", "top").select("turn", "key").mapInArrow(join, "u long, v long")


def back(keys: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints from turned keys."""
    out, at = np.zeros(len(keys), np.uint64), 64
    for shift, width in order:
        at -= width
        out |= ((keys >> _U(at)) & _U((1 << width) - 1)) << _U(shift)
    return out.view(np.int64)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, budget: int = 3, drop_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_fp`` and ``_component``: the smallest id that links reach, itself included.

    Fingerprints link at ``budget`` or fewer differing bits; equal ones always do, and texts without words all have 0. Null ids
    stay out of components' names unless nothing else is there. Repeated rows are members of one component; an empty table gives
    an empty result. Members of a group are aggregated before they are shuffled, and links run between fingerprints only.
    With ``drop_text`` the texts are not carried along.
    """
    docs, named = sealed(docs)
    out = _grouped(docs, shingle, budget, drop_text, named[id_col], named[text_col])
    return unsealed(out, named, {"_fp": "_fp", "_component": "_component"})


def _grouped(docs: DataFrame, shingle: int, budget: int, drop_text: bool, id_col: str, text_col: str) -> DataFrame:
    rows = fingerprints(docs, shingle=shingle, text_col=text_col)
    if drop_text:
        rows = cut(rows.drop(text_col))
    # texts are hashed twice rather than written
    prints = rows if drop_text else cut(rows.select(id_col, "_fp"))
    own = prints.groupBy("_fp").agg(F.min(id_col).alias("_least"))
    members = _components(prints, budget).join(own, F.col("node") == F.col("_fp"))
    label = members.groupBy("component").agg(F.min("_least").alias("_label"))
    linked = members.join(label, "component").select(F.col("node").alias("_fp"), "_label")
    named = cut(own.join(linked, "_fp", "left").select("_fp", F.coalesce("_label", "_least").alias("_component")))
    return rows.join(named, "_fp")


def _components(prints: DataFrame, budget: int) -> DataFrame:
    """``(node, component)``: the smallest fingerprint that links reach, for each that links."""
    return connected_components(cut(near_links(prints, "_fp", budget=budget)), "u", "v")


def deduplicate(docs: DataFrame, *, shingle: int = 3, budget: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id (null ids last, then by the text's hash); repeated rows of it leave one.

    Groups are keyed by their smallest fingerprint, so null and repeated ids join no groups.
    """
    docs, named = sealed(docs)
    ident, text = named[id_col], named[text_col]
    hashed = docs.select(F.col(ident).alias("_id"), F.xxhash64(text_of(f"`{text}`")).alias("_h"), F.col(text).alias("_t"))
    prints = cut(fingerprints(hashed, shingle=shingle, text_col="_t").drop("_t"))
    own = prints.groupBy("_fp").agg(F.min(order_of("_id", "_h")).alias("best"))
    found = own.join(_components(prints, budget), F.col("node") == F.col("_fp"), "left")
    first = found.groupBy(F.coalesce("component", "_fp").alias("g")).agg(F.min("best").alias("best"))
    return unsealed(first_rows(docs, first.select(F.col("best.id").alias("_id"), F.col("best.h").alias("_h")), ident, text), named)
