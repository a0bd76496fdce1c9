"""Near-duplicates by SimHash with an exact check: the trie self-join finds the candidates, their shingle sets decide.

Fingerprints are taken over a text's distinct words: an edit changes one word of a set, but five shingles of five words, so the
fingerprints of texts that are alike in 0.8 of their five-word shingles stay within :data:`BUDGET` bits far more often.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import first_rows, order_of, row_key, sealed, text_of, trimmed, unsealed
from attesta.llm.simhash import back, lowered, majority, roots, trie_links, turns_of
from attesta.operators.components import connected_components
from attesta.plans.lineage import cut, shuffle_partitions

_U = np.uint64
#: Differing bits at which texts are compared.
BUDGET = 8
#: Rows that a shuffle key of the trie should hold, and rows beyond which a key's rows all count as candidates at first.
SHARE, CROWD = 256, 4096
#: Shingles of a block of sets, of the columns that are multiplied at once, and pairs that a task holds before it sends them.
BLOCK, COLUMNS, HOLD = 1 << 16, 1 << 12, 1 << 20


def _written(df: DataFrame) -> DataFrame:
    """:func:`cut`, and the driver's garbage collected: else shuffle files that nothing needs any more stay on the disks."""
    out = cut(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def word_hashes(text: str) -> np.ndarray:
    words = lowered(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))


def shingles(words: np.ndarray, shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of all word shingles, sorted; of all words, where there are fewer; none without words."""
    k = min(shingle, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) + words[i : len(words) - k + 1 + i]
        h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB)
    return np.unique(h ^ (h >> _U(31)))


def _signed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(_id, _h, fp, sig, n)`` for each row: hash of the text, fingerprint of its words, hash and size of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, sig, n = (np.zeros(batch.num_rows, np.uint64) for _ in range(3))
            for k, t in enumerate(batch.column(2).to_pylist()):
                words = word_hashes(t)
                s = shingles(words, shingle)
                fp[k], sig[k], n[k] = majority(np.unique(words)), xxhash.xxh64_intdigest(s.tobytes(), 7), len(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x.view(np.int64)) for x in (fp, sig, n))], ["_id", "_h", "fp", "sig", "n"])

    text = text_of(f"`{text_col}`")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_t")).mapInArrow(trimmed(run), f"_id {kind}, _h long, fp long, sig long, n long")


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> np.ndarray | None:
    got = [b for b in batches if b.num_rows]
    return np.stack([np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for b in got]) for c in names]) if got else None


def _by_turn(batches: Iterator[pa.RecordBatch], turns: list, names: list[str]) -> Iterator[tuple]:
    """Each turn's rows, sorted by turned fingerprint: turn, keys, the other columns, and the ranges that agree on top."""
    rows = _columns(batches, ["turn", "key", *names])
    if rows is None:
        return
    for k in np.unique(rows[0]).tolist():
        own = rows[1:, rows[0] == k]
        own = own[:, np.argsort(own[0].view(np.uint64), kind="stable")]
        keys = own[0].view(np.uint64)
        top = keys >> _U(64 - turns[k][1])
        lo = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
        hi = np.append(lo[1:], len(keys))
        more = hi - lo > 1
        yield k, keys, own[1:], lo[more], hi[more]


def _alike(percent: int, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sizes of two sets allow them to be similar enough."""
    return percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])


def _first_partners(turns: list, budget: int, percent: int):
    """For each row with candidates its nearest one, and that of the smallest fingerprint: ``(v, u, ufp, bits)``.

    In a crowd only the neighbour before and the first of all are looked at, and every row counts as one with candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, keys, (sig, n), lo, hi in _by_turn(batches, turns, ["sig", "n"]):
            size = len(keys)
            fp = back(keys, turns[k][0])
            order = np.argsort(fp.view(np.uint64), kind="stable")
            place = np.empty(size, np.int64)
            place[order] = np.arange(size)
            nearest, least = np.full(size, 1 << 62), np.full(size, size)
            crowd = hi - lo > CROWD
            members = np.concatenate([np.zeros(0, np.int64), *(np.arange(a + 1, b) for a, b in zip(lo[crowd], hi[crowd], strict=True))])
            heads = np.repeat(lo[crowd], (hi - lo)[crowd] - 1)
            near = np.bitwise_count(keys[members] ^ keys[members - 1]) <= budget
            head = np.bitwise_count(keys[members] ^ keys[heads]) <= budget
            found = [(members[near] - 1, members[near]), (heads[head], members[head])]
            depth = np.full(int((~crowd).sum()), turns[k][1])
            for i, j in [*found, *trie_links(keys, lo[~crowd], hi[~crowd], depth, budget)]:
                ok = _alike(percent, n, i, j)
                i, j = i[ok], j[ok]
                bits = np.bitwise_count(keys[i] ^ keys[j]).astype(np.int64)
                for a, b in ((i, j), (j, i)):
                    np.minimum.at(nearest, a, bits << 32 | b)
                    np.minimum.at(least, a, place[b])
            v = np.flatnonzero(nearest < 1 << 62)
            u = nearest[v] & 0xFFFFFFFF
            w = np.flatnonzero(least < size)
            x = order[least[w]]
            alone = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(lo[crowd], hi[crowd], strict=True))])
            a, b = np.concatenate([v, w, alone]), np.concatenate([u, x, alone])
            if len(a):
                bits = np.bitwise_count(keys[a] ^ keys[b]).astype(np.int64)
                bits[len(v) + len(w) :] = 99  # not nearer than a partner
                yield pa.record_batch([pa.array(sig[a]), pa.array(sig[b]), pa.array(fp[b]), pa.array(bits)], ["v", "u", "ufp", "bits"])

    return run


def _other_blocks(turns: list, budget: int, percent: int):
    """Pairs of blocks ``(bu, bv)`` between which, or in which, there are candidates of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [np.zeros((2, 0), np.int64)], 0
        for k, keys, (_, n, comp, block), lo, hi in _by_turn(batches, turns, ["sig", "n", "comp", "block"]):
            for i, j in trie_links(keys, lo, hi, np.full(len(lo), turns[k][1]), budget, comp):
                ok = _alike(percent, n, i, j)
                held.append(np.sort(np.stack([block[i[ok]], block[j[ok]]]), axis=0))
                count += held[-1].shape[1]
                if count >= HOLD:
                    held = [np.unique(np.concatenate(held, axis=1), axis=1)]
                    count = held[0].shape[1]
        two = np.unique(np.concatenate(held, axis=1), axis=1)
        if two.shape[1]:
            yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in two], ["bu", "bv"])

    return run


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(sig, shingles)`` from ``(sig, _t)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(word_hashes(t), shingle).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["sig", "shingles"])

    return docs.mapInArrow(trimmed(run), "sig long, shingles array<long>")


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many members the sets ``i`` and ``j`` share, for each pair: pair by pair, or, where there are many, by multiplying
    the 0/1 rows of the sets over the members that several sets have."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left, right = np.unique(i), np.unique(j)
    found = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, [at, at + COLUMNS])
        marks = np.zeros((len(sets), COLUMNS), np.float32)
        marks[row[lo:hi], col[lo:hi] - at] = 1
        found += marks[left] @ marks[right].T
    return found[np.searchsorted(left, i), np.searchsorted(right, j)].astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows to one table for each pair of blocks."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        bu, bv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = [0, *(np.flatnonzero((bu[1:] != bu[:-1]) | (bv[1:] != bv[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edge, edge[1:], strict=False):
            if lo == hi:
                continue
            if held and key != (bu[lo], bv[lo]):
                yield pa.Table.from_batches(held)
                held = []
            key = (bu[lo], bv[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _linked(percent: int, sig: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of sets that are similar enough, edges that connect the same: one a set at most."""
    n = np.array([len(s) for s in sets], np.int64)
    both = overlaps(sets, i, j)
    ok = 100 * both >= percent * (n[i] + n[j] - both)
    root = roots(len(sets), iter([(i[ok], j[ok])]))
    at = np.flatnonzero(root != np.arange(len(sets)))
    return sig[at], sig[root[at]]


def _of_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = pa.concat_arrays(column.chunks) if column.num_chunks > 1 else column.chunk(0)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _verified(percent: int, budget: int):
    """Each two blocks' sets, and the pairs to compare or none, to edges that connect what similar ones do.

    Without pairs, all of different components are compared whose fingerprints are close and whose sizes allow it.
    """

    def candidates(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fp, n, comp, block = (table[c].to_numpy() for c in ("fp", "n", "comp", "block"))
        bu = table["bu"][0].as_py()
        left, right = np.flatnonzero(block == bu), np.flatnonzero(block != bu)
        right = right if len(right) else left
        found = [(left[:0], left[:0])]
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            near = np.bitwise_count(fp[some, None].view(np.uint64) ^ fp[None, right].view(np.uint64)) <= budget
            i, j = np.nonzero(near & (comp[some, None] != comp[None, right]))
            i, j = some[i], right[j]
            ok = _alike(percent, n, i, j) & ((block[i] != block[j]) | (i < j))
            found.append((i[ok], j[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sig = table["sig"].to_numpy()
        order = np.argsort(sig)
        place = lambda x: order[np.searchsorted(sig[order], x)]
        asked = table["asked"].combine_chunks()
        own = np.repeat(np.arange(len(sig)), np.diff(asked.offsets.to_numpy()))
        return own, place(asked.values.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for table in _groups(batches):
            table = table.combine_chunks()
            i, j = pairs(table) if "asked" in table.column_names else candidates(table)
            if len(i):
                x, y = _linked(percent, table["sig"].to_numpy(), _of_lists(table["shingles"]), i, j)
                u.append(x)
                v.append(y)
            if len(u) >= 1024:
                yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])
                u, v = [], []
        if u:
            yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return run


def _compared(rows: DataFrame, percent: int, budget: int) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    return _written(rows.repartition(n, "bu", "bv").sortWithinPartitions("bu", "bv").mapInArrow(trimmed(_verified(percent, budget)), "u long, v long"))


def _similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int, budget: int) -> DataFrame:
    """Edges that connect what those of the pairs ``(u, v, bu, bv)`` do whose sets are similar enough: shared shingles of all
    shingles. A set is sent once for each two blocks that have a pair with it."""
    ends = pairs.select("bu", "bv", F.col("u").alias("sig"), F.col("v").alias("other")).union(pairs.select("bu", "bv", "v", F.lit(None).cast("long")))
    asked = ends.groupBy("bu", "bv", "sig").agg(F.collect_set("other").alias("asked"))
    return _compared(asked.join(sets, "sig").select("bu", "bv", "sig", "asked", "shingles"), percent, budget)


def _similar_blocks(blocks: DataFrame, rows: DataFrame, sets: DataFrame, percent: int, budget: int) -> DataFrame:
    """Edges that connect what all similar sets of different components in the pairs of ``blocks`` ``(bu, bv)`` do."""
    members = rows.join(sets, "sig")
    sent = blocks.select("bu", "bv", F.explode(F.array_distinct(F.array("bu", "bv"))).alias("block")).join(members, "block")
    return _compared(sent.select("bu", "bv", "sig", "fp", "n", "comp", "block", "shingles"), percent, budget)


def _turned_rows(own: DataFrame, turns: list, *more: str) -> DataFrame:
    """A row for each turn of each fingerprint, where those meet that agree on top.

    Fingerprints are turned in the tasks: as expressions, hundreds of turns would make a plan that fills the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, (order, bits) in enumerate(turns):
                keys, at = np.zeros(len(fp), np.uint64), 64
                for shift, width in order:
                    at -= width
                    keys |= ((fp >> _U(shift)) & _U((1 << width) - 1)) << _U(at)
                made = (np.full(len(fp), k, np.int32), keys.view(np.int64), (keys >> _U(64 - bits)).view(np.int64))
                yield pa.RecordBatch.from_arrays([*map(pa.array, made), *batch.columns[1:]], ["turn", "key", "top", *rest])

    rest = ["sig", "n", *more]
    kept = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in rest)
    rows = own.select("fp", *rest).mapInArrow(run, f"turn int, key long, top long, {kept}")
    return rows.repartition(shuffle_partitions(own.sparkSession), "turn", "top").select("turn", "key", *rest)


def turns_for(rows: int, budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Turns with so many blocks on top that a key has about :data:`SHARE` of ``rows`` rows. It decides the cost only, never a result."""
    agree = next((a for a in range(1, budget) if rows >> min(64 * a // (budget + a), 62) <= SHARE), budget)
    return turns_of(budget, agree)


def near_links(own: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, budget: int) -> DataFrame:
    """Edges ``(u, v)`` between shingle sets of fingerprints within ``budget`` bits whose exact similarity is ``percent`` or
    more; they connect what all such pairs connect.

    First each set is compared with its nearest candidate and with that of the smallest fingerprint, a count in proportion to
    the rows; then all candidates that the first links do not join yet, block by block: a block holds sets that lead to one
    smallest fingerprint, up to a bounded size. Pairs never leave a task, and a large group of near copies that the first links
    join is not compared pair by pair.
    """
    turns = turns_for(own.count(), budget)
    partners = _written(_turned_rows(own, turns).mapInArrow(trimmed(_first_partners(turns, budget, percent)), "v long, u long, ufp long, bits long"))
    chosen = partners.groupBy("v").agg(F.min(F.struct("bits", "u")).alias("near"), F.min(F.struct("ufp", "u")).alias("least"))
    labelled = own.join(chosen, F.col("sig") == F.col("v")).select("sig", "fp", "n", "best", F.least("fp", "least.ufp").alias("label"), F.col("near.u").alias("near"), F.col("least.u").alias("least"))
    labelled = _written(labelled)
    for _ in range(2):  # a label is a fingerprint, which has a label
        up = labelled.groupBy(F.col("fp").alias("label")).agg(F.min("label").alias("_up"))
        labelled = labelled.join(up, "label", "left").withColumn("label", F.coalesce("_up", "label")).drop("_up")
    labelled = _written(labelled)
    parts = labelled.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    company = _written(labelled.join(parts, "label").withColumn("block", F.xxhash64("label", F.expr("pmod(sig, greatest(parts, 1))"))).drop("label", "parts"))
    wanted = company.select("sig", row_key("best.id", "best.h").alias("_row"))
    text = text_of(f"`{text_col}`")
    rows = docs.select(row_key(id_col, F.xxhash64(text)).alias("_row"), text.alias("_t")).join(wanted, "_row").dropDuplicates(["_row"]).select("sig", "_t")
    sets = _written(_sets(rows, shingle))
    of = company.select("sig", "block")
    first = company.select(F.col("sig").alias("v"), F.explode(F.array_distinct(F.array("near", "least"))).alias("u")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = first.join(of.select(F.col("sig").alias("u"), F.col("block").alias("bu")), "u").join(of.select(F.col("sig").alias("v"), F.col("block").alias("bv")), "v")
    links = _similar_pairs(first, sets, percent, budget)
    joined = connected_components(links, "u", "v").withColumnRenamed("node", "sig")
    rest = _written(company.join(joined, "sig", "left").select("sig", "fp", "n", F.coalesce("component", "sig").alias("comp"), "block"))
    blocks = _written(_turned_rows(rest, turns, "comp", "block").mapInArrow(trimmed(_other_blocks(turns, budget, percent)), "bu long, bv long")).distinct()
    return links.union(_similar_blocks(blocks, rest, sets, percent, budget))


def deduplicate(docs: DataFrame, *, shingle: int = 5, percent: int = 80, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id (null ids last, then by the text's hash).

    Texts link if the SimHashes of their words are within ``budget`` bits and their exact similarity is ``percent`` or more: the
    word shingles that both have, of those that either has; ASCII letters in lower case. Groups are what links connect. Texts
    with one set of shingles are one group, as are all texts without words. Ids name no group: rows with null or repeated ids
    are grouped by their texts alone.
    """
    docs, named = sealed(docs)
    ident, text = named[id_col], named[text_col]
    signed = _written(_signed(docs, ident, text, shingle))
    own = _written(signed.groupBy("sig").agg(F.first("fp").alias("fp"), F.max("n").alias("n"), F.min(order_of("_id", "_h")).alias("best")))
    links = near_links(own, docs, ident, text, shingle, percent, budget)
    groups = connected_components(links, "u", "v").withColumnRenamed("node", "sig")
    first = own.join(groups, "sig", "left").groupBy(F.coalesce("component", "sig").alias("g")).agg(F.min("best").alias("best"))
    return unsealed(first_rows(docs, first.select(F.col("best.id").alias("_id"), F.col("best.h").alias("_h")), ident, text), named)
