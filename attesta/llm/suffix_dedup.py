"""Removing repeated byte strings with a distributed, sampled suffix array.

A suffix array of all positions is far larger than the corpus, so suffixes are sampled: each run of ``length`` bytes picks the
positions (anchors) whose ``length // 2`` bytes have its smallest hash. Equal runs pick equal anchors, wherever they stand. So

1. anchors are shuffled by hash; an anchor whose whole surroundings occur earlier is done with, all bytes around it repeat;
2. of the other anchors with company, the surroundings are fetched from the texts and shuffled by the same hash;
3. there, the runs around anchors are sorted as suffixes: multikey quicksort to a shallow depth, and blind tries for the groups
   that still agree; runs that agree over their whole length repeat, but for the first of them;
4. the repeated ranges go back to the texts.

Everything that is shuffled is keyed by a hash and sized by the input; nothing but the number of bytes reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import bucket_count, sealed, trimmed, unsealed

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1
#: Bytes of text that are hashed at once, and anchors that are held before they are sent.
PIECE, HOLD = 1 << 20, 1 << 20
#: Bytes that the multikey quicksort looks at before blind tries take over.
SHALLOW = 32
#: Runs that are sorted at once.
RUNS = 1 << 18

_ROWS = "bucket int, kind int, h binary, c binary, d binary, g binary, p binary, q binary"
_NAMES = ["bucket", "kind", "h", "c", "d", "g", "p", "q"]
_ANCHORS, _RANGES = 0, 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * _U(step)
        step = step * step & _WORD
        done *= 2
    return out


class _Hasher:
    """Hashes of any byte range of a buffer, from prefix sums modulo 2**64."""

    up = _powers(_BASE, 1)
    down = _powers(pow(_BASE, -1, 1 << 64), 1)

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if len(_Hasher.up) < n:
            size = max(n, PIECE + 1024)
            _Hasher.up, _Hasher.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + _U(1)) * _Hasher.up[: n - 1], out=self.sums[1:])

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * _Hasher.down[lo])

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:-k]) * _Hasher.down[:n])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """``best`` over each ``w`` neighbours."""
    k = 1
    while 2 * k <= w:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: -(w - k)], x[w - k :]) if w > k else x


def anchors(pieces: list[tuple[bytes, int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the runs that start in ``[begin, end)`` of each piece: piece, position, hash, and hash of its surroundings."""
    k = length // 2
    w = length - k + 1
    size = np.array([len(p) for p, _, _ in pieces])
    stop = np.cumsum(size)
    start = stop - size
    raw = np.frombuffer(b"".join([p for p, _, _ in pieces]), np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    hasher = _Hasher(raw)
    h = hasher.every(k)
    at = np.arange(len(h))
    of = np.repeat(np.arange(len(pieces)), size)
    whole = stop[of[: len(h)]] - at >= k
    h[~whole] = _U(_WORD)
    least = _slide(h, w, np.minimum)
    first = (start + np.array([b for _, b, _ in pieces]))[of[: len(least)]]
    last = (start + np.array([e for _, _, e in pieces]))[of[: len(least)]]
    begins = at[: len(least)]
    least[(begins < first) | (begins >= last)] = 0
    edge = np.zeros(w - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), w, np.maximum)[: len(h)]
    p = np.flatnonzero((most == h) & whole)
    piece = of[p]
    lo, hi = np.maximum(p - (w - 1), start[piece]), np.minimum(p + length, stop[piece])
    shape = (p - lo).astype(np.uint64) << _U(32) | (hi - p).astype(np.uint64)
    return piece, p - start[piece], h[p], _mix(hasher.ranges(lo, hi) + shape * _U(_BASE))


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[bytes, int, int]], list[tuple[int, int]]]]:
    """Texts in groups of about ``PIECE`` bytes; a longer text in parts that overlap, so that each run and its surroundings are whole in one."""
    group, origin, held = [], [], 0
    for i, t in enumerate(texts):
        runs = len(t) - length + 1
        for s in range(0, max(runs, 0), PIECE):
            lo, hi = max(0, s - 2 * length), min(len(t), s + PIECE + 3 * length)
            group.append((t[lo:hi], s - lo, min(s + PIECE, runs) - lo))
            origin.append((i, lo))
            held += hi - lo
            if held >= PIECE:
                yield group, origin
                group, origin, held = [], [], 0
    if group:
        yield group, origin


def merge_ranges(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of each ``of``, in order; touching ranges become one."""
    if not len(of):
        return of, lo, hi
    order = np.lexsort((lo, of))
    of, lo, hi = of[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
    wide = int(hi.max()) + 2
    reach = np.maximum.accumulate(of * wide + hi)
    new = np.concatenate(([True], (of * wide + lo)[1:] > reach[:-1]))
    end = np.append(np.flatnonzero(new)[1:], len(of)) - 1
    return of[new], lo[new], reach[end] - of[end] * wide


def _row(bucket: int, kind: int, *arrays: np.ndarray) -> list:
    return [int(bucket), kind, *[x.tobytes() for x in arrays], *[b""] * (6 - len(arrays))]


def _batch(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], _NAMES)


def _gather(rows: list[dict], *types: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join([r[n] for r in rows]), t) for n, t in zip(_NAMES[2:], types, strict=False)]


def _by_bucket(bucket: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[list]:
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edge):
        if len(part):
            yield _row(bucket[part[0]], kind, *[a[part] for a in arrays])


def _spread(n: int, d: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The bucket of a text: Spark's ``pmod(xxhash64(_key, _dg), n)``. Copies of a text under other ids go elsewhere."""
    p1, p2, p3, p4, p5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: x << _U(k) | x >> _U(64 - k)
    x = np.full(len(d), 42, np.uint64)
    for value in (d, g):
        x = x + p5 + _U(8) ^ turn(value.view(np.uint64) * p2, 31) * p1
        x = turn(x, 27) * p1 + p4
        x = (x ^ x >> _U(33)) * p2
        x = (x ^ x >> _U(29)) * p3
        x = x ^ x >> _U(32)
    return np.mod(x.view(np.int64), n)


def _range_rows(n: int, d: np.ndarray, g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[list]:
    """Ranges to the buckets of their texts."""
    none = np.zeros((len(d), 0), np.uint8)
    yield from _by_bucket(_spread(n, d, g), _RANGES, none, none, d, g, lo.astype(np.uint32), hi.astype(np.uint32))


def _find_anchors(n: int, length: int):
    """Texts to anchors by hash; of anchors with the same surroundings, only the first of a task is sent."""
    w = length - length // 2 + 1

    def flush(held: list) -> pa.RecordBatch | None:
        d, g, p, size, h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((p, g, d, h ^ c * _U(_BASE)))
        d, g, p, size, h, c = (x[order] for x in (d, g, p, size, h, c))
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])))
        again[1:] &= (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1])
        rows = []
        if again.any():
            _, one, number = np.unique(_text_key(d[again], g[again]), return_index=True, return_inverse=True)
            of, lo, hi = merge_ranges(number, np.maximum(p[again] - (w - 1), 0), np.minimum(p[again] + length, size[again]))
            rows += _range_rows(n, d[again][one[of]], g[again][one[of]], lo, hi)
        sent = ~again
        bucket = ((h >> _U(32)) % _U(n)).astype(np.int64)
        rows += _by_bucket(bucket[sent], _ANCHORS, h[sent].astype(np.uint32), c[sent], d[sent], g[sent], p[sent].astype(np.uint32))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            d, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            size = np.array([len(t) for t in texts], np.int64)
            for group, origin in _pieces(texts, length):
                piece, p, h, c = anchors(group, length)
                of = np.array([i for i, _ in origin])[piece]
                held.append((d[of], g[of], p + np.array([lo for _, lo in origin])[piece], size[of], h, c))
                count += len(p)
                if count >= HOLD:
                    yield flush(held)
                    held, count = [], 0
        if count:
            yield flush(held)

    return run


def _partition_rows(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            out.setdefault(r["bucket"], []).append(r)
    return out


def _match_anchors(n: int, length: int):
    """Anchors of a hash bucket to ranges that repeat as a whole, and to anchors whose surroundings must be compared."""
    w = length - length // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _partition_rows(batches).items():
            out = [list(r.values()) for r in rows if r["kind"] == _RANGES]
            h, c, d, g, p = _gather([r for r in rows if r["kind"] == _ANCHORS], np.uint32, np.uint64, np.int64, np.int64, np.uint32)
            if len(h):
                s = np.sort(h)
                company = np.isin(h, s[1:][s[1:] == s[:-1]])
                h, c, d, g, p = (x[company] for x in (h, c, d, g, p))
            if len(h):
                order = np.lexsort((p, g, d, c, h))
                h, c, d, g, p = (x[order] for x in (h, c, d, g, p))
                new_h = np.concatenate(([True], h[1:] != h[:-1]))
                new = new_h | np.concatenate(([True], c[1:] != c[:-1]))
                first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                later = (d != d[first]) | (g != g[first]) | (p != p[first])
                kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
                low = np.maximum(p.astype(np.int64) - (w - 1), 0)
                out += _range_rows(n, d[later], g[later], low[later], p[later].astype(np.int64) + length)
                asked = new & (kinds > 1)
                out += _by_bucket(_spread(n, d[asked], g[asked]), _ANCHORS, h[asked], np.full(int(asked.sum()), bucket, np.uint32), d[asked], g[asked], p[asked])
            if out:
                yield _batch(out)

    return run


def _lookup(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key = _text_key(table.column("_key").to_numpy(), table.column("_dg").to_numpy())
    order = np.argsort(key, kind="stable")
    return key[order], order


def _text_key(d: np.ndarray, g: np.ndarray) -> np.ndarray:
    return _mix(d.view(np.uint64) * _U(_BASE)) + g.view(np.uint64)


def _fetch(n: int, length: int, text_col: str):
    """Texts and what is asked of them to surroundings by hash; ranges are merged on the way."""
    w = length - length // 2 + 1
    wide = w - 1 + length

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        out: list[list] = []
        if texts.num_rows and rows:
            keys, order = _lookup(texts)
            data = [t or b"" for t in texts.column(text_col).cast(pa.binary()).to_pylist()]
            _, _, d, g, lo, hi = _gather([r for r in rows if r["kind"] == _RANGES], np.uint8, np.uint8, np.int64, np.int64, np.uint32, np.uint32)
            if len(d):
                i = order[np.searchsorted(keys, _text_key(d, g))]
                size = np.array([len(t) for t in data])
                of, lo, hi = merge_ranges(i, lo, np.minimum(hi, size[i]))
                out += _range_rows(n, texts.column("_key").to_numpy()[of], texts.column("_dg").to_numpy()[of], lo, hi)
            h, b, d, g, p = _gather([r for r in rows if r["kind"] == _ANCHORS], np.uint32, np.uint32, np.int64, np.int64, np.uint32)
            if len(h):
                i = order[np.searchsorted(keys, _text_key(d, g))]
                around = np.zeros((len(h), wide + 4), np.uint8)
                pad = bytes(wide)
                for k, (row, at) in enumerate(zip(i.tolist(), p.tolist(), strict=True)):
                    t = data[row]
                    before, after = min(at, w - 1), min(len(t) - at, length)
                    around[k] = np.frombuffer(pad[: w - 1 - before] + t[at - before : at + after] + pad[: length - after] + before.to_bytes(2, "little") + after.to_bytes(2, "little"), np.uint8)
                out += _by_bucket(b.astype(np.int64), _ANCHORS, h, around.reshape(len(h), -1), d, g, p)
        return pa.Table.from_batches([_batch(out)]) if out else pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(x, pa.binary()) for x in _NAMES[2:]]]).empty_table()

    return run


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of ``keys`` (the first one counts most), the number of each one's group, and whether it has company."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.cumsum(new)
    return order, number, np.bincount(number)[number] > 1


def _leaders(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of sorted ``group`` begins, and its size."""
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return begin, np.diff(np.append(begin, len(group)))


def _quick(at: np.ndarray, group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One digit of multikey quicksort over all groups at once; members and groups of those that still agree with another one.

    Each round takes the digit in the middle of every group as its pivot and parts the group in three: what equals the pivot is
    done with this digit, what is below and above goes on by itself, and what is left alone has no equal.
    """
    done_at, done_group, base = [at[:0]], [group[:0]], 0
    while len(at):
        begin, size = _leaders(group)
        pivot = np.repeat(digit[begin + size // 2], size)
        side = (digit > pivot).astype(np.int8) - (digit < pivot)
        order, number, company = _numbered(group, side)
        same = company & (side[order] == 0)
        done_at.append(at[order[same]])
        done_group.append(number[same] + base)
        base += int(number[-1]) + 1
        rest = order[company & ~same]
        at, group, digit = at[rest], number[company & ~same], digit[rest]
    at, group = np.concatenate(done_at), np.concatenate(done_group)
    order = np.argsort(group, kind="stable")
    return at[order], group[order]


def _digit(runs: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes from column ``depth`` of each run, as a number; zeros beyond the end."""
    part = np.zeros((len(runs), 8), np.uint8)
    got = runs[:, depth : depth + 8]
    part[:, : got.shape[1]] = got
    return part.view(">u8").ravel().astype(np.uint64)


def deep_shallow(runs: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts equally long byte runs within groups; returns those that equal another run of their group, and numbers of equal ones.

    Multikey quicksort with digits of eight bytes down to ``shallow`` bytes: only runs that still agree go on. Then blind tries:
    a group's first run is a path, and every other run leaves it at the branching node where the two first differ, by the
    character that it has there; what leaves at one node by one character is the next, smaller trie. What never leaves is equal.
    """
    n, length = runs.shape
    order, number, company = _numbered(group)
    at, group = order[company], number[company]
    for depth in range(0, min(shallow, length), 8):
        if not len(at):
            break
        at, group = _quick(at, group, _digit(runs[at], depth))
    done_at, done_group, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(at):
        begin, size = _leaders(group)
        differ = runs[at] != runs[np.repeat(at[begin], size)]
        node = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        branch = runs[at, np.minimum(node, length - 1)]
        branch[node == length] = 0
        order, number, company = _numbered(group, node, branch)
        equal = company & (node[order] == length)
        done_at.append(at[order[equal]])
        done_group.append(number[equal] + base)
        base += int(number[-1]) + 1
        at, group = at[order[company & ~equal]], number[company & ~equal]
    return np.concatenate(done_at), np.concatenate(done_group)


def _sort_runs(n: int, length: int):
    """Surroundings of a hash bucket to the ranges of runs that occur earlier."""
    w = length - length // 2 + 1
    wide = w - 1 + length

    def repeats(h: np.ndarray, around: np.ndarray, rank: np.ndarray, p: np.ndarray, backs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and starts of repeated runs that begin ``backs`` before their anchors; ``h`` is sorted."""
        before = around[:, wide].astype(np.int64) + 256 * around[:, wide + 1].astype(np.int64)
        after = around[:, wide + 2].astype(np.int64) + 256 * around[:, wide + 3].astype(np.int64)
        windows = sliding_window_view(around[:, :wide], length, axis=1)
        group = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64))))
        row, back = np.divmod(np.arange(len(h) * len(backs)), len(backs))
        back = backs[back]
        there = (back <= before[row]) & (length - back <= after[row])
        row, back = row[there], back[there]
        runs = np.ascontiguousarray(windows[row, w - 1 - back])
        at, same = deep_shallow(runs, group[row] * w + back)
        order = np.lexsort((rank[row[at]], same))
        at, same = at[order], same[order]
        new = np.concatenate(([True], same[1:] != same[:-1]))[: len(at)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        later = at[rank[row[at]] > rank[row[at[first]]]]
        return row[later], p[row[later]] - back[later]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _partition_rows(batches).values():
            out = [list(r.values()) for r in rows if r["kind"] == _RANGES]
            h, around, d, g, p = _gather([r for r in rows if r["kind"] == _ANCHORS], np.uint32, np.uint8, np.int64, np.int64, np.uint32)
            order = np.lexsort((p, g, d, h))
            h, around, d, g, p = h[order], around.reshape(len(h), wide + 4)[order], d[order], g[order], p[order].astype(np.int64)
            # within a hash, rows stand in the order of documents and positions
            step = np.ones(len(h), np.int64)
            step[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1])
            rank = np.cumsum(step)
            edge = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else [], len(h)).astype(np.int64)
            lo = 0
            while lo < len(h):
                hi = int(edge[max(np.searchsorted(edge, lo + RUNS // w, side="right") - 1, np.searchsorted(edge, lo, side="right"))])
                # runs of other offsets are never equal as suffixes of one anchor: a hot hash is sorted by few offsets at a time
                step = max(1, RUNS // (hi - lo))
                found = [repeats(h[lo:hi], around[lo:hi], rank[lo:hi], p[lo:hi], np.arange(k, min(k + step, w))) for k in range(0, w, step)]
                row, s = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(row):
                    row, s, e = merge_ranges(row, s, s + length)
                    out += _range_rows(n, d[lo + row], g[lo + row], s, e)
                lo = hi
            if out:
                yield _batch(out)

    return run


def _apply(text_col: str, names: list[str], shown: list[str], digest: bool):
    """Texts and their repeated ranges to what is left."""

    def run(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        data = [t or b"" for t in texts.column(text_col).cast(pa.binary()).to_pylist()] if texts.num_rows else []
        cut: list[list[tuple[int, int]]] = []
        own = np.zeros(len(data), np.int64)
        if data and ranges.num_rows:
            _, _, d, g, lo, hi = _gather(ranges.to_pylist(), np.uint8, np.uint8, np.int64, np.int64, np.uint32, np.uint32)
            keys, number = np.unique(_text_key(d, g), return_inverse=True)
            of, lo, hi = merge_ranges(number, lo, hi)
            edge = np.searchsorted(of, np.arange(len(keys) + 1)).tolist()
            runs = list(zip(lo.tolist(), hi.tolist(), strict=True))
            cut = [runs[a:b] for a, b in zip(edge, edge[1:], strict=False)]
            mine = _text_key(texts.column("_key").to_numpy(), texts.column("_dg").to_numpy())
            own = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            own = np.where(keys[own] == mine, own, len(keys))
        cut.append([])
        removed, spans, left = [], [], []
        for i, t in enumerate(data):
            runs = [(a, min(b, len(t))) for a, b in cut[own[i]]]
            at, parts = 0, []
            for a, b in runs:
                parts.append(t[at:a])
                at = b
            parts.append(t[at:])
            left.append(b"".join(parts))
            removed.append(len(t) - len(left[-1]))
            spans.append(len(runs))
        cols = {name: texts.column(name) for name in names}
        if digest:
            cols["_kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())
        else:
            was = texts.column(text_col).to_pylist() if texts.num_rows else []
            cols[text_col] = pa.array([t.decode("utf-8", errors="ignore") if n else w for t, n, w in zip(left, spans, was, strict=True)], pa.string())
        cols |= {"_n_bytes": pa.array([len(t) for t in data], pa.int64()), "_n_removed": pa.array(removed, pa.int64()), "_n_spans": pa.array(spans, pa.int64())}
        return pa.table([cols[c] for c in shown], names=shown)

    return run


def remove_repeats(docs: DataFrame, *, length: int = 100, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every byte removed that a ``length``-byte string covers which also starts earlier.

    Earlier is: in a text of a smaller id (null ids come last; texts of one id follow their hash), or in the same text at an
    earlier start. Strings are judged on the input and overlaps count. Repeated rows, alike in id and text, are one text: each
    keeps what the first keeps. New columns: ``_n_bytes``, ``_n_removed``, ``_n_spans`` (maximal removed runs). Other columns
    stay. With ``digest``, ``_kept_sha256`` (hex digest of the remaining bytes) stands in the text's place; without it the text
    is what remains, less characters that were cut apart. A text without repeats stays as it is, null included.
    """
    docs, named = sealed(docs)
    out = _remove(docs, length, digest, named[id_col], named[text_col])
    new = ["_n_bytes", "_n_removed", "_n_spans", *["_kept_sha256"] * digest]
    return unsealed(out, named, dict(zip(new, new, strict=True)))


def _remove(docs: DataFrame, length: int, digest: bool, id_col: str, text_col: str) -> DataFrame:
    n = bucket_count(docs, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)).alias("_key"), F.xxhash64(text).alias("_dg"), *[F.col(f"`{c}`") for c in docs.columns])
    texts = keyed.select(F.expr(f"cast(pmod(xxhash64(_key, _dg), {n}) as int)").alias("_bucket"), "*").groupBy("_bucket")
    found = keyed.select("_key", "_dg", text.alias("_text")).mapInArrow(trimmed(_find_anchors(n, length)), _ROWS)
    matched = found.repartition(n, "bucket").mapInArrow(trimmed(_match_anchors(n, length)), _ROWS)
    around = texts.cogroup(matched.groupBy("bucket")).applyInArrow(_fetch(n, length, text_col), _ROWS)
    ranges = around.repartition(n, "bucket").mapInArrow(trimmed(_sort_runs(n, length)), _ROWS)
    names = [c for c in docs.columns if not digest or c != text_col]
    new = "`_kept_sha256` string, " if digest else ""
    out = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", {new}_n_bytes long, _n_removed long, _n_spans long"
    shape = docs.sparkSession.createDataFrame([], out).schema
    return texts.cogroup(ranges.groupBy("bucket")).applyInArrow(_apply(text_col, [c for c in names if c != text_col], shape.names, digest), shape)


def deduplicate(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeats cut out of the texts; ``n_chars``, where there is one, follows the text. No row goes."""
    docs, named = sealed(docs)
    out = _remove(docs, length, False, named[id_col], named[text_col])
    if "n_chars" in named:
        size = named["n_chars"]
        out = out.withColumn(size, F.when(F.col("_n_removed") > 0, F.length(named[text_col])).otherwise(F.col(size)).cast(docs.schema[size].dataType))
    return unsealed(out, named)
