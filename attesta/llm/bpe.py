"""Byte-level BPE as a deterministic automaton over tokens, built by one merge gadget after another.

The automaton starts with one state and a loop for every byte. The gadget of a merge ``u v -> w``

* splits off the state that ``u`` leads to, and drops from it the arc ``v``;
* adds an arc ``w`` beside every arc ``u``, which leads where ``v`` leads.

After the last gadget exactly the right encodings are accepted: a path spells a text's bytes, and its arc labels are the
tokens. All arcs of a token lead to one state, so states are named by the last token. A split-off state differs from its
source by one arc and a new arc set from its source by none, so the arcs of all states are kept in shared form: three numbers a
gadget (left part, right part, rank), and one table of dropped arcs. The labels are compiled into a table of bytes (a trie), so
that a run over many words at once is a few lookups in arrays for each byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import sealed, slices, text_of, trimmed, unsealed
from attesta.llm.vocab import SPLIT_PATTERN, ByteVocab

#: Arcs that a worker remembers, a power of two: they cost time, never results.
ARCS = 1 << 20
#: Texts that are encoded at once, words that run at once, and the longest of those.
ROWS, WORDS, LONG = 4096, 1 << 16, 64

#: White space beyond ASCII: patterns may look across from there to where ASCII white space begins.
_OTHER_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WORDS = regex.compile(SPLIT_PATTERN)
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)


def _byte_kinds() -> np.ndarray:
    """What the split pattern tells apart in ASCII; an apostrophe and bytes beyond ASCII need the pattern itself."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[[*range(65, 91), *range(97, 123)]] = _LETTER
    kinds[48:58] = _DIGIT
    kinds[[32, *range(9, 14)]] = _SPACE
    kinds[[ord("'"), *range(0x1C, 0x20), *range(128, 256)]] = _HARD
    return kinds


_KINDS = _byte_kinds()


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``begin`` and have ``size`` members, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each one begins (with the end of the last)."""
    _, offsets, data = texts.cast(pa.binary()).buffers()
    edge = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, edge - edge[0]


def pieces_of(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """The parts of ``raw`` that begin at ``at`` (with the end of the last)."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def chunked(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut where ASCII white space begins, and the first chunk of each text (with the number of chunks at the end).

    No alternative of the split pattern looks across such a place in a text without other white space.
    """
    raw, edge = raw_bytes(texts)
    space = _KINDS[raw] == _SPACE
    begins = np.zeros(len(raw) + 1, bool)
    begins[1:-1] = space[1:] & ~space[:-1]
    begins[edge] = True
    at = np.flatnonzero(begins)
    return pieces_of(raw, at), np.searchsorted(at, edge)


def split_words(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all chunks, and the first word of each chunk (with the number of words at the end).

    A chunk of ASCII without apostrophes that begins with one blank at most is cut where the kind of character changes; the
    pattern itself cuts the others.
    """
    raw, edge = raw_bytes(chunks)
    kind = _KINDS[raw]
    size = np.diff(edge)
    hard = np.zeros(len(size), bool)
    of = np.repeat(np.arange(len(size)), size)
    hard[of[kind == _HARD]] = True
    first = np.zeros(len(raw) + 1, bool)
    first[edge] = True
    spaced = kind == _SPACE
    hard[of[spaced & ~(first[:-1] & (raw == 32))]] = True
    hard[of[spaced & first[1:]]] = True
    begins = first.copy()
    begins[1:-1] |= (kind[1:] != kind[:-1]) & ~spaced[:-1]
    if hard.any():
        begins[:-1] &= ~hard[of] | first[:-1]
        for k in np.flatnonzero(hard).tolist():
            at = int(edge[k])
            for w in _WORDS.findall(chunks[k].as_py().decode()):
                begins[at] = True
                at += len(w.encode())
    at = np.flatnonzero(begins)
    return pieces_of(raw, at), np.searchsorted(at, edge)


class MergeAutomaton:
    def __init__(self, path: str):
        vocab = ByteVocab(path)
        self.label = vocab.label
        self.special = vocab.special
        self.width = np.array([len(x) for x in self.label], np.int64)
        size = len(self.label)
        #: Tokens in memory.
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._compile(vocab)
        self.left, self.right, self.rank = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        u, v, w = np.array(vocab.merges, np.int64).reshape(-1, 3).T
        rank = np.arange(len(w))
        # the gadgets, in order: each renames an arc's source, and drops one arc
        self.left[w], self.right[w], self.rank[w] = u, v, rank
        order = np.argsort(u << 32 | v)
        self.dropped, self.dropped_rank = (u << 32 | v)[order], rank[order].astype(np.int32)
        reached = self.arcs(u, v, rank).tolist()
        atomic = [True] * size
        for a, b, c, ok in zip(u.tolist(), v.tolist(), w.tolist(), reached, strict=True):
            atomic[c] = ok and atomic[a] and atomic[b]
        #: Whether a token's own gadget is ever reached: its parts' states have the arc until then.
        self.atomic = np.array(atomic)
        self.known, self.holds = np.full(ARCS, -1, np.int64), np.zeros(ARCS, bool)
        self.by_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.rare = re.compile("|".join([_OTHER_SPACE, *map(re.escape, self.special)]))

    def _compile(self, vocab: ByteVocab) -> None:
        """Labels to a table: ``child[256 * node + byte]`` (0: none) and the token that a node spells (-1: none).

        Nodes from ``leaves`` on have no children, nor rows of the table.
        """
        inner = dict.fromkeys(label[:k] for label in vocab.id_of for k in range(len(label)))
        nodes = {x: n for n, x in enumerate([*inner, *(x for x in vocab.id_of if x not in inner)])}
        self.leaves = len(inner)
        self.child = np.zeros(256 * len(inner), np.int32)
        self.child[[256 * nodes[x[:-1]] + x[-1] for x in nodes if x]] = [n for x, n in nodes.items() if x]
        self.token = np.full(len(nodes), -1, np.int32)
        self.token[[nodes[x] for x in vocab.id_of]] = list(vocab.id_of.values())

    def arcs(self, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether the states after tokens ``a`` have arcs ``b`` after the gadgets below ``before``.

        A new state takes its arcs from the right part, as they were before its gadget; a new arc goes beside those of the left
        part that the gadget left in place.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b, before = a.astype(np.int64), b.astype(np.int64), before.astype(np.int64)
        while len(at):
            key = a << 32 | b
            k = np.minimum(np.searchsorted(self.dropped, key), len(self.dropped) - 1)
            cut = (self.dropped[k] == key) & (self.dropped_rank[k] < before) if len(self.dropped) else np.zeros(len(at), bool)
            ok[at[cut]] = False
            ra, rb = self.rank[a], self.rank[b]
            state, arc = ra > rb, rb >= 0
            before = np.minimum(before, np.where(state, ra, rb + 1))
            a, b = np.where(state, self.right[a], a), np.where(~state & arc, self.left[b], b)
            on = ~cut & (state | arc)
            at, a, b, before = at[on], a[on], b[on], before[on]
        return ok

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`arcs` after all gadgets, of the beginning (-1) too; what was looked up lately is read off a table."""
        key = a.astype(np.int64) << 32 | b
        slot = (key * 0x9E3779B97F4A7C1 >> 40) & (ARCS - 1)
        new = np.flatnonzero(self.known[slot] != key)
        ok = self.holds[slot]
        if len(new):
            one, back = np.unique(key[new], return_inverse=True)
            x, y = one >> 32, one & 0xFFFFFFFF
            good = self.atomic[y]
            inner = np.flatnonzero((x >= 0) & good)
            good[inner] = self.arcs(x[inner], y[inner], np.full(len(inner), len(self.dropped) + 1))
            ok[new] = good[back]
            self.known[slot[new]] = key[new]
            self.holds[slot[new]] = ok[new]
            # of keys that share a slot the last one is in it: its own value goes with it
            self.holds[slot[new]] = good[np.searchsorted(one, self.known[slot[new]])]
        return ok

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The labels of the one path that spells each word: all tokens, and how many each word has.

        Every beginning of a word has exactly one accepted path, so a run forward settles the state after each byte: from a
        settled state all arcs whose labels come next are taken, and no position is settled twice. All words run together.
        """
        raw, edge = raw_bytes(words)
        size = np.diff(edge)
        order = np.argsort(-size, kind="stable")
        begin, size = edge[:-1][order], size[order]
        last = np.full(len(raw) + len(size) + 1, -1, np.int32)  # the state before a word's first byte, then after each byte
        base = begin + order
        taken = np.bincount(size, minlength=2)
        more = len(size) - np.cumsum(taken)  # words longer than so many bytes
        for i in range(len(taken) - 1):
            n = int(more[i])
            at, node = np.arange(n), np.zeros(n, np.int32)
            a = last[base[:n] + i]
            for end in range(i + 1, len(taken)):
                node = self.child[node.astype(np.int64) * 256 + raw[begin[at] + end - 1]]
                on = node > 0
                at, node = at[on], node[on]
                if not len(at):
                    break
                b = self.token[node]
                free = np.flatnonzero((b >= 0) & (last[base[at] + end] < 0))
                if len(free):
                    ok = free[self._allowed(a[at[free]], b[free])]
                    last[base[at[ok]] + end] = b[ok]
                on = (size[at] > end) & (node < self.leaves)
                at, node = at[on], node[on]
        # backwards along the path: tokens stand at the positions where they end
        ends = np.zeros(len(last), bool)
        at, here = np.flatnonzero(size), size[size > 0]
        while len(at):
            pos = base[at] + here
            ends[pos] = True
            here = here - self.width[last[pos]]
            at, here = at[here > 0], here[here > 0]
        found = np.flatnonzero(ends)
        first = np.searchsorted(found, np.append(edge[:-1] + np.arange(len(size)), len(last)))
        return last[found].astype(self.kind), np.diff(first)

    def _long(self, data: bytes) -> np.ndarray:
        """:meth:`spell` for one long word, byte by byte."""
        n, child, token = len(data), self.child.item, self.token.item
        last = [-1] * (n + 1)
        known: dict[tuple[int, int], bool] = {}
        for i in range(n):
            node = 0
            for end in range(i + 1, n + 1):
                node = child(256 * node + data[end - 1])
                if not node:
                    break
                b = token(node)
                if b >= 0 and last[end] < 0:
                    key = (last[i], b)
                    if key not in known:
                        known[key] = bool(self._allowed(np.array([last[i]]), np.array([b]))[0])
                    if known[key]:
                        last[end] = b
                if node >= self.leaves:
                    break
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(self.label[last[end]])
        return np.array(out[::-1], self.kind)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, and how many each has; each distinct word runs once."""
        found = words.dictionary_encode()
        kinds = found.dictionary
        size = np.diff(raw_bytes(kinds)[1])
        long = np.flatnonzero(size > LONG)
        short = np.flatnonzero(size <= LONG)
        parts, counts = [], np.zeros(len(kinds), np.int64)
        for lo in range(0, len(short), WORDS):
            some = short[lo : lo + WORDS]
            ids, counts[some] = self.spell(kinds.take(pa.array(some)))
            parts.append(ids)
        for k in long.tolist():
            parts.append(self._long(kinds[k].as_py()))
            counts[k] = len(parts[-1])
        flat = np.concatenate([np.zeros(0, self.kind), *parts])
        begin = np.zeros(len(kinds), np.int64)
        ordered = np.concatenate([short, long])
        begin[ordered] = np.cumsum(counts[ordered]) - counts[ordered]
        at = found.indices.to_numpy()
        return flat[ragged(begin[at], counts[at])], counts[at]

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, one text after the other, and where each one's begin (with the end of the last).

        Texts are cut where white space begins, and each distinct chunk is cut into words once; texts with special strings or
        with white space beyond ASCII are cut by the pattern as a whole. Special strings are special tokens.
        """
        odd = [i for i, t in enumerate(texts.to_pylist()) if self.rare.search(t)]
        if not odd:
            return self._plain(texts)
        is_odd = np.zeros(len(texts), bool)
        is_odd[odd] = True
        ids, ends = self._plain(texts.filter(pa.array(~is_odd)))
        parts = [self._whole(texts[i].as_py()) for i in odd]
        size = np.zeros(len(texts), np.int64)
        size[~is_odd] = np.diff(ends)
        size[odd] = [len(p) for p in parts]
        out = np.empty(int(size.sum()), self.kind)
        out[np.repeat(~is_odd, size)] = ids
        out[np.repeat(is_odd, size)] = np.concatenate(parts)
        return out, np.concatenate(([0], np.cumsum(size)))

    def _whole(self, text: str) -> np.ndarray:
        parts = [text] if self.by_special is None else self.by_special.split(text)
        words = [w if p in self.special else w.encode() for p in parts for w in ([p] if p in self.special else _WORDS.findall(p))]
        plain = pa.array([w for w in words if isinstance(w, bytes)], pa.binary())
        ids, counts = self._words(plain)
        if len(plain) == len(words):
            return ids
        own = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(plain) else [])
        return np.concatenate([next(own) if isinstance(w, bytes) else np.array([self.special[w]], self.kind) for w in words])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks, first = chunked(texts)
        found = chunks.dictionary_encode()
        words, first_word = split_words(found.dictionary)
        flat, counts = self._words(words)
        ends = np.concatenate(([0], np.cumsum(counts)))[first_word]
        begin, size = ends[:-1], np.diff(ends)
        at = found.indices.to_numpy()
        return flat[ragged(begin[at], size[at])], np.concatenate(([0], np.cumsum(size[at])))[first]

    def encode(self, text: str) -> list[int]:
        return self.tokens(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The labels along the path."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    """One automaton per Python worker and vocabulary."""
    return MergeAutomaton(path)


def encode(docs: DataFrame, tokenizer: str, *, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Adds ``ids_col`` (array<int>): the tokens of every whole text, without added special tokens.

    Null and empty texts have an empty list. Every row gives one row; other columns stay.
    """
    docs, named = sealed(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton(tokenizer).tokens
        for batch in slices(batches, ROWS):
            found, begins = tokens(batch.column(len(names)))
            ids = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*names, "_ids"])

    source = docs.select("*", text_of(named[text_col]).alias("_to_encode"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return unsealed(source.mapInArrow(trimmed(run), f"{kept}, _ids array<int>"), named, {ids_col: "_ids"})


def decode(rows: DataFrame, tokenizer: str, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``: the text that the tokens of ``ids_col`` spell; a null list spells the empty text."""
    rows, named = sealed(rows)
    names, at = rows.columns, rows.columns.index(named[ids_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = automaton(tokenizer).decode
        for batch in slices(batches):
            text = pa.array([decode(i or []) for i in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*names, "_decoded"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return unsealed(rows.mapInArrow(trimmed(run), f"{kept}, _decoded string"), named, {text_col: "_decoded"})


def round_trip(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text and returns digests only: id, n_tokens, ids_sha256, decoded_sha256.

    The digests are those of the decimal ids joined by commas and of the decoded text. Null reads as empty; repeated rows
    give repeated results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(tokenizer)
        shown = [str(i) for i in range(len(a.label))]
        for batch in slices(batches, ROWS):
            found, begins = a.tokens(batch.column(1))
            ids_sha, text_sha = [], []
            for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                ids = found[lo:hi].tolist()
                ids_sha.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(a.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(np.diff(begins)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
