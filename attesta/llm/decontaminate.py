"""Benchmark decontamination with a generalised suffix automaton of item words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import sealed, text_of, unsealed
from attesta.plans.lineage import cut

#: Words are runs of bytes other than ASCII bytes that are neither digits nor letters; A-Z reads as a-z.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD_BYTE = np.array([b != 0x20 for b in _FOLD])


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class SuffixAutomaton:
    """Accepts every run of consecutive words of any item; built word by word, with one shared root. Items have any sortable names."""

    def __init__(self, items: list[tuple[str | int, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[tuple[str | int, list[int]]] = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            state = 0
            for c in ids:
                state = self._extend(state, c)
            ends.append((item, ids))
        self._mark(ends)

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def _mark(self, items: list[tuple[str | int, list[int]]]) -> None:
        """Which items hold a state's window, and which short items are whole at a state."""
        n, w = len(self.next), self.window
        self.items: dict[int, set[str | int]] = {}
        self.short: dict[int, list[tuple[int, str | int]]] = {}
        for item, ids in items:
            state = 0
            for c in ids:
                state = self.next[state][c]
                at = state
                while at > 0 and self.length[at] >= w and item not in self.items.setdefault(at, set()):
                    self.items[at].add(item)
                    at = self.link[at]
            if 0 < len(ids) < w:
                at = state
                while self.length[self.link[at]] >= len(ids):
                    at = self.link[at]
                self.short.setdefault(at, []).append((len(ids), item))
        #: For each state: its suffix-link ancestor whose strings include those of window length; short items on the way up.
        self.at_window = [0] * n
        self.whole: list[tuple[tuple[int, str | int], ...]] = [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.at_window[s] = s if self.length[s] >= w > self.length[up] else self.at_window[up]
            self.whole[s] = (*self.short.get(s, ()), *self.whole[up])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | int]]:
        """Hit runs ``[begin, end)`` of a document's words, in order, and the items that they come from."""
        get = self.vocab.get
        spans: list[tuple[int, int]] = []
        found: set[str | int] = set()
        step, link, length, whole, at_window, w = self.next, self.link, self.length, self.whole, self.at_window, self.window
        state = size = 0
        for i, word in enumerate(words):
            c = get(word)
            if c is None:
                state = size = 0
                continue
            while state and c not in step[state]:
                state = link[state]
                size = length[state]
            to = step[state].get(c)
            if to is None:
                state = size = 0
                continue
            state, size = to, size + 1
            if size >= w:
                spans.append((i + 1 - w, i + 1))
                found |= self.items[at_window[state]]
            if whole[state]:
                for m, item in whole[state]:
                    if m <= size:
                        spans.append((i + 1 - m, i + 1))
                        found.add(item)
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without its words in ``spans``, and what stands between the words of one span."""
    data = text.encode()
    flag = _WORD_BYTE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : begin[a]])
        at = end[b - 1]
    return b"".join([*out, data[at:]]).decode()


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items in parts of about ``block_bytes``, so that no automaton and no broadcast grows with the benchmark."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def find_items(docs: DataFrame, items: DataFrame, *, window: int = 10, block_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Adds to every row of ``docs`` what it shares with benchmark items.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window. A word inside
    an occurrence of a window is hit. New columns: ``_n_words``, ``_begin``/``_end`` (word positions of maximal hit runs) and
    ``_items`` (ids of the items with occurring windows, as strings, sorted). Null texts have no words, texts of any length are
    read whole; repeated rows give repeated results; an empty benchmark hits nothing, an empty table gives an empty result. Items of
    equal words are scanned as one. The items are scanned in blocks of ``block_bytes``: one block is the
    usual case and needs no shuffle; more blocks are joined by row.
    """
    docs, named = sealed(docs)
    out = _found(docs, items, window, block_bytes, named[text_col], item_id_col, item_text_col)
    new = ["_n_words", "_begin", "_end", "_items"]
    return unsealed(out, named, dict(zip(new, new, strict=True)))


def _found(docs: DataFrame, items: DataFrame, window: int, block_bytes: int, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    blocks = item_blocks(items, item_id_col, item_text_col, block_bytes)
    spark = docs.sparkSession
    if len(blocks) > 1:
        docs = cut(docs.withColumn("_row", F.uuid()))

    def scanned(block: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r.item, r.text) for r in block.collect()])
        names = docs.columns if len(blocks) == 1 else ["_row", text_col]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # items of the same words are one class, whose ids are put in once a document
            classes: dict[tuple[bytes, ...], list[str]] = {}
            for i, t in sorted(sent.value):
                classes.setdefault(tuple(words_of(t)), []).append(i)
            ids = list(classes.values())
            automaton = SuffixAutomaton([(k, list(w)) for k, w in enumerate(classes)], window)
            for batch in batches:
                n, begin, end, hit = [], [], [], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    words = words_of(text)
                    spans, found = automaton.scan(words)
                    n.append(len(words))
                    begin.append([a for a, _ in spans])
                    end.append([b for _, b in spans])
                    hit.append(sorted({i for k in found for i in ids[k]}))
                new = [pa.array(n, pa.int64()), pa.array(begin, pa.list_(pa.int32())), pa.array(end, pa.list_(pa.int32())), pa.array(hit, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "_n_words", "_begin", "_end", "_items"])

        source = docs.select(*[F.col(f"`{c}`") for c in names], text_of(f"`{text_col}`").alias("_words_of"))
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
        return source.mapInArrow(scan, f"{kept}, _n_words long, _begin array<int>, _end array<int>, _items array<string>")

    if len(blocks) == 1:
        return scanned(blocks[0])
    parts = scanned(blocks[0])
    for block in blocks[1:]:
        parts = parts.unionByName(scanned(block))
    per_row = parts.groupBy("_row").agg(F.max("_n_words").alias("_n_words"), F.flatten(F.collect_list(F.arrays_zip("_begin", "_end"))).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    runs = F.aggregate(
        F.array_sort("_s"),
        F.expr("cast(array() as array<struct<_begin:int,_end:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["_begin"] <= F.element_at(acc, -1)["_end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["_begin"].alias("_begin"), F.greatest(F.element_at(acc, -1)["_end"], x["_end"]).alias("_end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    per_row = per_row.withColumn("_s", runs).select("_row", "_n_words", F.col("_s._begin").alias("_begin"), F.col("_s._end").alias("_end"), "_items")
    return docs.join(per_row, "_row").drop("_row")


def decontaminate(docs: DataFrame, items: DataFrame, *, min_run: int = 10, max_coverage: float = 0.5, block_bytes: int = 1 << 20, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without benchmark passages: hit runs of at least ``min_run`` words (or a whole shorter item) are cut out of the
    text; a document of which more than ``max_coverage`` of the words is hit goes altogether. Other columns stay; ``n_chars`` is
    set anew where there is one. A document without hits stays as it is, null text included.
    """
    docs, named = sealed(docs)
    text = named[text_col]
    found = _found(docs, items, min_run, block_bytes, text, item_id_col, item_text_col)
    hit = F.aggregate(F.zip_with("_begin", "_end", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    kept = found.where((F.size("_begin") == 0) | (hit <= max_coverage * F.col("_n_words")))

    @F.pandas_udf("string")
    def without(text: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, list(zip(b, e, strict=True))) if len(b) else t for t, b, e in zip(text, begin, end, strict=True)], dtype=object)

    kept = kept.withColumn(text, without(text, "_begin", "_end"))
    if "n_chars" in named:
        size = named["n_chars"]
        kept = kept.withColumn(size, F.when(F.size("_begin") > 0, F.length(text)).otherwise(F.col(size)).cast(docs.schema[size].dataType))
    return unsealed(kept, named)
