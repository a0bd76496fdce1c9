"""Toxicity: a lexicon trie met with Levenshtein automata, and windows around its hits that tell quotation from abuse."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import text_of
from attesta.plans.lineage import cut

#: Insults that are known before any label is seen.
SEED = "idiot moron loser scum trash clown stupid pathetic worthless disgusting imbecile bastard asshole bitch dumbass retard scumbag idioot imbécile connard salope dummkopf arschloch wichser estúpido imbécil cabrón pendejo".split()

#: Words that report speech, words that address a person, and marks that open or close a quotation.
REPORTS = frozenset("said says say called calls wrote writes quoted quote quotes told word term dit dits écrit appelé cite sagte sagt schrieb nannte zitat dijo dice escribió llamó cita".split())
ADDRESS = frozenset("you your you're u ur tu toi te vous votre du dich dir sie ihr usted tú ustedes eres".split())
_MARKS = "\"“”„«»‹›‘’"
_WORD = re.compile(r"\w+")
_DEAD = -1


class FuzzyTrie:
    """The product of a lexicon trie with the Levenshtein automata of all words, as one deterministic automaton.

    A state is a set of (trie node, edits so far); it is worked out once and then looked up. Whole terms of ``fuzzy_from``
    characters or more accept words at distance one; stems accept every word that begins with them.
    """

    def __init__(self, terms: list[str], stems: list[str], fuzzy_from: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.allowed = {t: int(len(t) >= fuzzy_from) for t in terms}
        for t in terms:
            self.term[self._node(t)] = t
        for t in stems:
            self.stem[self._node(t)] = t
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.arcs: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0)})

    def _node(self, text: str) -> int:
        at = 0
        for ch in text:
            if ch not in self.children[at]:
                self.children[at][ch] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.stem.append(None)
            at = self.children[at][ch]
        return at

    def _state(self, found: set[tuple[int, int]]) -> int:
        todo = [x for x in found if not x[1]]
        for node, _ in todo:
            found |= {(c, 1) for c in self.children[node].values()}
        least = {}
        for node, e in found:
            least[node] = min(e, least.get(node, 9))
        key = frozenset(least.items())
        if not key:
            return _DEAD
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
        return self.number[key]

    def _step(self, state: int, ch: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            to = self.children[node].get(ch)
            if to is not None:
                out.add((to, e))
            if not e:
                out.add((node, 1))
                out |= {(c, 1) for c in self.children[node].values()}
        return self._state(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """The best term for ``word`` and its distance: 0 for whole terms and stems, 1 for misspelled terms."""
        state, arcs = self.start, self.arcs
        exact = 0
        for ch in word:
            exact = self.children[exact].get(ch, -1) if exact >= 0 else -1
            if exact > 0 and self.stem[exact]:
                return self.stem[exact], 0
            to = arcs.get((state, ch))
            if to is None:
                to = arcs[state, ch] = self._step(state, ch)
            if to == _DEAD:
                return None
            state = to
        best = None
        for node, e in self.sets[state]:
            t = self.term[node]
            if t is not None and e <= self.allowed[t] and (best is None or e < best[1]):
                best = (t, e)
        return best


FEATURES = 7


class Scorer:
    """Features of a text: hits inside and outside of quotation, exact and misspelled, and their company."""

    def __init__(self, terms: list[str], stems: list[str], window: int = 6):
        self.trie = FuzzyTrie(terms, stems)
        self.window = window
        self.seen: dict[str, tuple[str, int] | None] = {}

    def hits(self, words: list[str]) -> list[tuple[int, int]]:
        seen, out = self.seen, []
        for i, w in enumerate(words):
            try:
                m = seen[w]
            except KeyError:
                if len(seen) >= 1 << 19:
                    seen.clear()
                m = seen[w] = self.trie.match(w)
            if m is not None:
                out.append((i, m[1]))
        return out

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORD.findall(low)
        hits = self.hits(words)
        if not hits:
            return [0.0] * FEATURES
        spans = [m.span() for m in _WORD.finditer(low)]
        exact = fuzzy = quoted = company = addressed = 0.0
        where = [i for i, _ in hits]
        for k, (i, distance) in enumerate(hits):
            lo, hi = max(0, i - self.window), min(len(words), i + self.window + 1)
            before, after = low[spans[lo][0] : spans[i][0]], low[spans[i][1] : spans[hi - 1][1] + 1]
            marks = any(c in _MARKS for c in before) and any(c in _MARKS for c in after)
            around = words[lo:i] + words[i + 1 : hi]
            if marks or any(w in REPORTS for w in around) and any(c in _MARKS for c in before + after):
                quoted += 1
            elif distance:
                fuzzy += 1
            else:
                exact += 1
            company += (k > 0 and where[k - 1] >= lo) + (k + 1 < len(where) and where[k + 1] < hi)
            addressed += any(w in ADDRESS for w in around)
        share = lambda n: math.log1p(n)
        return [share(exact), float(exact > 0), share(fuzzy), share(quoted), share(company), share(addressed), min(1.0, 50 * (exact + fuzzy) / len(words))]


#: Weights where no labels can be learnt from: bias, then the features.
DEFAULT = [-4.0, 2.0, 4.0, 1.0, -0.5, 0.5, 0.5, 1.0]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton's method, with a ridge on all but the bias."""
    if not len(y) or y.min() == y.max():
        return DEFAULT
    a = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(a.shape[1]), np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def held_out(id_col: str):
    """Rows whose labels are not learnt from: crc32 of the id as text divides by five; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Texts and labels of at most ``sample`` rows that are not held out: those of the smallest id hashes. Equal texts are one."""
    chosen = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == chosen[id_col])
    return cut(rows.groupBy("_text").agg(F.max("_y").alias("_y")))


def learn_lexicon(rows: DataFrame, *, size: int = 500, min_docs: int = 5, purity: float = 0.8) -> tuple[list[str], list[str]]:
    """Whole terms and stems (the first four to eight characters) that mark toxic texts.

    A candidate's documents must be ``min_docs`` toxic ones or more, ``purity`` of all it is in, and its log-likelihood ratio
    must stand out among as many candidates as there are; the ``size`` strongest are kept, less those that a stem covers. Words of
    any length are candidates.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, all_ = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                own = words | {f"{w[:k]}*" for w in words for k in range(4, 9) if len(w) > k}
                all_.update(own)
                if y:
                    toxic.update(own)
        yield pa.record_batch([pa.array(list(all_), pa.string()), pa.array([toxic[t] for t in all_], pa.int64()), pa.array(list(all_.values()), pa.int64())], ["term", "toxic", "docs"])

    n = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not n[1] or n[1] == n[0]:
        return [], []
    rate = n[1] / n[0]
    counted = rows.mapInArrow(count, "term string, toxic long, docs long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    clean = F.col("docs") - F.col("toxic")
    ratio = F.col("toxic") * F.log(F.col("toxic") / (F.col("docs") * rate)) + F.when(clean > 0, clean * F.log(clean / (F.col("docs") * (1 - rate)))).otherwise(0.0)
    strong = counted.where((F.col("toxic") >= min_docs) & (F.col("toxic") >= purity * F.col("docs"))).withColumn("ratio", ratio).where(F.col("ratio") > 12)
    best = strong.orderBy(F.desc("ratio"), F.col("term").endswith("*"), F.desc(F.length("term")), "term").limit(size).collect()
    terms, stems = [], []
    for r in best:
        bare = r.term.rstrip("*")
        if any(bare.startswith(s) for s in stems) or r.term.endswith("*") and any(t.startswith(bare) for t in terms):
            continue
        (stems if r.term.endswith("*") else terms).append(bare)
    return [t for t in terms if not any(t.startswith(s) for s in stems)], stems


def score(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, terms: int = 500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """A toxicity score for every whole text: id, held_out, score (0 to 1), predicted (1 from 0.5 on), n_hits.

    Terms, stems and weights are learnt from at most ``sample`` labelled rows, none of them held out; where there is nothing to
    learn from, a fixed list and fixed weights stand in. The lexicon is a bounded model: the ``terms`` strongest terms beside the
    fixed ones. Inputs of a score are the text's words alone. Null and empty texts get the score of a text without hits; very long
    ones are read whole. Every row gives one row, repeated rows too; an empty table gives an empty one.
    """
    rows = training_rows(docs, labels, sample, id_col, text_col, label_col)
    learnt, stems = learn_lexicon(rows, size=terms)
    lexicon = sorted({*learnt, *SEED})
    stems = sorted(stems)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, stems)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    known = rows.mapInArrow(measure, "x array<double>, y int").collect()
    x = np.array([r.x for r in known]).reshape(len(known), FEATURES)
    weights = np.array(fit(x, np.array([r.y for r in known], float)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, stems)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column(2).to_pylist()]).reshape(batch.num_rows, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            hits = np.rint(np.expm1(x[:, 0]) + np.expm1(x[:, 2]) + np.expm1(x[:, 3])).astype(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(hits)], ["id", "held_out", "score", "predicted", "n_hits"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    return source.mapInArrow(judge, "id long, held_out boolean, score double, predicted int, n_hits long").withColumnRenamed("id", id_col)
