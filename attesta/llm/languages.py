"""Language identification: a bidirectional gated recurrent network over bytes labels every position; a document pools them.

The network reads runs of bytes between white space, a blank on each side, so a run's labels depend on the run alone and are worked
out once for all places where it occurs. Training is plain backpropagation through time in numpy.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import slices

#: Bytes of a run that the network reads at once; longer runs are read piece by piece.
PIECE = 30
_RUN = re.compile(rb"[^ \t-\r]{1,%d}" % PIECE)
_SPACE = re.compile(rb"[ \t-\r]")
_BLOCK = 1 << 20
#: Runs that are looked up together, and numbers (distinct runs times labels) that a task keeps.
_AT_ONCE = 100_000
_KEPT = 1_200_000
_SPANS = "array<struct<begin:long,end:long,lang:string>>"

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the exponential, which numpy works out faster than the hyperbolic tangent."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x += x
    _sigmoid(x)
    x += x
    x -= 1
    return x


@dataclass
class Network:
    """Gated recurrent units in both directions and a softmax at every position."""

    labels: list[str]
    p: Params

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int = 7, kind: type = np.float32) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for way in "fb":
            p[f"x{way}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(kind)
            p[f"h{way}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(kind)
        p["out"] = rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(kind)
        p["bias"] = np.zeros(len(labels), kind)
        return cls(labels, p)

    def _pass(self, codes: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States after each position of ``codes`` (positions x runs), in reading order; ``keep`` receives what training needs."""
        weights, size = self.p[f"h{way}"], self.p["out"].shape[0] // 2
        inputs = self.p[f"x{way}"]
        state = np.zeros((codes.shape[1], size), weights.dtype)
        states = np.empty((*codes.shape, size), weights.dtype)
        for t in range(len(codes)) if way == "f" else reversed(range(len(codes))):
            given, own = np.take(inputs, codes[t], axis=0), state @ weights
            gates = _sigmoid(given[:, : 2 * size] + own[:, : 2 * size])
            update, reset, part = gates[:, :size], gates[:, size:], own[:, 2 * size :]
            new = reset * part
            new += given[:, 2 * size :]
            _tanh(new)
            if keep is not None:
                keep.append((t, state, update, reset, new, part))
            state = state - new
            state *= update
            state += new
            states[t] = state
        return states

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """positions x runs x labels."""
        both = np.concatenate([self._pass(codes, "f"), self._pass(codes, "b")], axis=2)
        return _log_softmax(both @ self.p["out"] + self.p["bias"])

    def gradients(self, codes: np.ndarray, label: np.ndarray) -> tuple[float, Params]:
        """The mean loss over all positions, each labelled as its run, and its gradients, backwards through time."""
        kept = {"f": [], "b": []}
        both = np.concatenate([self._pass(codes, way, kept[way]) for way in "fb"], axis=2)
        logs = _log_softmax(both @ self.p["out"] + self.p["bias"])
        n, size = codes.size, both.shape[2] // 2
        loss = -float(logs[:, np.arange(len(label)), label].sum()) / n
        wrong = np.exp(logs)
        wrong[:, np.arange(len(label)), label] -= 1
        wrong /= n
        flat = wrong.reshape(n, -1)
        grads = {"out": both.reshape(n, -1).T @ flat, "bias": flat.sum(axis=0)}
        down = wrong @ self.p["out"].T
        order = np.argsort(codes, axis=None, kind="stable")
        seen, starts = np.unique(codes.ravel()[order], return_index=True)
        for way, part in (("f", slice(0, size)), ("b", slice(size, None))):
            weights = self.p[f"h{way}"]
            g_inputs = np.empty((*codes.shape, 3 * size), weights.dtype)
            g_weights, g_state = np.zeros_like(weights), np.zeros((codes.shape[1], size), weights.dtype)
            for t, before, update, reset, new, own in reversed(kept[way]):
                g_state = g_state + down[t][:, part]
                g_new = g_state * (1 - update) * (1 - new * new)
                g_update = g_state * (before - new) * update * (1 - update)
                g_reset = g_new * own * reset * (1 - reset)
                g_inputs[t] = np.concatenate([g_update, g_reset, g_new], axis=1)
                g_own = np.concatenate([g_update, g_reset, g_new * reset], axis=1)
                g_weights += before.T @ g_own
                g_state = g_state * update + g_own @ weights.T
            grads[f"h{way}"] = g_weights
            g_x = np.zeros_like(self.p[f"x{way}"])
            g_x[seen] = np.add.reduceat(g_inputs.reshape(n, -1)[order], starts, axis=0)
            grads[f"x{way}"] = g_x
        return loss, grads

    def train(self, runs: list[bytes], label: np.ndarray, *, steps: int, batch: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on batches of runs of one length each, lengths drawn by their share of bytes, languages alike."""
        rng = np.random.default_rng(seed)
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, run in enumerate(runs):
            by_length[len(run)].append(k)
        lengths = sorted(by_length)
        if not lengths:
            return
        share = np.array([n * len(by_length[n]) for n in lengths], float)
        stacks = {n: (stacked([runs[k] for k in by_length[n]]), label[by_length[n]]) for n in lengths}
        weight = {n: _balanced(stacks[n][1]) for n in lengths}
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step, n in enumerate(rng.choice(lengths, steps, p=share / share.sum()), 1):
            codes, given = stacks[int(n)]
            chosen = rng.choice(len(given), batch, p=weight[int(n)])
            _, grads = self.gradients(codes[:, chosen], given[chosen])
            now = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.p[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)

    def pooled(self, runs: list[bytes]) -> np.ndarray:
        """runs x labels: log-probabilities summed over the positions of each run and the blank after it."""
        out = np.empty((len(runs), len(self.labels)))
        for places, codes in _by_length(runs):
            out[places] = self.log_probabilities(codes)[1:].sum(axis=0)
        return out

    def positions(self, runs: list[bytes]) -> list[np.ndarray]:
        """For each run the number of the likeliest label at each of its bytes."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(runs)
        for places, codes in _by_length(runs):
            best = self.log_probabilities(codes)[1:-1].argmax(axis=2)
            for k, place in enumerate(places):
                out[place] = best[:, k]
        return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=-1, keepdims=True))
    return x


def _balanced(label: np.ndarray) -> np.ndarray:
    """Chances of rows, so that each label that occurs is drawn alike."""
    n = np.bincount(label)
    return 1 / (n[label] * np.count_nonzero(n))


def stacked(runs: list[bytes]) -> np.ndarray:
    """Runs of one length as codes, positions x runs, a blank before and after."""
    raw = np.frombuffer(b"".join(b" " + r + b" " for r in runs), np.uint8)
    return np.ascontiguousarray(raw.reshape(len(runs), -1).T)


def _by_length(runs: list[bytes], most: int = 4096) -> Iterator[tuple[list[int], np.ndarray]]:
    groups: dict[int, list[int]] = defaultdict(list)
    for k, run in enumerate(runs):
        groups[len(run)].append(k)
    for places in groups.values():
        for at in range(0, len(places), most):
            some = places[at : at + most]
            yield some, stacked([runs[k] for k in some])


def blocks(data: bytes) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of about a MB, cut at white space where there is any in the next MB."""
    begin = 0
    while begin < len(data):
        least = begin + _BLOCK
        gap = _SPACE.search(data, least, least + _BLOCK)
        end = min(gap.start() if gap else least, len(data))
        yield begin, end
        begin = end


class Pool:
    """Pooled log-probabilities of texts; a run's are kept for the next text that has it."""

    def __init__(self, network: Network):
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.sums = np.empty((0, len(self.network.labels)))

    def _learn(self) -> None:
        """The sums of runs that were met since the last time."""
        new = list(islice(self.number, len(self.sums), None))
        if new:
            self.sums = np.concatenate([self.sums, self.network.pooled(new)])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-probabilities, texts x labels, and positions of each text."""
        total, positions = np.zeros((len(texts), len(self.network.labels))), np.zeros(len(texts))
        waiting: list[tuple[int, np.ndarray]] = []

        def add() -> None:
            self._learn()
            for k, ids in waiting:
                total[k] += self.sums[ids].sum(axis=0)
            waiting.clear()
            if self.sums.size > _KEPT:
                self._forget()

        n = 0
        for k, data in enumerate(texts):
            for begin, end in blocks(data):
                runs = _RUN.findall(data, begin, end)
                waiting.append((k, np.fromiter(map(self.number.__getitem__, runs), np.int64, len(runs))))
                positions[k] += sum(map(len, runs)) + len(runs)
                n += len(runs)
                if n > _AT_ONCE:
                    add()
                    n = 0
        add()
        return total, positions


def held_out(id_col: str) -> Column:
    """Rows that nothing is learnt from: the CRC-32 of the id as text is 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, *, sample: int = 400, hidden: int = 8, steps: int = 500, pieces: int = 4, piece_chars: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network trained on at most ``sample`` rows of each language that aren't held out, chosen by hash, and of each row on
    ``pieces`` stretches of ``piece_chars`` characters spread over the whole text (all of a shorter text). Null languages and null texts
    teach nothing; without any labelled row the network has no labels."""
    text = F.col(text_col)
    rows = docs.where(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("h")).dropna(subset=["lang", "text"])
    step = (F.length("text") - piece_chars) / max(pieces - 1, 1)
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.col("text").substr((F.floor(k * step) + 1).cast("int"), F.lit(piece_chars))), " ")
    some = F.when(F.length("text") <= pieces * piece_chars, F.col("text")).otherwise(spread)
    # about twice as many as are wanted pass by their hash alone, so that no language's rows meet; a number a language comes here, as
    # does the network, which has a column for each
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Network.fresh([], hidden)
    most = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, 2.0 * sample / n)])
    few = rows.where(F.pmod("h", F.lit(1 << 52)) / float(1 << 52) < most[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("h", "text")
    chosen = few.select("lang", "h", some.alias("text")).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= sample)
    found = sorted((r.lang, r.h, r.text) for r in chosen.select("lang", "h", "text").collect())
    labels = sorted({r[0] for r in found})
    number = {lang: k for k, lang in enumerate(labels)}
    runs, label = [], []
    for lang, _, t in found:
        some_runs = _RUN.findall(t.encode())
        runs += some_runs
        label += [number[lang]] * len(some_runs)
    network = Network.fresh(labels, hidden)
    if len(labels) > 1:
        network.train(runs, np.array(label), steps=steps)
    return network


def predict(docs: DataFrame, network: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every whole text, one row a row.

    Probabilities are pooled over all positions as their geometric mean; the score is the winner's share (ties: the first label in
    order). Null texts and texts without a letter, empty ones too, are ``und`` with score 0, as is everything where no language was
    learnt. Texts of any length are read in blocks. Other columns aren't read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(network)
        for batch in slices(batches):
            texts = [t.as_py().encode() if t.is_valid else b"" for t in batch.column(2)]
            sums, positions = pool(texts)
            means = np.exp(sums / np.maximum(positions, 1)[:, None])
            best = means.argmax(axis=1)
            share = np.where(positions > 0, means[np.arange(len(best)), best] / means.sum(axis=1), 0).round(6)
            langs = [network.labels[b] if n else "und" for b, n in zip(best, positions, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(share)], ["id", "held_out", "lang_pred", "score"])

    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), lettered.alias("text"))
    if network.labels:
        kind = docs.schema[id_col].dataType.simpleString()
        found = rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
    else:
        found = rows.select("id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return found.withColumnRenamed("id", id_col)


def spans(docs: DataFrame, network: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans: of every whole text the stretches of bytes that get one label (begin, end, lang), in order; white space has none and
    parts no stretch from the next of the same label. Null and empty texts have no stretches, nor has any where no language was learnt."""

    def label(data: bytes) -> list[dict]:
        out: list[dict] = []
        for begin, end in blocks(data) if network.labels else ():
            at = [m.span() for m in _RUN.finditer(data, begin, end)]
            for (a, _), best in zip(at, network.positions([data[a:b] for a, b in at]), strict=True):
                cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    lang = network.labels[best[x]]
                    if out and out[-1]["lang"] == lang:
                        out[-1]["end"] = a + y
                    else:
                        out.append({"begin": a + x, "end": a + y, "lang": lang})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([label((t or "").encode()) for t in batch.column(1).to_pylist()], kind)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans {_SPANS}").withColumnRenamed("id", id_col)
