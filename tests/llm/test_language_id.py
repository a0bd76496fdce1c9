import math
import zlib

import numpy as np

from attesta.llm import languages as lg


def slow_labels(net, run):
    """One position after another, without matrices."""
    size = net.p["out"].shape[0] // 2
    codes = [32, *run, 32]

    def walk(order, way):
        x, h = net.p[f"x{way}"].astype(float), net.p[f"h{way}"].astype(float)
        state, out = [0.0] * size, {}
        for t in order:
            own = [sum(state[i] * h[i][j] for i in range(size)) for j in range(3 * size)]
            gate = [1 / (1 + math.exp(-(x[codes[t]][j] + own[j]))) for j in range(2 * size)]
            new = [math.tanh(x[codes[t]][2 * size + j] + gate[size + j] * own[2 * size + j]) for j in range(size)]
            state = [(1 - gate[j]) * new[j] + gate[j] * state[j] for j in range(size)]
            out[t] = state
        return out

    f, b = walk(range(len(codes)), "f"), walk(reversed(range(len(codes))), "b")
    rows = []
    for t in range(len(codes)):
        z = [sum(v * net.p["out"][i][c] for i, v in enumerate(f[t] + b[t])) + net.p["bias"][c] for c in range(len(net.labels))]
        top = max(z)
        rows.append([v - top - math.log(sum(math.exp(u - top) for u in z)) for v in z])
    return np.array(rows)


def test_gradients_match_differences():
    net = lg.Network.fresh(["a", "b", "c"], 4, kind=np.float64)
    codes, label = lg.stacked([b"abba", b"cbca", b"aaac"]), np.array([0, 2, 1])
    _, grads = net.gradients(codes, label)
    rng = np.random.default_rng(0)
    for name, values in net.p.items():
        flat, got = values.reshape(-1), grads[name].reshape(-1)
        for k in [*np.argsort(-np.abs(got))[:6], *rng.integers(0, len(flat), 6)]:
            old, ends = flat[k], []
            for way in (1e-6, -1e-6):
                flat[k] = old + way
                ends.append(net.gradients(codes, label)[0])
            flat[k] = old
            assert abs((ends[0] - ends[1]) / 2e-6 - got[k]) < 1e-7, (name, k)


def test_pools_match_a_walk_position_by_position():
    net = lg.Network.fresh(["a", "b"], 5)
    runs = [b"word", b"w", "é🎉".encode(), b"x" * 30, b"word"]
    slow = [slow_labels(net, r) for r in runs]
    assert np.allclose(net.pooled(runs), [s[1:].sum(axis=0) for s in slow], atol=1e-4)
    assert all(list(p) == list(s[1:-1].argmax(axis=1)) for p, s in zip(net.positions(runs), slow))
    text = b"word w\n\tword " + b"x" * 70
    sums, n = lg.Pool(net)([text, b"", text])
    parts = [b"word", b"w", b"word", b"x" * 30, b"x" * 30, b"x" * 10]
    assert np.allclose(sums[0], net.pooled(parts).sum(axis=0)) and np.allclose(sums[0], sums[2]) and n.tolist() == [85.0, 0.0, 85.0]


def test_blocks_cover_long_texts():
    for data in (b"ab " * 900_000, b"x" * 2_500_000, b"", b"a"):
        at = list(lg.blocks(data))
        assert b"".join(data[a:b] for a, b in at) == data and all(0 < b - a <= 2 << 20 for a, b in at)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net = lg.fit(docs)
    assert net.labels == ["de", "en", "es", "fr"]
    rows = lg.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: (r.lang_pred, r.score) for r in lg.predict(docs, lg.fit(docs)).collect()} == {r.doc_id: (r.lang_pred, r.score) for r in rows}


def test_awkward_rows(spark, awkward):
    net = lg.fit(awkward, steps=20)
    assert net.labels and None not in net.labels
    got = lg.predict(awkward.withColumnRenamed("source", "lang_pred"), net).collect()
    assert len(got) == awkward.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3)) and all(r.lang_pred in net.labels and 0 < r.score <= 1 for r in got if r.doc_id not in (1, 2, 3))
    assert lg.predict(awkward.limit(0), net).count() == 0
    none = lg.fit(awkward.limit(0))
    assert none.labels == [] and {(r.lang_pred, r.score) for r in lg.predict(awkward, none).collect()} == {("und", 0.0)}
    found = {r.doc_id: r.spans for r in lg.spans(awkward.where("doc_id < 8"), net).collect()}
    assert found[1] == found[2] == found[3] == [] and found[4][0].begin == 0 and found[4][-1].end == 4
