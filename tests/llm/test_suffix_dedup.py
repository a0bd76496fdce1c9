import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from attesta.llm import suffix_dedup as sd


def brute(rows, length):
    """(n_bytes, n_removed, n_spans, digest) by row, from a dictionary of first starts."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    first = {}
    for i in order:
        t = (rows[i][1] or "").encode()
        for s in range(len(t) - length + 1):
            first.setdefault(t[s : s + length], (rows[i][0], s))
    out = []
    for i, (doc, text) in enumerate(rows):
        t = (text or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < (doc, s):
                gone[s : s + length] = True
        keep = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(keep).hexdigest()))
    return sorted(out)


def run(spark, rows, length):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sd.remove_repeats(docs, length=length, digest=True).collect()
    return sorted((r.doc_id, r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in got)


def planted(seed):
    rng = random.Random(seed)
    letters = "abcé ü\n"
    passages = ["".join(rng.choices(letters, k=rng.randint(20, 90))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(1, 60))))
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "x" * 300), (105, "xy" * 200), (106, "x" * 29)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = planted(seed)
    assert run(spark, rows, 30) == brute(rows, 30)


def test_whole_table_matches_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    assert run(spark, rows, 100) == brute(rows, 100)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh", k=500))
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    rows = [(1, noise(2_000_000) + passage), (2, noise(1_048_576 - 250) + passage + noise(900_000)), (3, passage)]
    assert [(r[0], r[2]) for r in run(spark, rows, 100)] == [(1, 0), (2, 500), (3, 500)]


def test_deep_shallow_groups_equal_runs():
    rng = np.random.default_rng(1)
    runs = rng.integers(97, 99, (400, 3)).astype(np.uint8).repeat(20, axis=1)
    group = rng.integers(0, 3, 400)
    at, same = sd.deep_shallow(runs, group)
    got = {}
    for a, s in zip(at.tolist(), same.tolist()):
        got.setdefault(s, []).append(a)
    want = {}
    for i in range(400):
        want.setdefault((group[i], runs[i].tobytes()), []).append(i)
    assert sorted(sorted(v) for v in got.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_awkward_rows(spark, awkward):
    got = sd.deduplicate(awkward.withColumn("_bucket", awkward.doc_id))
    rows = {(r.doc_id, r.lang): r for r in got.collect()}
    assert got.count() == awkward.count() and rows[(1, "en")].text is None and rows[(5, "xx")].text == "word"
    assert rows[(8, "en")].text == "long words and lines\n" and rows[(9, "en")].n_chars == 1
    assert sd.deduplicate(awkward.limit(0)).count() == 0
