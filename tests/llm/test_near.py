import random
from itertools import combinations

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
from attesta.llm import near as nd


def grams(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The (id, text) that stay, from comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 100 * both >= 80 * either and comp[i] != comp[j]:
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    return sorted(min(((rows[i][0] is None, rows[i][0], rows[i][1]) for i in range(len(rows)) if comp[i] == c), key=lambda x: x[:2])[1:] for c in set(comp))


def planted():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    common = rng.choices(words, k=40)
    rows = []
    for i in range(40):
        base = rng.choices(words, k=rng.randint(3, 300)) + common * (i % 3 == 0)
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 8)):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((len(rows), "  ".join(near).upper()))
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "Word"), (904, "word")]


def test_matches_brute_force(spark):
    rows = planted()
    got = nd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    kept = {r.doc_id for r in got.collect()}
    assert kept == {i for i, _ in brute(rows)} and len(kept) < len(rows)


def test_stage_loses_no_pair_at_0_8(spark):
    """Documents 1 and 177 are 0.8 alike or more, at over 6 bits of SimHash; 106 and 185 are less alike, at 6 bits or fewer."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, _ in brute([(r.doc_id, r.text) for r in docs.collect()])}


def test_awkward_rows(spark, awkward):
    kept = nd.deduplicate(awkward.withColumn("_row", awkward.doc_id))
    assert kept.columns == [*awkward.columns, "_row"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 7, 8, 9]
    assert nd.deduplicate(awkward.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    a, b, c, d = ("a b c d e f", "one two three four five six", "k l m n o p", "red green blue black white grey")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, d), (None, c)]
    got = nd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, a), (0, b), (5, c), (5, d)])


def test_crowds_count_as_candidates(monkeypatch):
    """In a crowd every row is one with candidates, and its neighbour and the first are its partners where they are close."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fp = np.array([base ^ (1 << int(b)) for b in rng.permutation(60)[:40]] + [int(x) for x in rng.integers(0, 1 << 62, 40)], np.int64)
    turns = nd.turns_for(len(fp), 8)
    rows = pa.record_batch([pa.array(np.zeros(len(fp), np.int64)), pa.array(fp), pa.array(np.arange(len(fp))), pa.array(np.full(len(fp), 100))], ["turn", "key", "sig", "n"])
    order = turns[0][0]
    keys = np.zeros(len(fp), np.uint64)
    at = 64
    for shift, width in order:
        at -= width
        keys |= ((fp.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)) << np.uint64(at)
    rows = rows.set_column(1, "key", pa.array(keys.view(np.int64)))
    found = {}
    for crowd in (4096, 2):
        monkeypatch.setattr(nd, "CROWD", crowd)
        out = pa.Table.from_batches(nd._first_partners(turns, 8, 80)(iter([rows]))).to_pylist()
        found[crowd] = {r["v"] for r in out}
        for r in out:
            d = bin(int(fp[r["v"]]) ^ int(fp[r["u"]])).count("1")
            assert r["ufp"] == fp[r["u"]] and (d <= 8 and r["bits"] == d or r["v"] == r["u"] and r["bits"] == 99)
    assert found[4096] <= found[2]
