import random

import numpy as np
import xxhash

from attesta.llm import simhash as sh


def brute(rows, budget, shingle=3):
    fp = {}
    for i, (_, text) in enumerate(rows):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        s = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if bin(fp[i] ^ fp[j]).count("1") <= budget and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    least = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            least[c] = min(rows[i][0], least.get(c, 1 << 60))
    return sorted((rows[i][0] if rows[i][0] is not None else -1, f"{fp[i]:016x}", least.get(comp[i], -1)) for i in range(len(rows)))


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        base = rng.choices(words, k=rng.randint(1, 400))
        rows.append((i * 10, " ".join(base)))
        for k in range(rng.randint(0, 4)):
            near = list(base)
            near[rng.randrange(len(near))] = "EDIT"
            rows.append((i * 10 + k + 1, "  ".join(near)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "Word"), (904, "word"), (904, "word")]


def test_components_match_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for budget in (3, 6):
        got = sh.near_duplicates(docs, shingle=3, budget=budget).collect()
        assert sorted((r.doc_id, f"{r._fp & (1 << 64) - 1:016x}", r._component) for r in got) == brute(rows, budget)


def test_trie_finds_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [base]
    for _ in range(20):
        f = base.copy()
        for _ in range(3):
            f ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
        flips.append(f)
    keys = np.unique(np.concatenate(flips))
    links = set()
    for i, j in sh.trie_links(keys, np.array([0]), np.array([len(keys)]), np.array([0]), 3):
        links |= {(int(a), int(b)) for a, b in zip(i, j)}
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3
    assert links == {(i, j) for i, j in zip(*np.where(np.triu(near, 1)))}


def test_awkward_rows(spark, awkward):
    got = sh.near_duplicates(awkward.withColumn("_extra", awkward.doc_id), shingle=3).collect()
    assert len(got) == awkward.count()
    assert {r._component for r in got if not (r.text or "").strip()} == {1}
    kept = sh.deduplicate(awkward, shingle=3)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 7, 8, 9]
    assert sh.near_duplicates(awkward.limit(0)).count() == 0
