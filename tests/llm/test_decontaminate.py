import random
import re

import pytest

from attesta.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            g = v[i : i + window]
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(str(item))
    return len(w), hit, sorted(found)


def make():
    rng = random.Random(3)
    vocab = ["a", "b", "The", "é", "x1", "ß", "Δ"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 6, 9]))) for i in range(25)] + [(90, None), (91, "--"), (92, "solo")]
    docs = [(i, text(rng.randint(0, 60)).replace(" ", rng.choice([" ", "-", "\n"]))) for i in range(120)] + [(500, None), (501, "SOLO!"), (501, "SOLO!")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_matches_brute_force(spark, block_bytes):
    docs, items = make()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_begin", dc.F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_items(d, b, window=4, block_bytes=block_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = brute(r.text, items, 4)
        covered = {i for a, e in zip(r._begin, r._end) for i in range(a, e)}
        assert (r._n_words, covered, list(r._items)) == (n, hit, found)


def test_passages_are_cut_and_copies_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Clean words, here. {item.upper()}; and more clean text at the end of it all, quite long.", 5), (2, item, 1), (3, "nothing", 7), (4, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in dc.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: ("Clean words, here. ; and more clean text at the end of it all, quite long.", 74), 3: ("nothing", 7), 4: (None, 0)}


def test_awkward_rows(spark, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(awkward, none).count() == awkward.count()
    assert dc.find_items(awkward.limit(0), none).count() == 0


def test_many_equal_items(spark):
    """Copies of an item cost no more than one while a document is scanned."""
    items = spark.range(40_000).selectExpr("cast(id as string) item_id", "'true' text")
    docs = spark.createDataFrame([(1, "true " * 2000), (2, "false"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r._n_words, list(zip(r._begin, r._end)), len(r._items)) for r in dc.find_items(docs, items).collect()}
    assert got == {1: (2000, [(0, 2000)], 40_000), 2: (1, [], 0), 3: (0, [], 0)}
