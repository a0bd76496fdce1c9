import random
import zlib
from collections import Counter

import re

import pytest

from attesta.llm import queries as q
from attesta.llm import spelling as sp

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs):
    n = Counter()
    for ident, text in docs:
        for run in LETTERS.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return n


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(n, ratio=10):
    out, form = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(others)
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("as_text", [64, 0, 4])
def test_groups_match_brute_force(spark, as_text):
    rng = random.Random(5)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 6))): rng.choice([1, 2, 3, 30, 400, 5000]) for _ in range(250)}
    words |= {"aaaaa": 7, "aaaa": 70, "aaaaaa": 70, "z": 1}
    made = sp.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), as_text=as_text)
    assert got(made) == brute(words)


def test_chains_of_forms_are_followed(spark):
    words = {"a" * k + "b" * (9 - k): 10**k for k in range(9)} | {"c" * 70_000: 3, "c" * 69_999 + "d": 40, "c" * 69_999: 2}
    found = got(sp.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found["b" * 9][1] == "a" * 8 + "b" and found["b" * 9][0] == "a" + "b" * 8
    assert found["c" * 70_000][0] == found["c" * 69_999][0] == "c" * 69_999 + "d" and found["c" * 70_000][3] == 2


def test_query_matches_brute_force_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kept = {w: n for w, n in counted(docs).items() if len(w) >= 7 and n >= 2}
    by = {}
    for w in kept:  # only words that share a half can be one edit apart
        for part in {w[:3], w[-3:], w[1:4], w[-4:-1]}:
            by.setdefault(part, set()).add(w)
    found = got(q.op13_spelling_variants(spark, sf))
    assert found.keys() == kept.keys() and all(found[w][2] == n for w, n in kept.items())
    for w in random.Random(1).sample(sorted(kept), 300):
        assert found[w][3] == sum(near(w, v) for v in kept)


def test_awkward_rows(spark, awkward):
    more = spark.createDataFrame([(1, "Élevage élevage ÉLEVAGE 🎉élevage"), (1, "Élevage élevage ÉLEVAGE 🎉élevage"), (2, "x" * 150_000)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").union(more).withColumnRenamed("doc_id", "doc_id")
    expect = {w: n for w, n in counted([tuple(r) for r in docs.collect()]).items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in sp.words(docs).collect()} == expect
    assert got(sp.group_variants(sp.words(docs))) == brute(expect)
    assert sp.group_variants(sp.words(docs.limit(0))).count() == 0
