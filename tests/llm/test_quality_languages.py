import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from attesta.llm import quality as ql


def prose(rng, letters, n=150):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n))


def test_common_words_are_each_languages_own(spark):
    """ru has no word that is common: all its documents stay. xx has some, which a document of another tongue lacks."""
    rng = random.Random(1)
    russian = [prose(rng, "абвгдежзиклмнопрстуф") for _ in range(20)]
    own = [" ".join(rng.choice(["zu", "ba", "ko", "mi", "haus", "fluss"]) if i % 2 else prose(rng, "abcdef", 1) for i in range(150)) for _ in range(40)]
    odd = prose(rng, "bcdfgh")
    rows = [(t, "ru") for t in russian] + [(t, "xx") for t in own] + [(odd, "xx"), (own[0] + " buy" * 400 + prose(rng, "bcdfgh", 900), "xx")]
    kept = {r.text for r in ql.keep_good(spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert set(russian) <= kept and set(own) <= kept and odd not in kept


def test_verdict_against_brute_force(spark):
    """Distances and verdicts of a whole table, worked out again from plain counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in ql.judge(docs).collect()}
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    words = {i: re.findall("[^\x20\x09-\x0d]+", t) for i, t, _ in rows}
    refs = {}
    for lang in {g for _, _, g in rows}:
        own = [(i, t) for i, t, g in rows if g == lang]
        df = Counter(w for i, _ in own for w in set(words[i]))
        common = sorted(w for w, _ in sorted(df.items(), key=lambda x: (-x[1], x[0].encode()))[:30])
        fair = [(i, t) for i, t in own if not got[i]._base_failed]
        hist = [sum(words[i].count(w) for i, _ in fair) for w in common]
        chars = [sum(k) for k in zip(*(classes(t) for _, t in fair))]
        refs[lang] = (common, hist, chars, sum(len(words[i]) for i, _ in fair))
    for i, t, lang in rows:
        common, hist, chars, n = refs[lang]
        far_c, far_w = js(classes(t), chars), js([words[i].count(w) for w in common], hist)
        r = got[i]
        assert (r._char_distance, r._word_distance) == (pytest.approx(far_c, abs=1e-9), pytest.approx(far_w, abs=1e-9))
        far = len(t) >= 100 and far_c > 0.34 or sum(hist) >= 0.1 * n and len(words[i]) >= 100 and (1.0 if far_w is None else far_w) > 0.75
        assert r._kept == (not r._base_failed and not far)


def classes(text):
    """Characters by the first class that has them: lower, blank, upper, stop, symbol, digit, letter, none."""
    out = [0] * 8
    for c in text:
        kind = unicodedata.category(c)
        tests = [kind == "Ll", c in " \t\n\x0b\x0c\r", kind == "Lu", c in ".,;:!?'\"()-", c in "#*$%&|<>", kind[0] == "N", kind[0] == "L", True]
        out[tests.index(True)] += 1
    return out


def js(a, b):
    if not sum(a) or not sum(b):
        return None
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    half = lambda x, y: sum(u * math.log2(2 * u / (u + v)) for u, v in zip(x, y) if u)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def test_every_language_has_a_reference(spark):
    rng = random.Random(2)
    rows = [(prose(rng, "abcdefgh", 25), f"l{i:04}") for i in range(1100)]
    got = ql.judge(spark.createDataFrame(rows, "text string, lang string")).where("_char_distance is null").count()
    assert got == 0
