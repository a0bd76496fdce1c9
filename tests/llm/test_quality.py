import re

import pyarrow.parquet as pq

from attesta.llm import quality as ql


def base(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def measured(rows):
    return [(r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) for r in rows]


def test_base_counts_match_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    more = ["a b " * 30, "a " * 7, "a " * 8, "a " * 9, "x y z " * 4 + "q", "\n\n a\n a\na\n", "\x0b\x0c#*$%&|<>\r\n", " nbsp​ é" * 9, "a\x1cb", ""]
    rows = [(r["text"], r["lang"]) for r in t] + [(x, "en") for x in more] + [(None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    got = ql.judge(docs).collect()
    assert len(got) == len(rows)
    assert sorted(measured(got)) == sorted(base(x) for x, _ in rows)
    for r in got:
        assert r._base_failed == (r._n_words < 20 or 100 * r._n_repeat_words > 30 * r._n_words)
        assert not (r._kept and r._base_failed)


def test_clean_stays_and_junk_goes(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    good = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    kept = {r.doc_id for r in ql.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("_kept").collect()}
    fair = [r["doc_id"] for r in t if good.get(r["doc_id"]) == 1 and base(r["text"])[0] >= 20 and 100 * base(r["text"])[4] <= 30 * base(r["text"])[0]]
    junk = [d for d, q in good.items() if q == 0]
    assert set(fair) <= kept and sum(d not in kept for d in junk) > 0.7 * len(junk)


def test_awkward_rows(spark, awkward):
    got = ql.judge(awkward.withColumn("_text", awkward.text)).collect()
    assert len(got) == awkward.count()
    kept = ql.keep_good(awkward.withColumn("_kept", awkward.doc_id))
    assert kept.columns == [*awkward.columns, "_kept"]
    assert ql.keep_good(awkward.limit(0)).count() == 0
