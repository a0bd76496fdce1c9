import random
import zlib

from attesta.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(2)
    terms = ["idiot", "moron", "scum", "abcab", "abcba"]
    trie = tx.FuzzyTrie(terms, ["stemm"])
    words = ["".join(rng.choices("abcdimnorst", k=rng.randint(1, 7))) for _ in range(3000)]
    for t in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o"])
            words.append("".join(w))
    for w in words:
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= (len(t) >= 5)]
        got = trie.match(w)
        assert (got is None) == (not near), w
        assert got is None or got[1] == min(near)[0]
    assert trie.match("stemming") == ("stemm", 0) and trie.match("stem") is None


def test_quotation_counts_less_than_abuse():
    s = tx.Scorer(tx.SEED, [])
    abuse = s.features("you are an idiot and a moron")
    quoted = s.features('he said "you idiot" to them')
    assert abuse[0] > 0 and abuse[3] == 0 and quoted[0] == 0 and quoted[3] > 0
    assert s.features("you idiiot")[2] > 0 and s.features("") == [0.0] * tx.FEATURES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit >= 0.8 * sum(r.toxic for r in rows) and sum(r.predicted and not r.toxic for r in rows) <= 0.01 * len(rows)


def test_awkward_rows(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = tx.score(awkward, none).collect()
    assert len(got) == awkward.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert tx.score(awkward.limit(0), none).count() == 0
    assert tx.score(spark.createDataFrame([(1, "you idiot, moron")], "doc_id long, text string"), none).first().predicted == 1
