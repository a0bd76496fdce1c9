import numpy as np

from attesta.llm import suffix_dedup as sd


def test_buckets_are_those_of_spark(spark):
    rng = np.random.default_rng(1)
    d, g = (rng.integers(-(1 << 63), (1 << 63) - 1, 200, dtype=np.int64) for _ in range(2))
    rows = spark.createDataFrame(list(zip(d.tolist(), g.tolist())), "d long, g long")
    want = [r.b for r in rows.selectExpr("pmod(xxhash64(d, g), 13) as b").collect()]
    assert sd._spread(13, d, g).tolist() == want


def test_copies_of_one_text_spread_over_tasks(spark, monkeypatch):
    """1,000 documents with one text: no task holds them all."""
    seen = spark.createDataFrame([(i, "a passage that all the documents share " * 5) for i in range(1000)], "doc_id long, text string")
    sizes = spark.sparkContext.accumulator(0)
    apply = sd._apply

    def watched(*args):
        run = apply(*args)

        def held(texts, ranges):
            sizes.add(texts.num_rows * texts.num_rows)
            return run(texts, ranges)

        return held

    monkeypatch.setattr(sd, "_apply", watched)
    got = sd.remove_repeats(seen, length=100).collect()
    assert len(got) == 1000 and sum(r._n_removed < r._n_bytes for r in got) == 1
    assert 1000 < sizes.value < 1000 * 1000 / 2


def test_hot_hash_is_sorted_in_parts(spark, monkeypatch):
    """One passage with other neighbours in each text, and room for few runs at once: as in one go."""
    rng = np.random.default_rng(2)
    passage = "".join(chr(97 + x) for x in rng.integers(0, 26, 120))
    rows = [(i, "".join(chr(97 + x) for x in rng.integers(0, 26, 90)) + passage + str(i) * 30) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, sd.remove_repeats(docs, length=100, digest=True).collect()))
    sort, most = sd._sort_runs, []

    def small(*args):
        run = sort(*args)

        def held(batches):
            sd.RUNS = 256
            return run(batches)

        return held

    monkeypatch.setattr(sd, "_sort_runs", small)
    assert sorted(map(tuple, sd.remove_repeats(docs, length=100, digest=True).collect())) == whole
    assert sum(r[3] > 0 for r in whole) == 59
