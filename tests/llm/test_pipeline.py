"""The pipeline against brute force, stage by stage: each stage's input is what the stage before kept."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from test_decontaminate import brute as brute_items
from test_near import brute as brute_groups
from test_quality import base

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    now = docs
    for name, stage in cp.STAGES:
        now = cp.cut(stage(spark, now, SF))
        after = {r.doc_id: r for r in now.collect()}
        assert set(after) <= set(before)
        if name != "encoding":
            assert now.columns == docs.columns
        if name == "quality_rules":
            for i, r in after.items():
                b = base(r.text)
                assert b[0] >= 20 and 100 * b[4] <= 30 * b[0] and r == before[i]
        elif name == "near_dedup":
            assert set(after) == {i for i, _ in brute_groups([(i, r.text) for i, r in before.items()])} and len(after) < len(before)
        elif name == "suffix_dedup":
            first = {}
            for i in sorted(before):
                t = before[i].text.encode()
                for k in range(len(t) - 99):
                    first.setdefault(t[k : k + 100], (i, k))
            for i in before:
                t = before[i].text.encode()
                gone = {k + j for k in range(len(t) - 99) if first[t[k : k + 100]] < (i, k) for j in range(100)}
                assert after[i].text == bytes(c for k, c in enumerate(t) if k not in gone).decode(errors="ignore"), i
            assert set(after) == set(before)
        elif name == "decontamination":
            for i, r in before.items():
                n, hit, _ = brute_items(r.text, items, 10)
                assert (i in after) == (not hit or len(hit) <= 0.5 * n)
                assert i not in after or hit or after[i].text == r.text
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert all(r.token_ids == lib.encode(r.text, add_special_tokens=False).ids for r in after.values())
        before = after
    whole = {r.doc_id: r.token_ids for r in cp.run(spark, SF).collect()}
    assert whole == {i: r.token_ids for i, r in before.items()}


def test_awkward_tables(spark, awkward, tmp_path):
    """Null, empty, repeated and very long rows, columns with clashing names, and tables without rows go through all stages."""
    prose = "the quick brown fox jumps over the lazy dog near the old mill where many people of the town walk and talk every day "
    fair = [(k, prose + " ".join(f"w{k}x{i}" for i in range(60)), "en", "s", 100) for k in (20, 21, 22)]
    rows = awkward.union(spark.createDataFrame([*fair, fair[0], (None, fair[1][1] + " again", "en", None, None)], awkward.schema))
    clash = rows.withColumn("_fp", rows.doc_id).withColumn("_text", rows.lang).withColumn("sig", rows.source)
    for name, docs in (("some", clash), ("none", clash.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([("b1", "no such words anywhere in these rows at all my friend"), ("b2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(cp.STAGES):
            now = cp.cut(stage(spark, now, f"{tmp_path}/{name}"))
            assert set(clash.columns) <= set(now.columns) and (len(now.columns) == len(clash.columns)) == (k < 4)
        kept = now.collect()
        assert len(kept) == (0 if name == "none" else 3) and all(r.text is not None for r in kept)
        if name == "some":
            assert {r.doc_id for r in kept} == {20, 21, 22}


def test_an_empty_benchmark_hits_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.decontamination(spark, docs, str(tmp_path)).count() == 20
