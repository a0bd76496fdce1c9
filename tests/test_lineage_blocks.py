"""Traces in blocks: what they leave on disk, and that blocks, dead ends and pruned ways change no result."""

import os
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import lineage as L
from attesta.plans.lineage import cut, passing, shared_dir
from attesta.plans.suite import QUERIES


def left(spark):
    root = shared_dir(spark).removeprefix("file:")
    return {os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet")}


def reached(steps, root, depth):
    found, edge = {root: 0}, [root]
    for d in range(1, depth + 1):
        edge = [b for a, b in steps if a in edge and b not in found]
        found |= dict.fromkeys(edge, d)
    return found


@pytest.fixture
def tangle(spark):
    rng = random.Random(3)
    names = [f"n{k}" for k in range(60)]
    pairs = {(a, b) for a, b in (rng.sample(names, 2) for _ in range(110))} | {("n1", "n1")}
    return pairs, names, spark.createDataFrame(sorted(pairs), "src string, dst string")


@pytest.mark.parametrize("depth", [1, 2, 10])
def test_traces_by_blocks_are_those_of_breadth_first_search(spark, tangle, depth, monkeypatch):
    pairs, names, steps = tangle
    roots = spark.createDataFrame([(n,) for n in [*names, *(f"x{k}" for k in range(100))]], "id string")
    small = L.in_blocks
    monkeypatch.setattr(L, "in_blocks", lambda words, run, **more: small(words, run, **more | {"first": 1, "size": 1}))
    want = {(r, i, d) for r in names for i, d in reached(pairs, r, depth).items() if d}
    got = L.trace(steps, roots, depth).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_seed_where_all_ways_end_is_there_once(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    seeds = spark.createDataFrame([(0, "a", 1), (0, "c", 1), (0, "b", 2)], "word long, id string, mask long")
    got = {(r.id, r.mask, r.depth) for r in L.spread(L.fans(steps), seeds).collect()}
    assert got == {("a", 1, 0), ("c", 1, 0), ("b", 2, 0), ("b", 1, 1), ("c", 2, 1)}


def test_only_the_ways_to_targets_are_followed(spark, tangle):
    pairs, names, steps = tangle
    targets = {"n3", "n7"}
    kept = {tuple(r) for r in L.toward(steps, spark.createDataFrame([(t,) for t in targets], "id string")).select("src", "dst").collect()}
    assert kept == {(a, b) for a, b in pairs if targets & set(reached(pairs, b, 9))}


def test_tables_go_with_their_block(spark):
    before = left(spark)
    with passing(spark) as written:
        inner = cut(spark.range(10))
        assert written() > 0 and inner.count() == 10
        with passing(spark):
            cut(spark.range(20))
            kept, passed = cut(spark.range(30), keep=1), cut(spark.range(40), keep=2)
        assert kept.count() == 30
    assert passed.count() == 40
    assert len({f.split("/")[0] for f in left(spark) - before}) == 1


@pytest.mark.parametrize("name", ["g04_upstream", "g06_full_lineage", "r05_contributor_risk", "u05_cluster_union", "g09_blast_radius", "g11_subgraph", "g11_batch_subgraph", "s02_coco_document"])
def test_a_query_leaves_only_its_result(spark, name):
    before = left(spark)
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    rest = {f.split("/")[-2] for f in left(spark) - before}
    assert {f.split("/")[-2] for f in (x.removeprefix("file:") for x in found.inputFiles())} == rest
    assert found.agg(F.count("*")).first()[0] > 0
