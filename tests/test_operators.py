"""Golden values and metamorphic checks of the audits."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import tiers as T
from attesta.functions.hashing import EMPTY_SHA256, hamming
from attesta.operators import chain as C
from attesta.operators import drift as D
from attesta.operators import fusion as U
from attesta.operators import lineage as L
from attesta.operators import merkle as M
from attesta.operators.components import connected_components
from attesta.operators.detectors import nearest
from attesta.operators.similarity import _masks, hash_pairs


def merkle(leaves):
    level = list(leaves)
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10])
def test_merkle_root_and_proofs(spark, n):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    leaves = spark.createDataFrame(list(enumerate(hashes)), "idx long, hash string")
    assert M.root(leaves).first().root == merkle(hashes)
    rows = M.verify(M.proofs(leaves, leaves).withColumn("root", F.lit(merkle(hashes)))).collect()
    assert len(rows) == n and all(r.valid for r in rows)


def test_empty_merkle_root(spark):
    assert M.root(spark.createDataFrame([], "idx long, hash string")).first().root == EMPTY_SHA256


def test_one_tampered_block_fails_once(spark):
    links = spark.createDataFrame([(c, i, "t", f"d{i}") for c in (1, 2) for i in range(20)], "chain long, seq long, stamp string, data_hash string")
    built = C.build(links)
    clean = C.verdicts(C.checks(built)).collect()
    assert all(r.first_bad is None and r.verified == 20 for r in clean)
    bad = built.withColumn("data_hash", F.when((F.col("chain") == 2) & (F.col("seq") == 7), "x").otherwise(F.col("data_hash")))
    checked = C.checks(bad)
    assert [(r.chain, r.seq, r.reason) for r in checked.where("reason is not null").collect()] == [(2, 7, "HASH")]
    assert {r.chain: r.first_bad for r in C.verdicts(checked).collect()} == {1: None, 2: 7}


def rows(spark, base, target):
    return spark.createDataFrame([("f", float(v), True) for v in base] + [("f", float(v), False) for v in target], "feature string, value double, base boolean")


def test_drift_of_alike_and_apart(spark):
    same = rows(spark, range(50), range(50))
    apart = rows(spark, range(50), range(100, 150))
    assert D.ks_distance(same).first().ks == 0 and D.ks_distance(apart).first().ks == 1
    for stat, name in ((D.psi, "psi"), (D.wasserstein, "w1"), (D.energy_distance, "energy")):
        assert stat(same).first()[name] == pytest.approx(0, abs=1e-9) and stat(apart).first()[name] > 1
    flat = rows(spark, [1, 1], [1, 1])
    assert D.psi(flat).first().psi == 0 and D.ks_distance(flat).first().ks == 0


def fused(spark, *items):
    data = [(f"e{i}", "t", *x, False) for i, x in enumerate(items)]
    return U.fuse(spark.createDataFrame(data, "evidence_id string, target string, source string, severity string, metric double, description string, hard_veto boolean")).first()


def test_fusion_rules(spark):
    low = fused(spark, ("DATA_INTEGRITY", "LOW", 0.0, "ok"))
    assert low.status == "ACCEPTED" and low.action == "ALLOW"
    veto = fused(spark, ("INFERENCE_DNA", "CRITICAL", 1.0, "replay detected"))
    assert veto.veto and veto.status == "QUARANTINED" and "PROVENANCE_FAILURE" in veto.threats
    drift = fused(spark, ("DISTRIBUTION_SHIFT", "CRITICAL", 1.0, "severe shift"))
    assert drift.status == "UNDER_REVIEW" and not drift.veto and drift.risk <= 0.65
    both = fused(spark, ("DISTRIBUTION_SHIFT", "HIGH", 0.5, "shift"), ("BEHAVIOURAL_FINGERPRINT", "HIGH", 0.5, "divergence"))
    assert both.status == "QUARANTINED" and both.risk >= 0.85 and "COORDINATED_EVASION" in both.threats
    single = fused(spark, ("MODEL_IDENTITY", "HIGH", 0.2, "odd"))
    assert single.status == "UNDER_REVIEW" and single.risk == 0.5
    benign = fused(spark, ("DISTRIBUTION_SHIFT", "MEDIUM", 0.2, "sensor change at dusk"))
    assert benign.threats == ["BENIGN_DRIFT"] and benign.risk == 0.35


def test_traces_keep_the_asymmetry_of_provided(spark):
    nodes = spark.createDataFrame([("a", "CONTRIBUTOR"), ("b", "DATASET"), ("r", "TRAINING_RUN"), ("m", "MODEL"), ("x", "INFERENCE")], "id string, node_type string")
    edges = spark.createDataFrame([("a", "b", "PROVIDED"), ("r", "b", "TRAINED_ON"), ("m", "r", "PRODUCED"), ("x", "m", "GENERATED_BY"), ("x", "gone", "GENERATED_BY")], "source_id string, target_id string, edge_type string")
    up = L.dependencies(edges, nodes)
    reach = lambda steps, i: {r.id: r.depth for r in L.trace(steps, nodes.where(F.col("id") == i)).collect()}
    assert reach(up, "x") == {"m": 1, "r": 2, "b": 3, "a": 4} and reach(up, "a") == {"b": 1}
    down = L.dependencies(edges, nodes, downstream=True)
    assert reach(down, "a") == {"b": 1, "r": 2, "m": 3, "x": 4} and reach(down, "b") == {"r": 1, "m": 2, "x": 3}
    r = L.integrity(edges, nodes).first()
    assert r.broken == 1 and not r.valid and r.orphans == 0


def test_components_of_paths_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_tiers(spark):
    df = spark.createDataFrame([(" Anonymous ", "quarantined!", 0.6), (None, None, 0.1), ("bob", "all clean", 0.9)], "n string, s string, x double")
    got = df.select(T.clean_identity(F.col("n")), T.normal_status(F.col("s")), T.tier(F.col("x"), [(0.85, "A"), (0.6, "B")], "C"), hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))).collect()
    assert [tuple(r) for r in got] == [("UNKNOWN", "critical", "B", 64), ("UNKNOWN", "unknown", "C", 64), ("bob", "normal", "A", 64)]


def test_merkle_root_over_several_blocks(spark):
    for n in (1023, 1024, 1025, 3001):
        hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        assert M.root(spark.createDataFrame(list(enumerate(hashes)), "idx long, hash string").repartition(3)).first().root == merkle(hashes)


def test_admission_keeps_what_was_seen_as_it_goes(spark):
    """What is turned away reserves nothing: the third row may have the id that the second one wanted."""
    kind = "o long, chain string, seq long, record string, nonce string"
    new = [(1, "c", 5, "A", "x"), (2, "c", 6, "B", "x"), (3, "c", 7, "B", "y"), (4, "c", 8, "A", "z"), (5, "d", 1, "C", "n0"), (6, "d", 2, "D", "d"), (7, "d", 2, "E", "e"), (8, "c", 2, "F", "f")]
    history = spark.createDataFrame([(0, "c", 4, "H", "h"), (0, "d", 0, "I", "n0")], kind)
    judged = C.admit(spark.createDataFrame(new, kind), history, record="record", nonce="nonce", seq="seq", key="chain", order="o")
    assert {r.o: r.outcome for r in judged.collect()} == {1: "ADMITTED", 2: "REUSED_NONCE", 3: "ADMITTED", 4: "REUSED_RECORD", 5: "REUSED_NONCE", 6: "ADMITTED", 7: "ROLLBACK", 8: "ROLLBACK"}


def admitted_in_order(new, history):
    """One record after the other, as a single service would take them."""
    records, nonces, counter = {h[3] for h in history}, {h[4] for h in history}, {}
    for h in history:
        counter[h[1]] = max(counter.get(h[1], 0), h[2])
    out = {}
    for o, chain, seq, record, nonce in sorted(new):
        now = counter.get(chain, 0)
        if record in records:
            out[o] = ("REUSED_RECORD", None)
        elif nonce in nonces:
            out[o] = ("REUSED_NONCE", None)
        elif seq is not None and seq <= now:
            out[o] = ("ROLLBACK", None)
        else:
            counter[chain] = now + 1 if seq is None else seq
            records.add(record)
            nonces.add(nonce)
            out[o] = ("ADMITTED", counter[chain])
    return out


def test_admission_matches_one_after_the_other(spark):
    kind = "o long, chain string, seq long, record string, nonce string"
    assert {o: r[0] for o, r in admitted_in_order([(1, "c", 10, "a", "a"), (2, "c", 9, "b", "b"), (3, "c", 11, "c", "c")], []).items()} == {1: "ADMITTED", 2: "ROLLBACK", 3: "ADMITTED"}
    rng = random.Random(6)
    new = [(k, rng.choice("ab"), rng.choice([None, k + rng.randint(-6, 6), k + rng.randint(0, 3)]), f"r{rng.randint(0, 250)}", f"n{rng.randint(0, 400)}") for k in range(1, 300)]
    new += [(1000, "c", 10, "x1", "y1"), (1001, "c", 9, "x2", "y2"), (1002, "c", 11, "x3", "y3"), (1003, "d", None, "x4", "y4")]
    history = [(0, "a", 3, "r1", "n1"), (0, "a", 2, "r2", "n2")]
    judged = C.admit(spark.createDataFrame(new, kind), spark.createDataFrame(history, kind), record="record", nonce="nonce", seq="seq", key="chain", order="o")
    assert {r.o: (r.outcome, r.assigned) for r in judged.collect()} == admitted_in_order(new, history)


def test_one_chain_is_verified_in_parts(spark):
    """Pointers and numbers hold over the edges of the ranges."""
    links = spark.createDataFrame([("a", k, f"s{k}", f"d{k}") for k in range(5000)], "chain string, seq long, stamp string, data_hash string")
    built = C.build(links)
    whole = C.checks(built)
    assert whole.where("reason is not null").count() == 0 and whole.agg({"position": "max"}).first()[0] == 4999
    cut_at = [1250, 2500, 3750, 17]
    bad = built.withColumn("prev_hash", F.when(F.col("seq").isin(cut_at), "x").otherwise(F.col("prev_hash")))
    assert sorted((r.seq, r.reason) for r in C.checks(bad).where("reason is not null").collect()) == [(k, "POINTER") for k in sorted(cut_at)]


def test_quantiles_by_ranks(spark):
    rng = np.random.default_rng(1)
    base, target = rng.integers(0, 40, 301).astype(float), rng.normal(size=57)
    steps = D.ranked(rows(spark, base, target))
    at = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    q = D.quantiles(steps, at, "q").first()
    assert q.q_b == pytest.approx(np.quantile(base, at).tolist()) and q.q_t == pytest.approx(np.quantile(target, at).tolist())
    one = D.psi(rows(spark, range(50), [])).first()
    assert one.psi == 0 and D.wasserstein(rows(spark, range(50), [])).first().w1 == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(5, 8)), 20, axis=0)])
    df = spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(x)], "id long, label long, v array<double>").repartition(5)
    got = {}
    for r in nearest(df.where("id % 10 = 0"), df, "id", "label", "v", 3).collect():
        got.setdefault(r.x, []).append((r.d, r.y))
    for i in range(0, len(x), 10):
        d = ((x - x[i]) ** 2).sum(axis=1)
        want = sorted(range(len(x)), key=lambda j: (round(d[j], 12), j))[:3]
        assert [j for _, j in sorted(got[i])] == want


def test_subgraph_of_a_batch(spark):
    edges = [("m", "b", "TRAINED_ON"), ("m", "other", "TRAINED_ON"), ("b", "who", "AUTHORED_BY"), ("x", "who", "AUTHORED_BY"), ("i", "m", "GENERATED_BY"), ("j", "m", "GENERATED_BY")]
    nodes = [("b", "DATASET", None), ("other", "DATASET", None), ("m", "MODEL", None), ("who", "CONTRIBUTOR", None), ("x", "MODEL", None), ("i", "INFERENCE", None), ("j", "INFERENCE", "other"), ("r", "REPORT", "b")]
    n = spark.createDataFrame([(*v, None, None) for v in nodes], "id string, node_type string, batch_id string, dataset_id string, scan_id string")
    e = spark.createDataFrame(edges, "source_id string, target_id string, edge_type string")
    got = L.batch_subgraph(e, n, spark.createDataFrame([("b",), ("nothing",)], "id string")).collect()
    assert {r.root for r in got} == {"b"} and {r.id for r in got} == {"b", "m", "who", "i", "r"}


def test_traces_of_many_roots_match_a_walk_of_each(spark):
    """More roots than a word has bits, with cycles, hubs and a depth that cuts."""
    rng = random.Random(8)
    steps = {(f"n{rng.randint(0, 90)}", f"n{int(rng.random() ** 3 * 90)}") for _ in range(260)}
    names = [f"n{k}" for k in range(91)] + ["alone"]
    df = spark.createDataFrame(sorted(steps), "src string, dst string")
    got = L.trace(df, spark.createDataFrame([(n,) for n in names + names[:3]], "id string"), max_depth=4)
    found = {}
    for r in got.collect():
        assert (r.root, r.id) not in found
        found[r.root, r.id] = r.depth
    for root in names:
        depth, edge = {root: 0}, {root}
        for d in range(1, 5):
            edge = {b for a, b in steps if a in edge and b not in depth}
            depth |= dict.fromkeys(edge, d)
        assert {k[1]: v for k, v in found.items() if k[0] == root} == {k: v for k, v in depth.items() if v}


@pytest.mark.parametrize("n, budget", [(60, 4), (3000, 4), (3000, 3), (1500, 10)])
def test_hash_pairs_match_brute_force(spark, n, budget):
    """Random hashes, near ones at every distance, and the ends of the range."""
    rng = random.Random(n + budget)
    hashes = {rng.getrandbits(64) for _ in range(n)} | {0, 1, (1 << 64) - 1, 1 << 63}
    for h in rng.sample(sorted(hashes), 50):
        for d in range(1, budget + 3):
            hashes.add(h ^ sum(1 << k for k in rng.sample(range(64), d)))
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = [tuple(r) for r in hash_pairs(spark.createDataFrame([(h,) for h in signed + signed[:9]], "h long"), "h", budget).collect()]
    x = np.array(sorted(signed), np.int64)
    want = {(int(x[i]), int(x[j]), int(c)) for i in range(len(x)) for c, j in zip(np.bitwise_count((x[i] ^ x[i + 1 :]).view(np.uint64)), range(i + 1, len(x))) if c <= budget}
    assert len(got) == len(set(got)) and set(got) == want
    assert [len(_masks(k, 4, 64)) for k in (1000, 10**5, 10**6, 10**8)] == [5, 15, 15, 35]
