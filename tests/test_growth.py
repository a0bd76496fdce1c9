"""What keeps the work of a task, a shuffle or the driver from growing faster than the tables."""

import json
import math
import random
import time

from pyspark.sql import functions as F

from attesta.functions.canonical import double_text, zoneless_text
from attesta.operators import chain as C
from attesta.operators import rows as R
from attesta.operators.lineage import neighbours
from attesta.operators.similarity import exempt_triggers
from attesta.plans.prefix import dealt, scanned
from attesta.sources import files as S


def test_ids_hold_within_a_document(spark, tmp_path):
    for name, kind in (("a", "cat"), ("b", "dog")):
        doc = {"images": [{"id": 1, "file_name": f"{name}.png", "width": 4, "height": 4}], "annotations": [{"image_id": 1, "category_id": 5, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 5, "name": kind}]}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    files = spark.createDataFrame([("x/a.png",), ("y/a.png",), ("b.png",)], "path string")
    found = {r.sample_id: [x.category for x in r.labels] for r in S.coco(spark, str(tmp_path), files).collect()}
    assert found == {"a.png": ["cat"], "b.png": ["dog"]}


def test_common_rows_are_grouped_and_not_joined(spark):
    left, right = (spark.createDataFrame([(k,) for k in v], "k int") for v in ([0, 1, 2, None] * 9, [0, 1, 5, None] * 9))
    found = R.common(left, right)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and {r.k for r in found.collect()} == {0, 1, None}


def test_doubles_of_few_digits_are_quick_and_right(spark):
    texts = "0.001 0.0012 0.01 0.1 1.5 123.45 9999999.0 1234567.89 1e16 1.25e16 1.2345e17 -2e23 5e99 1e100 100.0 1e15 1e7 12345678.9 0.1234567890123456 0.30000000000000004 9.999999999999999e22 1e-4 0.00099999 -0.0 2e-3".split()
    rows = spark.createDataFrame([(float(t),) for t in [*texts, *("-" + t.lstrip("-") for t in texts)]], "v double")
    assert all(r.t == repr(r.v) for r in rows.select("v", double_text(F.col("v")).alias("t")).collect())

    def took(value):
        began = time.perf_counter()
        spark.range(0, 60_000, 1, 2).select(F.sum(F.length(double_text(value)))).collect()
        return time.perf_counter() - began

    took(F.col("id") / 100)
    assert 2 * took(F.col("id") / 100) < took(F.sqrt("id"))


def test_doubles_of_many_digits_are_right(spark):
    rng = random.Random(7)
    some = [rng.uniform(1e15, 9.3e18) for _ in range(3000)] + [round(rng.uniform(0, 700), 2) * 1e15 for _ in range(3000)] + [10 ** rng.uniform(15, 24) for _ in range(2000)] + [10 ** rng.uniform(-8, 15) for _ in range(2000)] + [rng.uniform(0, 700) / 3 for _ in range(500)]
    edges = [x for b in range(50, 66) for x in (2.0**b, math.nextafter(2.0**b, 0), math.nextafter(2.0**b, 1e300))] + [x for e in range(14, 24) for x in (10.0**e, math.nextafter(10.0**e, 0), math.nextafter(10.0**e, 1e300), 9 * 10.0**e)]
    rows = spark.createDataFrame([(x,) for v in some + edges for x in (v, -v)] + [(None,)], "v double")
    assert [(r.v, r.t) for r in rows.select("v", double_text(F.col("v")).alias("t")).collect() if r.t != (r.v if r.v is None else repr(r.v))] == []


def test_times_without_zone_keep_their_digits(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02 03:04:05.5", "2024-01-02 03:04:05.000001", "0001-01-01 00:00:00", "12024-01-02 03:04:05.25"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r.x for r in rows.select(zoneless_text(F.col("t")).alias("x")).collect()] == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.500000+00:00", "2024-01-02T03:04:05.000001+00:00", "0001-01-01T00:00:00+00:00", "+12024-01-02T03:04:05.250000+00:00", None]


def test_exemptions_are_those_of_all_pairs_with_any_pivots(spark):
    rng = random.Random(5)
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(56), n))
    rows = []
    for f, (kinds, spread) in {"far": (40, 28), "close": (30, 4), "mixed": (30, 6), "one": (1, 0)}.items():
        base = rng.getrandbits(56)
        rows += [(f, len(rows) + k, flip(base, spread), flip(base, 28)) for k in range(kinds)]
    rows.append(("mixed", 900, flip(rows[-2][2], 20), 0))
    rows.append(("one", 901, *rows[-2][2:]))
    near = lambda x, y: bin(x[2] ^ y[2]).count("1") <= 10 or bin(x[2] ^ y[3]).count("1") <= 10
    of = lambda x: [y for y in rows if y[0] == x[0] and y[1] != x[1]]
    want = {(x[0], x[1], not (of(x) and all(near(x, y) for y in of(x)))) for x in rows}
    members = spark.createDataFrame(rows, "f string, s long, h long, m long")
    for pivots in (0, 1, 8):
        assert {tuple(r) for r in exempt_triggers(members, "f", "s", "h", "m", pivots=pivots).collect()} == want
    assert {c for _, _, c in want} == {True, False}


def test_neighbours_with_loops_copies_and_missing_ends(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "a"), ("a", "a"), ("c", "gone"), ("gone", "a"), (None, "c"), ("c", None), ("b", "c")]
    nodes = spark.createDataFrame([(x, "T") for x in "abcd"], "id string, node_type string")
    found = neighbours(spark.createDataFrame([(*e, "E") for e in edges], "source_id string, target_id string, edge_type string"), nodes)
    assert {tuple(r) for r in found.collect()} == {("a", 3, 3, 1), ("b", 2, 2, 2), ("c", 2, 2, 1), ("d", 0, 0, 0)}
    assert "count(distinct" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_scan_moves_its_rows_once(spark):
    rows = spark.createDataFrame([(k % 3 or None, k, 1) for k in range(50)], "k int, at int, one int")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = scanned(dealt(rows, ["k"], ["at"]), ["k"], ["at"], sums={"n": "one"})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4 and sorted(r.n for r in out.where("k is null").collect()) == [*range(1, 18)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_texts_of_ledger_events_are_compiled(spark):
    events = spark.range(100).select(F.col("id").alias("seq"), *[F.concat(F.lit(f"{f} "), "id").alias(f) for f in C.LEDGER_FIELDS if f != "sequence"])
    head, tail = C.ledger_envelope(events)
    plan = events.select(head.alias("h"), tail.alias("t"))._jdf.queryExecution().executedPlan()
    stages = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(plan)
    # HotSpot never compiles a method of over 8,000 bytes.
    assert max([stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())], default=0) <= 8000
    row = events.select(*events.columns, head.alias("h"), tail.alias("t")).where("seq = 7").first()
    want = {f: row["seq" if f == "sequence" else f] for f in C.LEDGER_FIELDS} | {"previous_hash": "p"}
    assert row.h + "p" + row.t == json.dumps(want, sort_keys=True, separators=(",", ":"))


def test_chains_are_checked_without_building_them_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    links = spark.createDataFrame([(c, k, f"s{k}", f"d{c}", c + k) for c in range(4) for k in range(25)], "chain int, seq int, stamp string, data_hash string, extra int")
    built = C.build(links)
    bad = built.withColumn("stamp", F.when(F.col("seq") == 9, F.col("chain").cast("string")).otherwise(F.col("stamp"))).mapInArrow(counted, built.schema)
    found = C.checks(bad, keep=["extra"])
    assert {(r.chain, r.seq, r.reason, r.extra) for r in found.collect() if r.reason} == {(c, 9, "HASH", c + 9) for c in range(4)}
    assert seen.value == 100 and found.columns == ["chain", "seq", "extra", "prev_hash", "current_hash", "position", "expected_prev", "prev_seq", "reason"]
    assert {"stamp", "data_hash"} <= {*C.checks(bad).columns}
