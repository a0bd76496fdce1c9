"""Scans over ranges against a plain loop."""

import random

from attesta.plans.prefix import dealt, scanned


def test_scans_carry_over_parts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), k, rng.choice([None, *range(-50, 50)]), f"v{k}" if k % 7 else None) for k in range(3000)]
    rows.append(("lone", 0, None, None))
    df = spark.createDataFrame(rows, "k string, o long, x long, v string")
    got = scanned(dealt(df, ["k"], ["o"]), ["k"], ["o"], sums={"s": "x"}, maxima={"m": "x"}, lags={"v0": "v", "o0": "o"})
    assert got.select("_part").distinct().count() > 2
    found = {(r.k, r.o): (r.m, r.v0, r.o0) for r in got.collect()}
    assert len(found) == len(rows)
    state = {}
    for k, o, x, v in sorted(rows, key=lambda r: r[1]):
        m, v0, o0 = state.get(k, (None, None, None))
        m = x if m is None else m if x is None else max(m, x)
        assert found[k, o] == (m, v0, o0)
        state[k] = (m, v, o)
    sums = {(r.k, r.o): r.s for r in scanned(dealt(df.na.fill(0, ["x"]), ["k"], ["o"]), ["k"], ["o"], sums={"s": "x"}).collect()}
    total = {}
    for k, o, x, _ in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + (x or 0)
        assert sums[k, o] == total[k]
