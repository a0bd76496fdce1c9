"""Streams over several micro-batches and restarts against a plain loop."""

import random

from pyspark.sql import functions as F

from attesta.streaming import frames as W

SCHEMA = "n long, src string, h string, kind string, nonce string, record string"


def feed(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def made(n, start=0):
    rng = random.Random(start)
    return [(k, rng.choice("ab"), str(rng.randint(0, 8)), "reset" if rng.random() < 0.01 else "frame", f"n{k if rng.random() < 0.9 else rng.randint(0, max(k, 1))}", f"r{k if rng.random() < 0.95 else rng.randint(0, max(k, 1))}") for k in range(start, start + n)]


def test_buffers_hold_over_batches_and_restarts(spark, tmp_path):
    rows, got, held = made(400), None, None
    for k in range(4):
        feed(spark, tmp_path / "in", rows[100 * k : 100 * k + 100], f"f{k}")
        if k in (1, 3):  # two starts of two batches each
            got, held = W.verdict_buffer(read(spark, tmp_path / "in"), "src", "n", "h", str(tmp_path / "out"), held=50)
    want, buffers = {}, {"a": [], "b": []}
    for n, src, h, kind, *_ in rows:
        if kind == "reset":
            buffers[src] = []
            continue
        want[n] = h in [x[1] for x in buffers[src][-5:]]
        buffers[src] = [*buffers[src], (n, h)][-50:]
    assert {r.n: r.recent for r in got.collect()} == want and got.count() == len(want)
    assert {s: [(r.n, r.h) for r in held.where(F.col("src") == s).orderBy("n").collect()] for s in "ab"} == buffers


def test_replays_are_known_for_ever(spark, tmp_path):
    rows = made(300)
    rows.append((10_000, "a", "1", "frame", rows[0][4], "fresh"))  # long after, and after a restart
    for k, part in enumerate((rows[:150], rows[150:300], rows[300:])):
        feed(spark, tmp_path / "in", part, f"f{k}")
        found = W.drained(W.replays_ever(read(spark, tmp_path / "in"), "n", "n", ["nonce", "record"]), str(tmp_path / "out"), str(tmp_path / "state"))
    seen, want = set(), {}
    for n, _, _, _, nonce, record in rows:
        want[n] = bool({nonce, record} & seen)
        seen |= {nonce, record}
    assert {r.n: r.replayed for r in W.replayed_rows(found, "n").collect()} == want and want[10_000]
