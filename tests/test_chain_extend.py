"""Chains that go on after a join whose partitions adaptive execution splits."""

import hashlib

from pyspark.sql import functions as F

from attesta.operators import chain as C


def test_extended_chains_stay_whole_when_a_join_is_split(spark):
    adaptive = {"autoBroadcastJoinThreshold": "-1", "coalescePartitions.enabled": "false", "skewJoin.skewedPartitionFactor": "0.5", "skewJoin.skewedPartitionThresholdInBytes": "1", "advisoryPartitionSizeInBytes": "1k"}
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1"} | {f"spark.sql.adaptive.{k}": v for k, v in adaptive.items()}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        tips = spark.range(20).select(F.col("id").alias("chain"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("tip"), "id").alias("current_hash"))
        rows = spark.range(2000).select((F.col("id") % 20).alias("chain"), F.col("id").alias("at"), F.concat(F.lit("d"), "id").alias("data")).repartition(4)
        got = {(r.chain, r.seq): r.current_hash for r in C.extend(tips, rows, order="at", payload=["seq", "data"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {}
    for c in range(20):
        prev = f"tip{c}"
        for k in range(100):
            prev = want[c, k + 1] = hashlib.sha256(f"{k + 1}d{c + 20 * k}{prev}".encode()).hexdigest()
    assert got == want
