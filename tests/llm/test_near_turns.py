"""Turned rows against the expression of a turn; the plan doesn't grow with the turns."""

from pyspark.sql import functions as F

from attesta.llm import near as N
from attesta.llm.simhash import turned, turns_of


def test_turned_rows_and_the_size_of_their_plan(spark):
    own = spark.range(50).select(F.xxhash64("id").alias("fp"), F.col("id").alias("sig"), F.lit(7).cast("long").alias("n"))
    few, many = turns_of(8, 2), turns_of(8, 3)
    rows = N._turned_rows(own, few)
    want = {(k, r.sig, r.key) for k, (order, _) in enumerate(few) for r in own.select("sig", turned(F.col("fp"), order).alias("key")).collect()}
    assert {(r.turn, r.sig, r.key) for r in rows.collect()} == want and rows.count() == len(want)
    size = lambda turns: len(N._turned_rows(own, turns)._jdf.queryExecution().optimizedPlan().treeString())
    assert len(many) == 165 and size(many) < 1.02 * size(few) < 2_000
