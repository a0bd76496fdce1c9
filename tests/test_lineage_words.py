"""What traces shuffle: rows of words, not rows of roots."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import lineage as L


@pytest.fixture
def wide(spark):
    """No broadcasts, as on large tables."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def most_shuffled(spark, run):
    """The most records that a stage of ``run`` sends to a shuffle."""
    def stages():
        found = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = set(stages())
    run()
    return max(n for k, n in stages().items() if k not in before)


def test_a_trace_multiplies_to_roots_after_its_last_shuffle(wide):
    hub = wide.range(256).select(F.concat(F.lit("r"), "id").alias("src"), F.lit("hub").alias("dst"))
    leaves = wide.range(200).select(F.lit("hub").alias("src"), F.concat(F.lit("leaf"), "id").alias("dst"))
    roots = hub.select(F.col("src").alias("id"))
    got = []
    assert most_shuffled(wide, lambda: got.append(L.trace(hub.union(leaves), roots).count())) < 2_000
    assert got == [256 * 201]


def test_counts_by_bit(spark):
    words = L.words_of(spark.range(130).select(F.format_string("r%03d", "id").alias("id")))
    rows = spark.range(130).select(F.format_string("r%03d", "id").alias("root"), F.explode(F.sequence(F.lit(0), F.col("id").cast("int") % 5)).alias("k")).join(words, "root")
    masked = rows.groupBy("word", F.col("k").alias("id")).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    assert {r.root: r.n for r in L.counted(masked, words, "n").collect()} == {f"r{k:03d}": k % 5 + 1 for k in range(130)}
    assert L.each_root(masked, words).count() == rows.count()
