"""Streams drained in micro-batches: values known and highest numbers kept over restarts, files in any order."""

import duckdb
from pyspark.sql import functions as F

from attesta.plans.suite import ORACLE_SQL, QUERIES
from attesta.streaming import frames as W
from tests.test_streams import feed, made, read


def test_replays_and_rollbacks_over_restarts(spark, tmp_path):
    rows = made(300)
    rows.append((10_000, "a", "1", "frame", rows[0][4], None))
    for k, part in enumerate((rows[:150], rows[150:300], rows[300:])):
        feed(spark, tmp_path / "in", part, f"f{k}")
        got = W.known_replays(read(spark, tmp_path / "in"), "n", "n", ["nonce", "record"], str(tmp_path / "out"))
        back = W.rollback_rows(read(spark, tmp_path / "in").withColumn("seq", F.col("h").cast("long")), "src", "n", "seq", str(tmp_path / "roll"))
    seen, want, top, backs = set(), {}, {}, {}
    for n, src, h, _, nonce, record in rows:
        own = {x for x in (("n", nonce), ("r", record)) if x[1]}
        want[n] = bool(own & seen)
        seen |= own
        backs[n] = int(h) <= top.get(src, -1)
        top[src] = max(top.get(src, -1), int(h))
    assert {r.n: r.replayed for r in got.collect()} == want and got.count() == len(want)
    assert {r.n: r.rollback for r in back.collect()} == backs and back.count() == len(backs)


def test_stream_queries_match_sql_whatever_files_the_events_lie_in(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3, F.col("event_id") % 3).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    for name in ("st05_rollbacks", "st05_replays_ever", "st03_rolling_buffer", "st04_buffer_reset"):
        c = con.execute(ORACLE_SQL[name])
        names = [x[0] for x in c.description]
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect())) == sorted(c.fetchall()), name


def test_rollbacks_among_numbers_below_the_first_floor(spark, tmp_path):
    events = spark.createDataFrame([(n, n % 2) for n in (3, 23, 43, 44, 63, 64, 83)], "event_id long, user_id long")
    events.selectExpr("event_id", "timestamp_ntz'2024-01-01' AS ts", "user_id", "'view' AS event_type", "1D AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    c = con.execute(ORACLE_SQL["st05_rollbacks"])
    want = sorted(c.fetchall())
    assert sorted(map(tuple, QUERIES["st05_rollbacks"](spark, str(tmp_path)).select(*[x[0] for x in c.description]).collect())) == want
    assert [r[3] for r in want if r[0] == 1] == [True, False, False, False, False]
    back = W.rollbacks(spark.readStream.schema("event_id long, user_id long").parquet(f"{tmp_path}/events.parquet").withColumn("seq", F.col("event_id") - 2000), "user_id", "event_id", "seq")
    kept = W.drained(back, f"{tmp_path}/state-out", f"{tmp_path}/state")
    assert [r.rollback for r in kept.where("user_id = 1").orderBy("event_id").collect()] == [True, False, False, False, False]
