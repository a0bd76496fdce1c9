"""Stand-in tables that Spark derives from the given ones, each beside the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions.hashing import ahash, dhash
from attesta.plans.lineage import shuffle_partitions
from attesta.plans.registry import table

GENESIS = "0" * 64

# -- image grids: embeddings as 8 x 8 grey pixels -------------------------------------------------------------------------
GRID_SQL = "grid AS (SELECT vec_id, label, list_transform(embedding, lambda x: greatest(0, least(255, round(128 + 255 * x::DOUBLE)))::INT) AS px FROM embeddings)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(F.lit(128.0) + F.lit(255.0) * x.cast("double")))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", px.alias("px"))


GRID_DUP_SQL = (
    GRID_SQL
    + """, planted AS (SELECT vec_id, label, CASE
  WHEN vec_id % 25 = 0 THEN list_concat([0, 255, 0, 255], px[5:8], [255, 0, 255, 0], px[13:16], [0, 255, 0, 255], px[21:24], [255, 0, 255, 0], px[29:64])
  WHEN vec_id % 50 = 1 THEN list_concat([0, 0, 255, 255], px[5:8], [0, 0, 255, 255], px[13:16], [0, 0, 255, 255], px[21:24], [0, 0, 255, 255], px[29:64])
  ELSE px END AS px FROM grid),
grid_dup AS (SELECT vec_id, label, px FROM planted UNION ALL
  SELECT vec_id + 1000000, CASE WHEN vec_id % 30 = 0 THEN label + 1 ELSE label END, list_concat([255], px[2:64]) FROM planted WHERE vec_id % 10 = 0)"""
)


def grid_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with planted corners, and near copies of every tenth, every third of these with another label."""
    px = F.col("px")
    part = lambda a, b: F.slice(px, a, b - a + 1)
    rows = lambda *r: F.concat(*[x for k, v in enumerate(r) for x in (F.array(*[F.lit(i) for i in v]), part(8 * k + 5, 8 * k + 8 if k < 3 else 64))])
    block = rows((0, 255, 0, 255), (255, 0, 255, 0), (0, 255, 0, 255), (255, 0, 255, 0))
    halves = rows(*[(0, 0, 255, 255)] * 4)
    planted = grid(spark, sf_dir).withColumn("px", F.when(F.col("vec_id") % 25 == 0, block).when(F.col("vec_id") % 50 == 1, halves).otherwise(px))
    copies = planted.where("vec_id % 10 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.when(F.col("vec_id") % 30 == 0, F.col("label") + 1).otherwise(F.col("label")).alias("label"), F.concat(F.array(F.lit(255)), part(2, 64)).alias("px"))
    return planted.unionByName(copies)


DHASH_SQL = "list_reduce(list_transform(range(0, 56), lambda i: CASE WHEN px[(i // 7) * 8 + i % 7 + 1] > px[(i // 7) * 8 + i % 7 + 2] THEN 1 ELSE 0 END::BIGINT), lambda a, b: a * 2 + b)"
GRID_HASH_SQL = GRID_DUP_SQL + f", hashed AS (SELECT vec_id, label, px, {DHASH_SQL} AS dh, sha256(array_to_string(px, ',')) AS sha FROM grid_dup)"


def hashed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_dup(spark, sf_dir).withColumns({"dh": dhash(F.col("px")), "sha": F.sha2(F.concat_ws(",", F.transform("px", lambda x: x.cast("string"))), 256)})


def with_ahash(df: DataFrame) -> DataFrame:
    return df.withColumn("ah", ahash(F.col("px")))


# -- feature tables: lineitem unpivoted -----------------------------------------------------------------------------------
FEATURES_SQL = """feats AS (SELECT feature, value, base FROM (
  SELECT l_shipdate < TIMESTAMP '1998-01-01' AS base, unnest([{'feature': 'l_quantity', 'value': l_quantity}, {'feature': 'l_extendedprice', 'value': l_extendedprice}, {'feature': 'l_discount', 'value': l_discount}, {'feature': 'l_tax', 'value': l_tax}], recursive := true) FROM lineitem))"""
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in FEATURES])
    base = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").select(base.alias("base"), F.inline(pairs))


# -- evidence: events as findings about users -----------------------------------------------------------------------------
EVIDENCE_SQL = """ev AS (SELECT 'ev_' || event_id AS evidence_id, user_id AS target, ts,
  CASE event_type WHEN 'signup' THEN 'DATA_INTEGRITY' WHEN 'error' THEN 'MODEL_IDENTITY' WHEN 'click' THEN 'BEHAVIOURAL_FINGERPRINT' WHEN 'view' THEN 'INFERENCE_DNA' ELSE 'DISTRIBUTION_SHIFT' END AS source,
  CASE WHEN value >= 200 THEN 'CRITICAL' WHEN value >= 100 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  least(value / 500, 1) AS metric,
  CASE event_id % 7 WHEN 0 THEN 'trigger pattern found' WHEN 1 THEN 'hash mismatch' WHEN 2 THEN 'replay of a record' WHEN 3 THEN 'output divergence' WHEN 4 THEN 'sensor drift at dusk' WHEN 5 THEN 'severe entropy shift' ELSE 'routine check' END AS description,
  event_id % 997 = 5 AS hard_veto, 'day' || cast(date_part('day', ts) AS BIGINT) AS day FROM events)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    source = F.when(F.col("event_type") == "signup", "DATA_INTEGRITY").when(F.col("event_type") == "error", "MODEL_IDENTITY").when(F.col("event_type") == "click", "BEHAVIOURAL_FINGERPRINT").when(F.col("event_type") == "view", "INFERENCE_DNA").otherwise("DISTRIBUTION_SHIFT")
    v = F.col("value")
    severity = F.when(v >= 200, "CRITICAL").when(v >= 100, "HIGH").when(v >= 40, "MEDIUM").otherwise("LOW")
    said = F.array(*[F.lit(x) for x in ("trigger pattern found", "hash mismatch", "replay of a record", "output divergence", "sensor drift at dusk", "severe entropy shift", "routine check")])
    return e.select(
        F.concat(F.lit("ev_"), F.col("event_id")).alias("evidence_id"), F.col("user_id").alias("target"), "ts", source.alias("source"), severity.alias("severity"),
        F.least(v / 500, F.lit(1.0)).alias("metric"), F.get(said, (F.col("event_id") % 7).cast("int")).alias("description"), (F.col("event_id") % 997 == 5).alias("hard_veto"),
        F.concat(F.lit("day"), F.dayofmonth("ts")).alias("day"),
    )


# -- chains: events per user, hash-chained --------------------------------------------------------------------------------
CHAIN_SQL = f"""RECURSIVE links AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, sha256(event_type || ':' || event_id) AS data_hash FROM events),
chained(chain, seq, stamp, data_hash, prev_hash, current_hash) AS (
  SELECT chain, seq, stamp, data_hash, '{GENESIS}', sha256(seq || stamp || data_hash || '{GENESIS}') FROM links WHERE seq = 0
  UNION ALL SELECT l.chain, l.seq, l.stamp, l.data_hash, c.current_hash, sha256(l.seq || l.stamp || l.data_hash || c.current_hash) FROM chained c JOIN links l ON l.chain = c.chain AND l.seq = c.seq + 1)"""


def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("chain"), seq.cast("long").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.sha2(F.concat_ws(":", "event_type", "event_id"), 256).alias("data_hash"))


CHAIN_BAD_SQL = (
    CHAIN_SQL
    + f""", chain_bad AS (SELECT chain, seq, stamp, CASE WHEN chain % 4 = 1 AND seq = 3 THEN sha256('x') ELSE data_hash END AS data_hash,
  CASE WHEN chain % 4 = 2 AND seq = 5 THEN '{GENESIS}' ELSE prev_hash END AS prev_hash, current_hash FROM chained WHERE NOT (chain % 4 = 3 AND seq = 7))"""
)


def break_chains(chained: DataFrame) -> DataFrame:
    """Chains of every remainder of four but zero are broken in another way: changed data, changed pointer, lost block."""
    c, s = F.col("chain") % 4, F.col("seq")
    bad = chained.where(~((c == 3) & (s == 7)))
    return bad.withColumns({"data_hash": F.when((c == 1) & (s == 3), F.sha2(F.lit("x"), 256)).otherwise(F.col("data_hash")), "prev_hash": F.when((c == 2) & (s == 5), GENESIS).otherwise(F.col("prev_hash"))})


# -- lineage: suppliers, parts, orders and customers ----------------------------------------------------------------------
EDGES_SQL = """edges AS (
  SELECT DISTINCT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id, 'AUTHORED_BY' AS edge_type FROM lineitem
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'TRAINED_ON' FROM lineitem
  UNION ALL SELECT 'c' || o_custkey || '_' || o_orderkey, 'o' || o_orderkey, 'GENERATED_BY' FROM orders
  UNION ALL SELECT 'p0', 'missing', 'AUTHORED_BY')"""
NODES_SQL = """nodes AS (SELECT 's' || s_suppkey AS id, 'CONTRIBUTOR' AS node_type FROM supplier UNION ALL SELECT 'p' || p_partkey, 'DATASET' FROM part
  UNION ALL SELECT 'o' || o_orderkey, 'MODEL' FROM orders UNION ALL SELECT 'c' || o_custkey || '_' || o_orderkey, 'INFERENCE' FROM orders UNION ALL SELECT 'orphan', 'REPORT')"""
FINDINGS_SQL = """findings AS (SELECT DISTINCT 'f' || l_orderkey || '_' || l_partkey AS finding_id, 'o' || l_orderkey AS subject, CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
  FROM lineitem WHERE l_discount >= 0.09 AND l_tax >= 0.07 OR l_returnflag = 'R' AND l_quantity >= 49)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    parts = li.select("l_partkey", "l_suppkey").distinct().select(name("p", "l_partkey").alias("source_id"), name("s", "l_suppkey").alias("target_id")).withColumn("edge_type", F.lit("AUTHORED_BY"))
    n = max(shuffle_partitions(spark), li.count() // 1_000_000 + 1)
    models = li.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey", "l_partkey").distinct().select(name("o", "l_orderkey").alias("source_id"), name("p", "l_partkey").alias("target_id")).withColumn("edge_type", F.lit("TRAINED_ON"))
    runs = o.select(F.concat(F.lit("c"), "o_custkey", F.lit("_"), "o_orderkey").alias("source_id"), name("o", "o_orderkey").alias("target_id"), F.lit("GENERATED_BY").alias("edge_type"))
    broken = spark.range(1).select(F.lit("p0").alias("source_id"), F.lit("missing").alias("target_id"), F.lit("AUTHORED_BY").alias("edge_type"))
    return parts.union(models).union(runs).union(broken)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    kind = lambda df, i, k: df.select(i.alias("id"), F.lit(k).alias("node_type"))
    out = kind(t("supplier"), F.concat(F.lit("s"), "s_suppkey"), "CONTRIBUTOR").union(kind(t("part"), F.concat(F.lit("p"), "p_partkey"), "DATASET"))
    out = out.union(kind(t("orders"), F.concat(F.lit("o"), "o_orderkey"), "MODEL")).union(kind(t("orders"), F.concat(F.lit("c"), "o_custkey", F.lit("_"), "o_orderkey"), "INFERENCE"))
    return out.union(kind(spark.range(1), F.lit("orphan"), "REPORT"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    critical = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)
    rows = li.where((F.col("l_discount") >= 0.09) & (F.col("l_tax") >= 0.07) | critical)
    return rows.select(F.concat(F.lit("f"), "l_orderkey", F.lit("_"), "l_partkey").alias("finding_id"), F.concat(F.lit("o"), "l_orderkey").alias("subject"), F.when(critical, "CRITICAL").otherwise("HIGH").alias("severity")).distinct()
