"""Scalars, predicates, tiers, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.functions.canonical import canonical_text, spec_digest
from attesta.functions import tiers as T
from attesta.operators import rows as R
from attesta.plans import fixtures as fx
from attesta.plans.prefix import ordered_digest
from attesta.plans.registry import query, table

# -- hashes and canonical text --------------------------------------------------------------------------------------------
_JSON_SQL = """'{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}'"""


@query("f01_canonical_json", f"SELECT doc_id, {_JSON_SQL} AS canonical FROM documents")
def f01(s, d):
    return table(s, d, "documents").select("doc_id", H.canonical_json({c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars")}).alias("canonical"))


@query("f02_canonical_digest", f"SELECT doc_id, sha256({_JSON_SQL}) AS digest FROM documents")
def f02(s, d):
    return table(s, d, "documents").select("doc_id", H.canonical_digest({c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars")}).alias("digest"))


_NESTED = """'{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00","big":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE (value * 1e15)::DOUBLE::VARCHAR END || ',"day":"' || ts::DATE || '","map":{"' || event_type || '":' || event_id || ',"zz":null},"nested":{"flag":' || (event_id % 2 = 0) || ',"list":[{"a":' || user_id || ',"b":"' || replace(props, '"', '\\"') || '"},null]},"value":' || value || '}'"""


@query("f01_nested_json", f"SELECT event_id, {_NESTED} AS canonical FROM events")
def f01_nested(s, d):
    e, n = table(s, d, "events"), F.col("event_id")
    pair = F.struct(F.col("props").alias("b"), F.col("user_id").alias("a"))
    fields = {"value": F.col("value"), "at": F.col("ts"), "day": F.col("ts").cast("date"), "big": F.when(n % 5 != 0, F.col("value") * 1e15), "map": F.create_map(F.lit("zz"), F.lit(None).cast("long"), F.col("event_type"), n), "nested": F.struct(F.array(pair, F.lit(None)).alias("list"), (n % 2 == 0).alias("flag"))}
    return e.select("event_id", canonical_text(e, fields).alias("canonical"))


@query("f03_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def f03(s, d):
    return table(s, d, "documents").select("doc_id", H.content_digest(F.col("text")).alias("digest"))


@query("f04_digest_passthrough", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256(source) END AS digest FROM documents")
def f04(s, d):
    given = F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("text", 256))).otherwise(F.col("source"))
    docs = table(s, d, "documents")
    return docs.select("doc_id", spec_digest(docs, given).alias("digest"))


#: The configuration that stands where a record has none.
_CONFIG = {"batch_size": 1, "confidence_threshold": 0.5, "device": "cpu", "execution_provider": "CPUExecutionProvider", "extra_params": {}}


@query("f04_spec_digests", """SELECT event_id, sha256(CASE WHEN event_id % 3 = 0 THEN '{"batch_size":1,"confidence_threshold":0.5,"device":"cpu","execution_provider":"CPUExecutionProvider","extra_params":{}}' ELSE '{"batch_size":' || user_id || ',"confidence_threshold":' || value || ',"device":"' || event_type || '"}' END) AS config, sha256('{"output":[' || value || ',' || (value / 4)::VARCHAR || ']}') AS output FROM events""")
def f04_specs(s, d):
    """Configurations, some of them missing, and lists of outputs."""
    e = table(s, d, "events")
    config = F.when(F.col("event_id") % 3 != 0, F.struct(F.col("event_type").alias("device"), F.col("user_id").alias("batch_size"), F.col("value").alias("confidence_threshold")))
    return e.select("event_id", spec_digest(e, config, default=_CONFIG).alias("config"), spec_digest(e, F.array("value", F.col("value") / 4)).alias("output"))


@query("f05_hamming", f"WITH {fx.GRID_HASH_SQL} SELECT a.vec_id, bit_count(xor(a.dh, b.dh))::INT AS distance FROM hashed a JOIN hashed b ON b.vec_id = a.vec_id + 1")
def f05(s, d):
    h = fx.hashed_grid(s, d).select("vec_id", "dh")
    nxt = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("dh").alias("dh2"))
    return h.join(nxt, "vec_id").select("vec_id", H.hamming(F.col("dh"), F.col("dh2")).alias("distance"))


@query("f06_dhash", f"WITH {fx.GRID_HASH_SQL} SELECT vec_id, dh FROM hashed")
def f06(s, d):
    return fx.hashed_grid(s, d).select("vec_id", "dh")


@query(
    "f07_ahash",
    f"""WITH {fx.GRID_SQL}, m AS (SELECT vec_id, px, list_sum(px) / 64.0 AS mean FROM grid),
h AS (SELECT vec_id, list_reduce(list_transform(px, lambda x: CASE WHEN x >= mean THEN 1 ELSE 0 END::HUGEINT), lambda a, b: a * 2 + b) AS h0 FROM m)
SELECT vec_id, (CASE WHEN h0 >= 9223372036854775808::HUGEINT THEN h0 - 18446744073709551616::HUGEINT ELSE h0 END)::BIGINT AS ah FROM h""",
)
def f07(s, d):
    return fx.with_ahash(fx.grid(s, d)).select("vec_id", "ah")


@query("f08_degenerate_hash", f"WITH {fx.GRID_HASH_SQL} SELECT vec_id, bit_count(dh)::INT AS ones, bit_count(dh) < 22 OR bit_count(dh) > 34 AS degenerate FROM hashed")
def f08(s, d):
    return fx.hashed_grid(s, d).select("vec_id", F.bit_count("dh").alias("ones"), H.is_degenerate(F.col("dh"), 22, 34).alias("degenerate"))


@query("f09_luma", f"WITH {fx.GRID_SQL} SELECT vec_id, round(0.2989 * px[1] + 0.5870 * px[2] + 0.1140 * px[3], 4)::DOUBLE AS luma FROM grid")
def f09(s, d):
    px = lambda i: F.get("px", F.lit(i))
    return fx.grid(s, d).select("vec_id", F.round(H.luma(px(0), px(1), px(2)), 4).alias("luma"))


@query(
    "f10_image_features",
    f"WITH {fx.GRID_SQL} SELECT vec_id, round(list_avg(px), 4) AS brightness, round(list_stddev_pop(px), 4) AS contrast FROM grid",
)
def f10(s, d):
    from attesta.functions.pixels import image_features

    wide = image_features(fx.grid(s, d).select("vec_id", "px"), "vec_id", "px", 8, 8)
    return wide.where(F.col("feature").isin("brightness", "contrast")).groupBy("vec_id").pivot("feature", ["brightness", "contrast"]).agg(F.first("value"))


@query("f11_entropy", f"WITH {fx.GRID_SQL}, b AS (SELECT vec_id, unnest(px) // 16 AS bin FROM grid), c AS (SELECT vec_id, bin, count(*) AS n FROM b GROUP BY ALL) SELECT vec_id, round(sum(-(n / 64.0) * log2(n / 64.0)), 4) AS entropy FROM c GROUP BY vec_id")
def f11(s, d):
    return R.entropy(fx.grid(s, d).select("vec_id", F.explode("px").alias("p")).select("vec_id", F.floor(F.col("p") / 16).alias("bin")), "vec_id", "bin").select("vec_id", F.round("entropy", 4).alias("entropy"))


_BANDS_SQL = "w AS (SELECT l_orderkey AS patch, {} FROM lineitem GROUP BY l_orderkey)".format(", ".join(f"coalesce(avg(CASE WHEN l_linenumber = {k} THEN l_extendedprice END), 0) AS b{k}" for k in range(1, 8)))


@query("f12_spectral_indices", f"WITH {_BANDS_SQL} SELECT patch, round(CASE WHEN b4 + b3 + 1e-6 > 0 THEN (b4 - b3) / (b4 + b3 + 1e-6) ELSE 0 END, 6) AS ndvi, round(CASE WHEN b2 + b4 + 1e-6 > 0 THEN (b2 - b4) / (b2 + b4 + 1e-6) ELSE 0 END, 6) AS ndwi, round((b1 + b2 + b3) / 3, 4) AS visible FROM w")
def f12(s, d):
    bands = R.band_means(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice", list(range(1, 8)))
    return R.spectral_indices(bands.withColumnRenamed("l_orderkey", "patch"), blue="1", green="2", red="3", nir="4").select("patch", F.round("ndvi", 6).alias("ndvi"), F.round("ndwi", 6).alias("ndwi"), F.round("visible", 4).alias("visible"))


@query("f13_minmax_scale", "SELECT event_id, CASE WHEN mx > mn THEN trunc((value - mn) / (mx - mn) * 255)::INT ELSE 0 END AS scaled FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS mn, max(value) OVER (PARTITION BY user_id) AS mx FROM events)")
def f13(s, d):
    return R.minmax_255(table(s, d, "events"), ["user_id"], "value").select("event_id", "scaled")


@query("f14_primary_label", "WITH r AS (SELECT doc_id, quality, lang, source, doc_id % 6 AS k FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, CASE k WHEN 0 THEN coalesce('q' || quality, source) WHEN 1 THEN 'B0' || doc_id % 9 WHEN 2 THEN lang WHEN 3 THEN source WHEN 4 THEN CASE WHEN lang <> 'fr' THEN lang END END AS label FROM r")
def f14(s, d):
    """Labels that stand in a category, in a band, in a plain value, in the metadata, in a directory, and nowhere."""
    k, lang = F.col("doc_id") % 6, F.col("lang")
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    first = F.when(k == 0, F.create_map(F.lit("class"), F.lit(None).cast("string"), F.lit("category"), F.concat(F.lit("q"), "quality"))).when(k == 1, F.create_map(F.lit("spectral_band"), F.concat(F.lit("B0"), F.col("doc_id") % 9)))
    path = F.when(k == 4, F.concat(F.lit("set/"), F.when(lang == "fr", "images").otherwise(lang), F.lit("/x.png"))).when(k == 5, "x.png")
    return rows.select("doc_id", R.primary_label(first, F.when(k == 2, lang), F.when(k.isin(0, 3), F.col("source")), path).alias("label"))


@query(
    "f15_layer_digests",
    """WITH l AS (SELECT p_brand AS model, lpad(p_partkey::VARCHAR, 12, '0') AS name, p_size::VARCHAR AS shape, sha256(p_name || '|' || p_partkey) AS h FROM part)
SELECT model, sha256(string_agg(name || ':' || shape, '|' ORDER BY name)) AS architecture, sha256(string_agg(name || ':' || h, '|' ORDER BY name)) AS weights, count(*) AS layers FROM l GROUP BY model""",
)
def f15(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("model"), F.struct(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("name"), F.col("p_size").cast("string").alias("shape"), F.sha2(F.concat_ws("|", "p_name", "p_partkey"), 256).alias("h")).alias("layer"))
    g = p.groupBy("model").agg(F.collect_list("layer").alias("layers"))
    return g.select("model", H.layers_digest(F.col("layers"), ["name", "shape"]).alias("architecture"), H.layers_digest(F.col("layers"), ["name", "h"]).alias("weights"), F.size("layers").cast("long").alias("layers"))


_F16 = ", ".join(f"round((px[{p * 3 + c + 1}] / 255.0::DOUBLE - {m}) / {t}, 6)::DOUBLE AS z{c * 21 + p}" for p, c, m, t in ((0, 0, 0.485, 0.229), (20, 0, 0.485, 0.229), (3, 1, 0.456, 0.224), (7, 2, 0.406, 0.225), (20, 2, 0.406, 0.225)))


@query("f16_standardise", f"WITH {fx.GRID_SQL} SELECT vec_id, {_F16} FROM grid")
def f16(s, d):
    """Sixty-three values as twenty-one pixels of three channels, channel after channel."""
    z = R.standardise(F.slice("px", 1, 63), (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
    return fx.grid(s, d).select("vec_id", z.alias("z")).select("vec_id", *[F.round(F.get("z", F.lit(k)), 6).alias(f"z{k}") for k in (0, 20, 24, 49, 62)])


@query("f17_edge_id", f"WITH {fx.EDGES_SQL} SELECT 'ref_' || lower(edge_type) || '_' || substr(source_id, 1, 16) || '_' || substr(target_id, 1, 16) AS edge_id FROM edges")
def f17(s, d):
    return fx.edges(s, d).select(H.edge_id(F.col("edge_type"), F.col("source_id"), F.col("target_id")).alias("edge_id"))


# -- predicates -----------------------------------------------------------------------------------------------------------
@query("p01_finding_filter", "SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND (lower(text) LIKE '%idiot%' OR lower(source) LIKE '%idiot%')")
def p01(s, d):
    return R.filter_findings(table(s, d, "documents"), {"lang": "en", "source": "ALL"}, "IDIOT", ["text", "source"]).select("doc_id", "source", "lang")


@query("p02_active_first", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey")
def p02(s, d):
    return table(s, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate")


@query("p03_missing_label", "WITH r AS (SELECT doc_id, doc_id // 20 AS batch, quality, (doc_id // 20) % 3 = 0 OR (doc_id // 20) % 3 = 1 AND doc_id % 2 = 0 AS folder FROM (SELECT doc_id, CASE WHEN (doc_id // 20) % 2 = 0 THEN quality END AS quality FROM documents LEFT JOIN labels USING (doc_id))), b AS (SELECT batch, count(quality) = 0 AND bool_and(folder) AS bare FROM r GROUP BY batch) SELECT doc_id FROM r JOIN b USING (batch) WHERE quality IS NULL AND NOT bare")
def p03(s, d):
    """Batches of 20: every other one has no label at all; a third is of image folders throughout, a third is mixed."""
    batch = F.floor(F.col("doc_id") / 20)
    rows = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").withColumn("batch", batch)
    folder = (F.col("batch") % 3 == 0) | (F.col("batch") % 3 == 1) & (F.col("doc_id") % 2 == 0)
    missing = F.col("quality").isNull() | (F.col("batch") % 2 != 0)
    return R.missing_labels(rows, "batch", missing, folder).select("doc_id")


@query("p04_malformed_box", "SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_quantity FROM lineitem WHERE l_discount * 10 > 1 OR l_tax * 14 > 1 OR l_quantity / 50 > 1 OR l_extendedprice / 100000 > 1")
def p04(s, d):
    box = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 14, F.col("l_extendedprice") / 100000)
    return table(s, d, "lineitem").where(R.malformed_box(box)).select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")


@query("p05_aspect_ratio", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE (CASE WHEN l_quantity > 0 THEN l_extendedprice / 1000 / l_quantity ELSE 0 END) > 1.9 OR (CASE WHEN l_quantity > 0 THEN l_extendedprice / 1000 / l_quantity ELSE 0 END) < 0.95")
def p05(s, d):
    bad = R.extreme_aspect(F.col("l_extendedprice") / 1000, F.col("l_quantity"), high=1.9, low=0.95)
    return table(s, d, "lineitem").where(bad).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("p06_flat_image", f"WITH {fx.GRID_SQL} SELECT vec_id, round(list_var_pop(px), 4) AS variance FROM grid WHERE list_var_pop(px) < 900")
def p06(s, d):
    v = R.variance(F.col("px"))
    return fx.grid(s, d).withColumn("v", v).where("v < 900").select("vec_id", F.round("v", 4).alias("variance"))


@query("p07_missing_file", "SELECT doc_id, CASE WHEN doc_id % 101 = 0 THEN 'MISSING' ELSE 'EMPTY' END AS status FROM documents WHERE doc_id % 101 = 0 OR n_chars < 60")
def p07(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    return R.file_status(docs, docs.where("doc_id % 101 <> 0").select("doc_id", (F.col("n_chars") >= 60).alias("decoded")), "doc_id").select("doc_id", F.when(F.col("status") == "UNDECODABLE", "EMPTY").otherwise(F.col("status")).alias("status"))


@query("p08_ood_zscore", "WITH r AS (SELECT avg(value) AS m, greatest(stddev_pop(value), 1e-6) AS sd FROM events WHERE ts < TIMESTAMP '2024-01-16') SELECT event_id, round(abs(value - m) / sd, 4) AS z FROM events, r WHERE ts >= TIMESTAMP '2024-01-16' AND abs(value - m) / sd > 3")
def p08(s, d):
    e = table(s, d, "events")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    return R.ood(e.where(F.col("ts") >= half), e.where(F.col("ts") < half).select("value"), ["value", "user_id"], limit=3.0).select("event_id", F.round("z", 4).alias("z"))


@query("p09_hex_format", "SELECT doc_id, regexp_full_match(CASE WHEN doc_id % 10 = 0 THEN left(sha256(text), 63) WHEN doc_id % 10 = 1 THEN 'z' || substr(sha256(text), 2) ELSE upper(sha256(text)) END, '[0-9a-fA-F]{64}') AS valid FROM documents")
def p09(s, d):
    h = F.sha2("text", 256)
    given = F.when(F.col("doc_id") % 10 == 0, F.substring(h, 1, 63)).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("z"), F.substring(h, 2, 63))).otherwise(F.upper(h))
    return table(s, d, "documents").select("doc_id", given.rlike(H.HEX64).alias("valid"))


@query("p10_alias_consistency", "SELECT doc_id, CASE WHEN n_chars <> length(text) THEN 1 ELSE 0 END + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS n_discrepancies FROM documents")
def p10(s, d):
    docs = table(s, d, "documents").withColumns({"length": F.length("text").cast("long"), "alias": F.when(F.col("doc_id") % 13 == 0, F.concat("source", F.lit("x"))).otherwise(F.col("source"))})
    return docs.select("doc_id", F.size(R.alias_discrepancies([("n_chars", "length"), ("source", "alias")])).alias("n_discrepancies"))


@query("p11_tiers", "SELECT c_custkey, CASE WHEN x >= 0.85 THEN 'HEALTHY' WHEN x >= 0.6 THEN 'DEGRADED' ELSE 'CRITICAL' END AS health, CASE WHEN x >= 0.7 THEN 'CRITICAL' WHEN x >= 0.5 THEN 'HIGH' WHEN x >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS x FROM customer)")
def p11(s, d):
    x = (F.col("c_acctbal") + 1000) / 11000
    return table(s, d, "customer").select("c_custkey", T.tier(x, [(0.85, "HEALTHY"), (0.6, "DEGRADED")], "CRITICAL").alias("health"), T.tier(x, [(0.7, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM")], "LOW").alias("risk"))


@query("p12_status", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 'critical' WHEN o_orderpriority LIKE '%MEDIUM%' THEN 'warning' WHEN o_orderpriority LIKE '%LOW%' THEN 'normal' ELSE 'unknown' END AS status FROM orders")
def p12(s, d):
    return table(s, d, "orders").select("o_orderkey", T.normal_status(F.col("o_orderpriority")).alias("status"))


@query("p13_edge_category", """WITH e AS (SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN p_size > 45 THEN 'critical' WHEN p_size > 30 THEN 'warning' ELSE 'normal' END AS a, CASE WHEN s_acctbal < 0 THEN 'critical' WHEN s_acctbal < 3000 THEN 'warning' ELSE 'normal' END AS b FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_partkey, l_suppkey, CASE WHEN a = 'critical' AND b <> 'critical' THEN 'interrupted' WHEN a = 'critical' OR b = 'critical' THEN 'critical' WHEN a = 'warning' OR b = 'warning' THEN 'warning' ELSE 'normal' END AS category FROM e""")
def p13(s, d):
    li = table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    a = F.when(F.col("p_size") > 45, "critical").when(F.col("p_size") > 30, "warning").otherwise("normal")
    b = F.when(F.col("s_acctbal") < 0, "critical").when(F.col("s_acctbal") < 3000, "warning").otherwise("normal")
    j = li.join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select("l_partkey", "l_suppkey", T.edge_category(a, b).alias("category"))


@query("p14_contributor", "SELECT source, CASE WHEN source IN ('src1', 'src2') THEN 'manifest' WHEN count(DISTINCT lang) = 1 THEN 'folder' ELSE 'none' END AS origin, CASE WHEN source IN ('src1', 'src2') THEN 'owner_' || source WHEN count(DISTINCT lang) = 1 THEN min(lang) ELSE 'UNKNOWN' END AS contributor FROM documents GROUP BY source")
def p14(s, d):
    manifest = F.when(F.col("source").isin("src1", "src2"), F.concat(F.lit(" owner_"), "source")).otherwise("  ")
    return R.resolve_contributor(table(s, d, "documents").withColumn("manifest", manifest), "source", {"manifest": "manifest"}, "lang").select("source", "origin", "contributor")


@query("p15_clean_identity", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR lang = 'fr' THEN 'UNKNOWN' ELSE source END AS contributor FROM documents")
def p15(s, d):
    raw = F.when(F.col("doc_id") % 5 == 0, " None ").when(F.col("lang") == "fr", None).otherwise(F.concat(F.lit(" "), "source"))
    return table(s, d, "documents").select("doc_id", T.clean_identity(raw).alias("contributor"))


# -- top-k ----------------------------------------------------------------------------------------------------------------
_TIMELINE_SQL = """tl AS (SELECT ts AS occurred, 'SCAN' AS kind, event_id::VARCHAR AS id, 'LOW' AS severity FROM events UNION ALL
 SELECT o_orderdate, 'REPORT', o_orderkey::VARCHAR, CASE WHEN o_orderstatus = 'F' THEN 'CRITICAL' ELSE 'LOW' END FROM orders UNION ALL
 SELECT l_shipdate, 'FINDING', l_orderkey || '_' || l_partkey || '_' || l_suppkey, 'HIGH' FROM lineitem WHERE l_discount >= 0.1 UNION ALL
 SELECT TIMESTAMP '2024-01-01', 'DATASET', doc_id::VARCHAR, 'LOW' FROM documents)"""


def _timeline(s, d):
    e = table(s, d, "events").select(F.col("ts").alias("occurred"), F.lit("SCAN").alias("kind"), F.col("event_id").cast("string").alias("id"), F.lit("LOW").alias("severity"))
    o = table(s, d, "orders").select(F.col("o_orderdate").alias("occurred"), F.lit("REPORT").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "CRITICAL").otherwise("LOW").alias("severity"))
    li = table(s, d, "lineitem").where("l_discount >= 0.1").select(F.col("l_shipdate").alias("occurred"), F.lit("FINDING").alias("kind"), F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey").alias("id"), F.lit("HIGH").alias("severity"))
    dd = table(s, d, "documents").select(F.lit("2024-01-01").cast("timestamp_ntz").alias("occurred"), F.lit("DATASET").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.lit("LOW").alias("severity"))
    return e.unionByName(o).unionByName(li).unionByName(dd)


@query("u01_timeline_union", f"WITH {_TIMELINE_SQL} SELECT kind, severity, count(*) AS n, min(occurred) AS first_at, max(occurred) AS last_at FROM tl GROUP BY kind, severity")
def u01(s, d):
    return _timeline(s, d).groupBy("kind", "severity").agg(F.count("*").alias("n"), F.min("occurred").alias("first_at"), F.max("occurred").alias("last_at"))


@query("t01_timeline_top", f"WITH {_TIMELINE_SQL} SELECT * FROM tl ORDER BY occurred DESC, kind, id LIMIT 20")
def t01(s, d):
    return _timeline(s, d).orderBy(F.desc("occurred"), "kind", "id").limit(20)


@query("t03_latest_per_asset", "SELECT o_custkey, max(o_orderkey) AS latest FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, max(o_orderdate)) FROM orders GROUP BY o_custkey) GROUP BY o_custkey")
def t03(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("latest"))


@query("t04_newest", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000")
def t04(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1000).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("t05_recent_frames", "SELECT event_id, event_type, user_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts DESC, event_id DESC LIMIT 20")
def t05(s, d):
    return table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type", "user_id")


@query("t06_canonical_order", "WITH r AS (SELECT source, doc_id || ':' || lang AS entry, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents), c AS (SELECT source, pos // 4096 AS chunk, sha256(string_agg(entry, ',' ORDER BY pos)) AS h FROM r GROUP BY ALL) SELECT source, sha256(string_agg(h, '' ORDER BY chunk)) AS digest FROM c GROUP BY source")
def t06(s, d):
    rows = table(s, d, "documents").select("source", "doc_id", F.concat_ws(":", "doc_id", "lang").alias("entry"))
    return ordered_digest(rows, ["source"], ["doc_id"], "entry")


# -- sets -----------------------------------------------------------------------------------------------------------------
@query("u02_findings_union", "SELECT 'short' AS check_type, count(*) AS n FROM documents WHERE n_chars < 100 UNION ALL SELECT 'duplicate', count(*) FROM (SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u02(s, d):
    docs = table(s, d, "documents")
    short = docs.where("n_chars < 100").select(F.lit("short").alias("check_type"), "doc_id")
    digest = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    dup = digest.join(digest.groupBy("h").count().where("count > 1"), "h").select(F.lit("duplicate").alias("check_type"), "doc_id")
    none = docs.join(table(s, d, "labels"), "doc_id", "left_anti").select(F.lit("unlabelled").alias("check_type"), "doc_id")
    return R.union_findings(short, dup, none).groupBy("check_type").agg(F.count("*").alias("n"))


@query("u03_missing_elements", "SELECT user_id, list_sort(list_filter(['signup', 'error', 'click', 'view', 'purchase'], lambda x: NOT list_contains(seen, x))) AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS seen FROM events GROUP BY user_id)")
def u03(s, d):
    need = F.array(*[F.lit(x) for x in ("signup", "error", "click", "view", "purchase")])
    return table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.array_except(need, F.collect_set("event_type"))).alias("missing"))


@query("u04_common_keys", f"WITH {fx.FEATURES_SQL} SELECT DISTINCT feature FROM feats WHERE base AND value > 0.05 INTERSECT SELECT DISTINCT feature FROM feats WHERE NOT base")
def u04(s, d):
    return R.common(*[fx.features(s, d).where(c).select("feature") for c in ("base and value > 0.05", "not base")])


# -- scans with pushdown --------------------------------------------------------------------------------------------------
@query("s08_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def s08(s, d):
    return table(s, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice")


@query("s09_ledger_scan", "SELECT event_id, ts, value FROM events WHERE event_type = 'error' ORDER BY event_id")
def s09(s, d):
    return table(s, d, "events").where("event_type = 'error'").orderBy("event_id").select("event_id", "ts", "value")


@query("s11_batch_numbers", "SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY first_id) AS batch_number, row_number() OVER (ORDER BY first_id) AS block_height, sum(n) OVER (PARTITION BY source ORDER BY first_id)::BIGINT AS running FROM (SELECT source, lang, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY source, lang)")
def s11(s, d):
    batches = table(s, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return R.register_batches(batches, "source", "first_id", "n").select("source", "lang", "batch_number", "block_height", "running")


_S11 = """m AS (SELECT o_orderkey AS batch_id, 'd' || o_custkey % 50 AS dataset, 'c' || o_custkey % 50 % 7 AS contributor, 'r' || o_orderkey % 1000 AS merkle_root, o_orderkey % 5 + 3 AS sample_count, o_orderdate AS day, o_orderkey % 4 = 0 AS old FROM orders),
kd AS (SELECT dataset, contributor, sum(sample_count) AS total FROM m WHERE old GROUP BY ALL), nb AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY day, batch_id) AS k FROM m WHERE NOT old), kr AS (SELECT DISTINCT merkle_root FROM m WHERE old AND batch_id % 8 = 0),
nr AS (SELECT merkle_root, min((day, batch_id)) AS f FROM nb WHERE merkle_root NOT IN (SELECT merkle_root FROM kr) GROUP BY ALL)"""


@query("s11_registration", f"WITH {_S11} SELECT 'contributor' AS kind, contributor AS id, 0 AS n FROM nb WHERE contributor NOT IN (SELECT contributor FROM kd) GROUP BY contributor UNION ALL SELECT 'dataset', d.dataset, (coalesce(kd.total, 0) + d.t)::BIGINT FROM (SELECT dataset, contributor, sum(sample_count) AS t FROM m GROUP BY ALL) d LEFT JOIN kd ON kd.dataset = d.dataset UNION ALL SELECT 'batch', batch_id::VARCHAR, coalesce(c, 0) + k FROM nb LEFT JOIN (SELECT dataset, count(*) AS c FROM m WHERE old GROUP BY dataset) b ON b.dataset = nb.dataset UNION ALL SELECT 'root', merkle_root, (SELECT count(*) FROM kr) + row_number() OVER (ORDER BY f) FROM nr")
def s11_registration(s, d):
    """All orders as manifests, a quarter of which is registered already; some of their roots are on record."""
    o, c = table(s, d, "orders"), F.col("o_custkey") % 50
    m = o.select(F.col("o_orderkey").alias("batch_id"), F.concat(F.lit("d"), c).alias("dataset"), F.concat(F.lit("c"), c % 7).alias("contributor"), F.concat(F.lit("r"), F.col("o_orderkey") % 1000).alias("merkle_root"), (F.col("o_orderkey") % 5 + 3).alias("sample_count"), F.col("o_orderdate").alias("at"))
    old = m.where("batch_id % 4 = 0")
    known = {"contributors": old.select("contributor").distinct(), "datasets": old.groupBy("dataset", "contributor").agg(F.sum("sample_count").alias("total_samples")), "batches": old, "roots": old.where("batch_id % 8 = 0").select(F.col("merkle_root").alias("root_hash")).distinct()}
    new = R.register(m, known)
    row = lambda t, kind, i, n: new[t].select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), n.cast("long").alias("n"))
    return row("contributors", "contributor", "contributor", F.lit(0)).union(row("datasets", "dataset", "dataset", F.col("total_samples"))).union(row("batches", "batch", "batch_id", F.col("batch_number"))).union(row("roots", "root", "root_hash", F.col("block_height")))


@query("w06_batch_numbering", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS batch_number FROM orders")
def w06(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("batch_number"))
