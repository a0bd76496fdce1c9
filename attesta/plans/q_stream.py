"""Sources written to the shared folder and read back, and streams over the events, each run until it is through."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import pixels as P
from attesta.plans import fixtures as fx
from attesta.plans.lineage import cleaned, cut, folder, passing, shared_dir
from attesta.plans.registry import query, table
from attesta.sources import files as S
from attesta.streaming import frames as W


def _fresh(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# -- sources --------------------------------------------------------------------------------------------------------------
def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _supplier(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))


@query("s01_file_scan", "WITH f AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'n' || s_nationkey || '/' END || 's' || s_suppkey || CASE s_suppkey % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.JPG' ELSE '.png' END AS p, 'image ' || s_suppkey AS c, 'n' || s_nationkey AS n FROM supplier) SELECT p AS sample_id, sha256(c) AS sha256, length(c) AS size, CASE WHEN p LIKE '%/%' THEN n END AS label FROM f WHERE p NOT LIKE '%.txt'")
def s01(s, d):
    root, k = _fresh(s, "files"), F.col("k")
    name = _text(F.when(k % 10 == 0, "").otherwise(_text("n", F.col("n"), "/")), "s", k, F.when(k % 7 == 0, ".txt").when(k % 7 == 1, ".JPG").otherwise(".png"))
    S.write_files(_supplier(s, d).select(name.alias("path"), _text("image ", k).alias("content")), root)
    return S.image_folder(s, root)


@query("s03_yolo_scan", "WITH f AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) SELECT CASE k % 3 WHEN 0 THEN 'a/images/s' WHEN 1 THEN 'b/s' ELSE 'c/s' END || k || '.png' AS sample_id, CASE WHEN k % 3 = 2 THEN 0 ELSE 2 END AS n_labels, CASE WHEN k % 3 <> 2 THEN least(n, 7)::DOUBLE END AS first FROM f")
def s03(s, d):
    root, k = _fresh(s, "yolo"), F.col("k")
    f = _supplier(s, d)
    label = _text(F.col("n"), " 0.5 0.5 .25 1e-1\n7 0 0 1 1 0.9\nbroken line\n1 a b c d\n1 0.5 0.5 0.5\n")
    images = f.select(_text(F.when(k % 3 == 0, "a/images/s").when(k % 3 == 1, "b/s").otherwise("c/s"), k, ".png").alias("path"), _text("image").alias("content"))
    labels = f.where("k % 3 <> 2").select(_text(F.when(k % 3 == 0, "a/labels/s").otherwise("b/s"), k, ".txt").alias("path"), label.alias("content"))
    S.write_files(images.union(labels), root)
    return S.yolo(s, root).select("sample_id", F.size("labels").alias("n_labels"), F.get(F.get("labels", F.lit(0)), F.lit(0)).alias("first"))


_BANDS = "['" + "', '".join(S.BANDS) + "']"
_S04 = f"b AS (SELECT s_suppkey AS k, unnest({_BANDS}) AS band, generate_subscripts({_BANDS}, 1) AS i FROM supplier), f AS (SELECT k, band, (k + i) % 3 <> 0 AS there FROM b)"


def _band_files(s, d):
    at = F.posexplode(F.array(*[F.lit(b) for b in S.BANDS])).alias("i", "band")
    rows = _supplier(s, d).select("k", at).where((F.col("k") + F.col("i") + 1) % 3 != 0)
    bands = rows.select(_text("p", F.col("k"), "/p", F.col("k"), "_", F.col("band"), ".tif").alias("path"), _text(F.col("k"), ":", F.col("band")).alias("content"))
    meta = _supplier(s, d).where("k % 2 = 0").select(_text("p", F.col("k"), "/p", F.col("k"), "_labels_metadata.json").alias("path"), _text("{}").alias("content"))
    more = _supplier(s, d).where("k % 5 = 0").select(_text("q", F.col("k"), "/other.TIFF").alias("path"), _text("x").alias("content"))
    return bands.union(meta).union(more)


@query("s04_patch_scan", f"WITH {_S04}, g AS (SELECT k, count(*) FILTER (NOT there) AS missing, '{{' || string_agg('\"' || band || '\":\"' || CASE WHEN there THEN sha256(k || ':' || band) ELSE 'MISSING_BAND' END || '\"', ',' ORDER BY band = 'B8A' AND false, list_position({_BANDS}, band)) || ',\"META\":\"' || CASE WHEN k % 2 = 0 THEN sha256('{{}}') ELSE '' END || '\"}}' AS j FROM f GROUP BY k) SELECT 'p' || k AS patch, missing, sha256(j) AS compound FROM g".replace("band = 'B8A' AND false, ", ""))
def s04(s, d):
    root = _fresh(s, "patches")
    S.write_files(_band_files(s, d), root)
    missing = sum((F.col(b) == S.MISSING_BAND).cast("long") for b in S.BANDS)
    return S.patches(s, root).select("patch", missing.alias("missing"), "compound")


@query("s05_band_scan", f"WITH {_S04} SELECT 'p' || k || '/p' || k || '_' || band || '.tif' AS sample_id, sha256(k || ':' || band) AS sha256, band FROM f WHERE there UNION ALL SELECT 'q' || s_suppkey || '/other.TIFF', sha256('x'), 'UNKNOWN' FROM supplier WHERE s_suppkey % 5 = 0")
def s05(s, d):
    root = _fresh(s, "bands")
    S.write_files(_band_files(s, d), root)
    return S.single_bands(s, root)


@query("s06_format_detection", "SELECT 'd' || s_suppkey AS source, CASE s_suppkey % 4 WHEN 0 THEN 'COCO' WHEN 3 THEN 'IMAGE_FOLDER' ELSE 'YOLO' END AS format FROM supplier")
def s06(s, d):
    root, k = _fresh(s, "formats"), F.col("k")
    f = _supplier(s, d)
    file = lambda rest, name, content="x": f.where(f"k % 4 = {rest}").select(_text("d", k, "/", name).alias("path"), _text(content).alias("content"))
    parts = [file(0, "one.png"), file(0, "a.json", '{"images": [], "annotations": [], "categories": []}'), file(1, "images/one.png"), file(1, "images/two.png"), file(1, "labels/one.txt")]
    parts += [file(2, "one.png"), file(2, "two.png"), file(2, "one.txt"), file(3, "one.png"), file(3, "two.png"), file(3, "three.png"), file(3, "three.txt"), file(3, "b.json", '{"images": []}')]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    S.write_files(whole, root)
    return S.detect_format(S.listing(s, root), S.is_coco(s, root))


@query("s02_coco_scan", "SELECT o_orderkey || '.png' AS sample_id, count(*) FILTER (l_orderkey IS NOT NULL) AS n_labels FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_discount >= 0.05 WHERE o_orderstatus <> 'P' GROUP BY o_orderkey")
def s02(s, d):
    path = _fresh(s, "coco")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderkey", F.lit(".png")).alias("file_name"), F.lit(8).alias("width"), F.lit(8).alias("height"), (F.col("o_orderkey") % 64).alias("shard"))
    li = table(s, d, "lineitem").where("l_discount >= 0.05").select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") * 1).cast("long").alias("category_id"), F.array("l_tax", "l_discount").alias("bbox"), (F.col("l_orderkey") % 64).alias("shard"))
    cats = s.range(1, 8).select(F.col("id"), F.concat(F.lit("k"), "id").alias("name"), F.lit(0).cast("long").alias("shard"))
    part = lambda df, name: df.groupBy("shard").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "shard"])).alias(name))
    part(o, "images").join(part(li, "annotations"), "shard", "full").join(part(cats, "categories"), "shard", "full").drop("shard").write.json(path)
    present = table(s, d, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("x/"), "o_orderkey", F.lit(".png")).alias("path"))
    return S.coco(s, path, present, by_line=True).select("sample_id", F.size("labels").cast("long").alias("n_labels"))


@query("s02_coco_document", "SELECT o_orderkey || '.png' AS sample_id, 'w' || o_orderkey AS first, count(*) FILTER (l_orderkey IS NOT NULL) AS n_labels, coalesce(round(sum(l_tax) FILTER (l_orderkey IS NOT NULL), 4), 0)::DOUBLE AS boxes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_discount >= 0.05 WHERE o_orderstatus <> 'P' GROUP BY o_orderkey")
def s02_document(s, d):
    """JSON documents of up to half a million images, each in one file, with braces and quotes in texts, nested objects and a plain object between its arrays."""
    o, li = table(s, d, "orders"), table(s, d, "lineitem").where("l_discount >= 0.05")
    files = o.count() // 500_000 + 1
    line = lambda rows, k, doc, shown: rows.select(doc.cast("int").alias("doc"), F.lit(k).alias("k"), F.concat(F.lit(","), F.to_json(shown)).alias("value"))
    fixed = lambda k, text: s.range(files).select(F.col("id").cast("int").alias("doc"), F.lit(k).alias("k"), F.lit(text).alias("value"))
    images = line(o, 1, F.col("o_orderkey") % files, F.struct(F.col("o_orderkey").alias("id"), F.concat("o_orderkey", F.lit(".png")).alias("file_name"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit('a "}" or \\ {').alias("note")))
    boxes = line(li, 3, F.col("l_orderkey") % files, F.struct(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("category_id"), F.struct(F.array(F.lit(1), F.lit(2)).alias("counts")).alias("segmentation"), F.array("l_tax", "l_discount").alias("bbox")))
    kinds = line(s.range(1, 8).crossJoin(s.range(files).select(F.col("id").alias("doc"))), 5, F.col("doc"), F.struct("id", F.concat(F.lit("k}"), "id").alias("name")))
    parts = [fixed(0, '{"info": {"by": "x {"}, "images": [{"id": -1, "file_name": "none"}'), images, fixed(2, '], "extra": {"id": 5, "more": {}}, "annotations": [{"image_id": -1}'), boxes, fixed(4, '], "n": 3, "categories": [{"id": -1}'), kinds, fixed(6, "]}")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    present = o.where("o_orderstatus <> 'P'").select(F.concat(F.lit("x/"), "o_orderkey", F.lit(".png")).alias("path"))
    with passing(s):
        with passing(s):
            # the documents go when their objects are read
            path = f"{folder(s)}/coco"
            with cleaned(s):
                whole.repartitionById(files, "doc").sortWithinPartitions("k").select("value").write.text(path)
            found = S.coco(s, path, present, keep=1)
        total = F.aggregate("labels", F.lit(0.0), lambda a, x: a + x["bbox"][0])
        return cut(found.select("sample_id", F.concat(F.lit("w"), F.split_part("sample_id", F.lit("."), F.lit(1))).alias("first"), F.size("labels").cast("long").alias("n_labels"), F.round(total, 4).alias("boxes")), keep=1)



@query("s07_entity_store", "SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier")
def s07(s, d):
    """A document a file over several lines, and broken ones between them."""
    path = _fresh(s, "entities")
    row = table(s, d, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), {"pretty": "true"}).alias("content"), F.col("s_suppkey").alias("k"))
    broken = row.where("k % 10 = 0").select(_text(F.col("k"), "-broken.json").alias("path"), F.lit('{"id":').alias("content"))
    S.write_files(row.select(_text(F.col("k"), ".json").alias("path"), "content").union(broken), path)
    return S.entities(s, path, "id long, balance double")


@query("s10_audit_log", "SELECT event_id, event_type FROM events")
def s10(s, d):
    path = _fresh(s, "audit")
    e = table(s, d, "events").select("event_id", "event_type")
    S.append_audit(e.where("event_id % 2 = 0"), path)
    S.append_audit(e.where("event_id % 2 = 1"), path)
    return S.audit_log(s, path, "event_id long, event_type string")


@query("s12_sink", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def s12(s, d):
    path = _fresh(s, "sink")
    S.save(table(s, d, "documents").select("doc_id", "source", "lang"), path, by=["lang"])
    return s.read.parquet(path).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("s13_graph_load", f"WITH {fx.NODES_SQL}, {fx.EDGES_SQL} SELECT edge_type AS kind, count(*) AS n FROM edges GROUP BY edge_type UNION ALL SELECT node_type, count(*) FROM nodes GROUP BY node_type")
def s13(s, d):
    path = _fresh(s, "graph")
    e = fx.edges(s, d)
    S.save(fx.nodes(s, d), f"{path}/nodes")
    S.save(e.union(e.where("edge_type = 'TRAINED_ON'")), f"{path}/edges")
    nodes, edges = S.load_graph(s, path)
    return edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")).union(nodes.groupBy("node_type").agg(F.count("*")))


@query("uf01_pixel_planes", f"WITH {fx.GRID_SQL} SELECT vec_id, 8 AS width, list_sum(px)::DOUBLE AS total, 'OK' AS status FROM grid UNION ALL SELECT -1 - vec_id, NULL, NULL, 'UNDECODABLE' FROM grid")
def uf01(s, d):
    body = F.concat(F.lit("P5 8 8 255\n").cast("binary"), F.unhex(F.array_join(F.transform("px", lambda x: F.lpad(F.hex(x), 2, "0")), "")))
    g = fx.grid(s, d)
    files = g.select(F.col("vec_id").cast("string").alias("path"), body.alias("content")).union(g.select((-1 - F.col("vec_id")).cast("string"), F.lit("P5 8 8 255\nshort").cast("binary")))
    out = P.decode(files, P.pgm)
    return out.select(F.col("path").cast("long").alias("vec_id"), "width", F.aggregate("px", F.lit(0.0), lambda a, x: a + x).alias("total"), "status")


_LINES = [("TL", "px[1:8]", 0, 8), ("TR", "list_reverse(px[1:8])", 7, 8), ("BL", "px[57:64]", 56, -8), ("BR", "list_reverse(px[57:64])", 63, -8)]
_RUN = "CASE WHEN list_contains(list_transform({0}, lambda x: abs(x - {0}[1]) > 35), true) THEN list_position(list_transform({0}, lambda x: abs(x - {0}[1]) > 35), true) - 1 ELSE 8 END"
_ST02 = f"""{fx.GRID_DUP_SQL}, lines AS ({" UNION ALL ".join(f"SELECT vec_id, label, px, '{n}' AS corner, {k} AS k, {row} AS r, [{', '.join(f'px[{at + i * step + 1}]' for i in range(8))}] AS c FROM grid_dup" for k, (n, row, at, step) in enumerate(_LINES))}),
runs AS (SELECT vec_id, label, corner, k, {_RUN.format("r")} AS w, {_RUN.format("c")} AS h FROM lines WHERE r[1] > 220 OR r[1] < 35), best AS (SELECT vec_id, label, min(k) AS k FROM runs WHERE w >= 2 AND h >= 2 GROUP BY ALL)
SELECT g.vec_id, g.label, g.px, r.corner, r.w::INT AS corner_width, r.h::INT AS corner_height FROM grid_dup g LEFT JOIN best b ON b.vec_id = g.vec_id AND b.label = g.label LEFT JOIN runs r ON r.vec_id = b.vec_id AND r.label = b.label AND r.k = b.k"""


@query("st02_corner_runs", f"WITH {_ST02}")
def st02(s, d):
    return P.corner_runs(fx.grid_dup(s, d), "vec_id", "px", 8, 8, least=2)


_BOX = "list_filter(list_transform(range(0, 64), lambda i: CASE WHEN i % 8 >= x AND i % 8 < x + corner_width AND i // 8 >= y AND i // 8 < y + corner_height THEN px[i + 1] END), lambda v: v IS NOT NULL)"


@query("st02_corner_boxes", f"WITH s AS ({{runs}}), b AS (SELECT *, CASE WHEN corner LIKE '%R' THEN 8 - corner_width ELSE 0 END AS x, CASE WHEN corner LIKE 'B%' THEN 8 - corner_height ELSE 0 END AS y FROM s), v AS (SELECT *, {_BOX} AS inside FROM b) SELECT vec_id, corner, CASE WHEN corner IS NOT NULL THEN [x, y, corner_width, corner_height] END AS box, CASE WHEN corner IS NOT NULL THEN round(list_avg(inside), 2) END AS box_mean, CASE WHEN corner IS NOT NULL THEN round(list_stddev_pop(inside), 4) END AS box_std FROM v".replace("{runs}", f"WITH {_ST02}"))
def st02_boxes(s, d):
    g = fx.grid_dup(s, d)
    return P.corner_boxes(P.corner_runs(g, "vec_id", "px", 8, 8, least=2), "px", 8, 8).select("vec_id", "corner", "box", "box_mean", "box_std")


# -- streams --------------------------------------------------------------------------------------------------------------
_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: What is there now comes as one micro-batch where rows count in the order of their ids, whatever files they lie in.
_ALL = 1_000_000


def _stream(s, d, files_per_trigger=1):
    e = W.frames(s, f"{d}/events.parquet*", _SCHEMA, files_per_trigger)
    return e.withColumn("h", F.floor("value").cast("string"))


_W04 = "SELECT event_type, event_id, floor(value)::BIGINT::VARCHAR AS h, coalesce(list_contains(list(floor(value)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), floor(value)), false) AS recent FROM events"


@query("st03_rolling_buffer", _W04)
def st03(s, d):
    frames = _stream(s, d, _ALL).withColumn("kind", F.lit("frame"))
    return W.verdict_buffer(frames, "event_type", "event_id", "h", _fresh(s, "st03"))[0].select("event_type", "event_id", "h", "recent")


@query("st04_buffer_reset", "WITH r AS (SELECT event_type, event_id, floor(value) AS h, event_id % 10 = 9 AS reset, sum((event_id % 10 = 9)::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) SELECT event_type, event_id, h::BIGINT::VARCHAR AS h, coalesce(list_contains(list(h) OVER (PARTITION BY event_type, g ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), h), false) AS recent FROM r WHERE NOT reset")
def st04(s, d):
    """Every tenth event empties its type's buffer: what was seen before it counts no more."""
    kind = F.when(F.col("event_id") % 10 == 9, "reset").otherwise("frame")
    frames = _stream(s, d, _ALL).withColumn("kind", kind)
    return W.verdict_buffer(frames, "event_type", "event_id", "h", _fresh(s, "st04"))[0].select("event_type", "event_id", "h", "recent")


@query("st01_frame_verdicts", "WITH r AS (SELECT event_type, event_id, coalesce(list_contains(list(floor(value)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), floor(value)), false) AS recent, value FROM events) SELECT event_type, CASE WHEN floor(value) >= 300 THEN 'POISONED' WHEN recent THEN 'NEAR-DUPLICATE' WHEN floor(value) < 10 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict, count(*) AS n FROM r GROUP BY ALL")
def st01(s, d):
    out, _ = W.verdict_buffer(_stream(s, d, _ALL).withColumn("kind", F.lit("frame")), "event_type", "event_id", "h", _fresh(s, "st01"))
    name, _ = W.verdict(F.col("h").cast("double") >= 300, F.col("recent"), F.col("h").cast("double"))
    return out.groupBy("event_type", name.alias("verdict")).agg(F.count("*").alias("n"))


_FROZEN = _ST02.replace("FROM grid_dup g", "FROM frozen g").replace("FROM grid_dup", "FROM frozen").replace(", lines AS", ", frozen AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 3 THEN list_transform(range(0, 64), lambda i: 100) ELSE px END AS px FROM grid_dup), lines AS")


@query("st01_pixel_verdicts", f"WITH s AS (WITH {_FROZEN}), j AS (SELECT label, vec_id, corner, list_var_pop(list_transform(px, lambda x: x::DOUBLE)) AS variance, coalesce(list_contains(list(array_to_string(px, ',')) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), array_to_string(px, ',')), false) AS recent FROM s) SELECT label, vec_id, CASE WHEN corner IS NOT NULL THEN 'POISONED' WHEN recent THEN 'NEAR-DUPLICATE' WHEN variance < 10 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict FROM j")
def st01_pixels(s, d):
    """Frames as they come in, in base64: decoded once, then corner, five frames before and variance decide; some frames are frozen."""
    path = _fresh(s, "pixels")
    body = F.concat(F.lit("P5 8 8 255\n").cast("binary"), F.unhex(F.array_join(F.transform("px", lambda x: F.lpad(F.hex(x), 2, "0")), "")))
    frozen = F.when(F.col("vec_id") % 7 == 3, F.transform("px", lambda x: F.lit(100))).otherwise(F.col("px"))
    head = F.when(F.col("vec_id") % 2 == 1, "data:image/x-portable-graymap;base64,").otherwise("")
    fx.grid_dup(s, d).withColumn("px", frozen).select("vec_id", "label", F.concat(head, F.base64(body)).alias("frame_data")).write.parquet(path)
    stream = W.decoded(s.readStream.schema(s.read.parquet(path).schema).parquet(path))
    frames = P.planes(stream, P.pgm).select("vec_id", "label", F.sha2("content", 256).alias("h"), "px", F.lit("frame").alias("kind"))
    found = P.corner_runs(frames.withColumn("variance", P.variance("px")), "vec_id", "px", 8, 8, least=2).drop("px")
    rows, _ = W.verdict_buffer(found, "label", "vec_id", "h", _fresh(s, "pixels-buffer"), carry=("corner", "variance"))
    return rows.select("label", "vec_id", W.verdict(F.col("corner").isNotNull(), F.col("recent"), F.col("variance"))[0].alias("verdict"))


@query("st05_replay_guard", "SELECT count(DISTINCT (user_id, floor(value))) AS first_sights FROM events")
def st05(s, d):
    out = W.replay_guard(_stream(s, d), ["user_id", "h"], delay="60 days").select("user_id", "h")
    return W.drained(out, _fresh(s, "st05"), _fresh(s, "st05-state")).agg(F.count("*").alias("first_sights"))


@query("st05_replays_ever", """WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 49 THEN event_id // 50 ELSE event_id END AS nonce, CASE WHEN event_id % 70 = 69 THEN event_id - 69 ELSE event_id END AS record FROM events)
SELECT event_id, event_id > min(event_id) OVER (PARTITION BY nonce) OR event_id > min(event_id) OVER (PARTITION BY record) AS replayed FROM e""")
def st05_ever(s, d):
    """Some events repeat the nonce of one from long before, some the record id of one of late."""
    n = F.col("event_id")
    e = _stream(s, d, _ALL).withColumns({"nonce": F.when(n % 50 == 49, F.floor(n / 50)).otherwise(n), "record": F.when(n % 70 == 69, n - 69).otherwise(n)})
    return W.known_replays(e, "event_id", "event_id", ["nonce", "record"], _fresh(s, "ever"))


_BUFFER = "WITH r AS (SELECT event_type, event_id, floor(value)::BIGINT::VARCHAR AS h, event_id % 4000 = 3999 AS reset, sum((event_id % 4000 = 3999)::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events), j AS (SELECT *, coalesce(list_contains(list(h) OVER (PARTITION BY event_type, g ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), h), false) AS recent FROM r WHERE NOT reset)"


@query("st03_verdict_buffer", f"{_BUFFER} SELECT event_type, event_id, h, recent, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS place FROM j WHERE g = (SELECT max(g) FROM r WHERE r.event_type = j.event_type) QUALIFY place <= 50")
def st03_buffer(s, d):
    """The newest fifty verdicts of each event type since its last reset, newest first."""
    kind = F.when(F.col("event_id") % 4000 == 3999, "reset").otherwise("frame")
    _, held = W.verdict_buffer(_stream(s, d).withColumn("kind", kind), "event_type", "event_id", "h", _fresh(s, "st03-buffer"))
    return held.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id"))))


@query("st03_buffered_rows", f"{_BUFFER} SELECT event_type, event_id, h, recent FROM j")
def st03_rows(s, d):
    kind = F.when(F.col("event_id") % 4000 == 3999, "reset").otherwise("frame")
    return W.verdict_buffer(_stream(s, d).withColumn("kind", kind), "event_type", "event_id", "h", _fresh(s, "st03-rows"))[0].select("event_type", "event_id", "h", "recent")


@query("st05_rollbacks", "WITH e AS (SELECT user_id, event_id, event_id - CASE WHEN event_id % 20 = 3 THEN 2000 ELSE 0 END AS seq FROM events) SELECT user_id, event_id, seq, seq <= coalesce(max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS rollback FROM e")
def st05_rollbacks(s, d):
    e = _stream(s, d, _ALL).withColumn("seq", F.col("event_id") - F.when(F.col("event_id") % 20 == 3, 2000).otherwise(0))
    return W.rollback_rows(e, "user_id", "event_id", "seq", _fresh(s, "roll"))


@query("st06_audit_tail", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st06(s, d):
    path = _fresh(s, "tail")
    W.tail(_stream(s, d).select("event_id", "event_type"), path, _fresh(s, "tail-state")).awaitTermination()
    return S.audit_log(s, path, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


@query("st07_running_statistics", "SELECT event_type, count(*) AS frames, count(*) FILTER (value >= 40) AS clean, count(*) FILTER (value < 10) AS poisoned, round(avg(value), 6) AS latency FROM events GROUP BY event_type")
def st07(s, d):
    name = F.when(F.col("value") < 10, "POISONED").when(F.col("value") >= 40, "CLEAN").otherwise("OTHER")
    out = W.statistics(_stream(s, d).withColumn("verdict", name), "event_type", "verdict", "value")
    return W.drained(out, _fresh(s, "st07"), _fresh(s, "st07-state"), mode="complete").withColumn("latency", F.round("latency", 6))


@query("s14_frame_stream", "SELECT date_part('day', ts)::INT AS day, count(*) AS n FROM events GROUP BY 1")
def s14(s, d):
    out = _stream(s, d).select("event_id", "ts")
    return W.drained(out, _fresh(s, "s14"), _fresh(s, "s14-state")).groupBy(F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("n"))
