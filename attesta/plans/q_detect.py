"""Duplicates, conflicts, patches, label quality, health and assessments."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import tiers as T
from attesta.operators import dashboard as B
from attesta.operators import detectors as D
from attesta.operators import fusion as U
from attesta.operators import merkle as M
from attesta.operators import similarity as S
from attesta.operators.drift import quantiles, ranked
from attesta.plans import fixtures as fx
from attesta.plans.lineage import cut
from attesta.plans.registry import query, table

_G = fx.GRID_HASH_SQL


def _pairs(budget: int, by: str) -> str:
    return f'SELECT least(a.rep, b.rep) AS "left", greatest(a.rep, b.rep) AS "right", bit_count(xor(a.dh, b.dh))::INT AS distance FROM (SELECT dh, {by}, min(vec_id) AS rep FROM hashed GROUP BY ALL) a JOIN (SELECT dh, {by}, min(vec_id) AS rep FROM hashed GROUP BY ALL) b ON a.rep < b.rep AND a.{by} <> b.{by} AND bit_count(xor(a.dh, b.dh)) <= {budget}'


@query("j01_near_duplicates", f"WITH {_G} {_pairs(4, 'sha')}")
def j01(s, d):
    return S.near_duplicates(cut(fx.hashed_grid(s, d).select("vec_id", "dh", "sha")), "vec_id", "dh", "sha", budget=4, width=56)


@query("j01_membership", f"WITH {_G} SELECT vec_id, min(vec_id) OVER (PARTITION BY dh, sha) AS representative FROM hashed")
def j01_membership(s, d):
    return S.membership(fx.hashed_grid(s, d), "vec_id", "dh", "sha")


@query("j02_label_conflicts", f"WITH {_G} SELECT \"left\", \"right\", distance, round(1 - distance / 64.0, 4)::DOUBLE AS confidence FROM ({_pairs(3, 'label')})")
def j02(s, d):
    return S.label_conflicts(cut(fx.hashed_grid(s, d).select("vec_id", "dh", "label")), "vec_id", "dh", "label", budget=3, width=56)


_CL = f"""WITH RECURSIVE {_G}, pairs AS ({_pairs(4, 'sha')}), sym AS (SELECT "left" AS a, "right" AS b FROM pairs UNION SELECT "right", "left" FROM pairs),
reach(node, other) AS (SELECT a, a FROM sym UNION SELECT r.node, b.b FROM reach r JOIN sym b ON b.a = r.other), comp AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node),
mem AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY dh, sha) AS rep FROM hashed), dist AS (SELECT cluster, avg(distance) AS avg_distance, max(distance) AS max_distance FROM pairs JOIN comp ON node = "left" GROUP BY cluster)"""


def _clusters(s, d):
    return S.clusters(cut(fx.hashed_grid(s, d).select("vec_id", "dh", "sha")), "vec_id", "dh", "sha", budget=4, width=56)


@query("a02_clusters", f"{_CL} SELECT cluster, vec_id FROM mem JOIN comp ON node = rep")
def a02(s, d):
    return _clusters(s, d)[0]


@query("a03_cluster_distance", f"{_CL} SELECT cluster, round(avg_distance, 4) AS avg_distance, max_distance, round(1 - avg_distance / 64, 4) AS confidence FROM dist")
def a03(s, d):
    return _clusters(s, d)[1]


@query("a01_exact_duplicates", "SELECT sha256(text) AS digest, doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents QUALIFY n > 1")
def a01(s, d):
    return D.exact_duplicates(table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id", "digest")


_FIND = """f AS (SELECT doc_id, source, 'EXACT_DUPLICATE' AS check_type, 'MEDIUM' AS severity, 0.5 AS metric FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
 UNION ALL SELECT doc_id, source, 'MISSING_LABEL', 'LOW', 0.2 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
 UNION ALL SELECT doc_id, source, 'TOXIC', CASE WHEN quality = 0 THEN 'CRITICAL' ELSE 'HIGH' END, 0.9 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""


def _findings(s, d):
    """Findings about documents: copies, missing labels and toxic texts."""
    docs, labels = table(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h")), table(s, d, "labels")
    row = lambda df, kind, severity, metric: df.select("doc_id", "source", F.lit(kind).alias("check_type"), severity.alias("severity"), F.lit(metric).alias("metric"))
    copies = docs.join(docs.groupBy("h").count().where("count > 1"), "h")
    none = docs.join(labels, "doc_id", "left_anti")
    toxic = docs.join(labels.where("toxic = 1"), "doc_id")
    return row(copies, "EXACT_DUPLICATE", F.lit("MEDIUM"), 0.5).union(row(none, "MISSING_LABEL", F.lit("LOW"), 0.2)).union(row(toxic, "TOXIC", F.when(F.col("quality") == 0, "CRITICAL").otherwise("HIGH"), 0.9))


@query("a04_severity_tally", f'WITH {_FIND} SELECT source, count(*) FILTER (severity = \'CRITICAL\') AS "CRITICAL", count(*) FILTER (severity = \'HIGH\') AS "HIGH", count(*) FILTER (severity = \'MEDIUM\') AS "MEDIUM", count(*) FILTER (severity = \'LOW\') AS "LOW" FROM f GROUP BY source')
def a04(s, d):
    return D.severity_tally(_findings(s, d), "source", "severity")


@query("a05_health_score", f"WITH {_FIND}, g AS (SELECT doc_id, round(greatest(0, least(1, 1 - sum(CASE severity WHEN 'CRITICAL' THEN 0.30 WHEN 'HIGH' THEN 0.15 WHEN 'MEDIUM' THEN 0.05 ELSE 0.02 END))), 4)::DOUBLE AS score FROM f GROUP BY doc_id) SELECT doc_id, score, CASE WHEN score >= 0.85 THEN 'HEALTHY' WHEN score >= 0.6 THEN 'DEGRADED' ELSE 'CRITICAL' END AS status FROM g")
def a05(s, d):
    return D.health(_findings(s, d), "doc_id", "severity")


@query("a06_contributor_rollup", f"""WITH {_FIND}, c AS (SELECT source, count(*) AS samples FROM documents GROUP BY source), g AS (SELECT source, count(*) AS findings, list_sort(list(DISTINCT check_type)) AS kinds, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM f GROUP BY source)
SELECT source, samples, coalesce(findings, 0) AS findings, coalesce(kinds, []) AS kinds, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, list_concat(CASE WHEN critical > 0 THEN ['CRITICAL_FINDINGS'] ELSE [] END, CASE WHEN high > 3 THEN ['MANY_HIGH_FINDINGS'] ELSE [] END) AS indicators FROM c LEFT JOIN g USING (source)""")
def a06(s, d):
    return D.contributor_rollup(table(s, d, "documents"), _findings(s, d), "source", "check_type", "severity")


_R08 = f"{_FIND}, g AS (SELECT doc_id, bool_or(severity IN ('CRITICAL', 'HIGH')) AS bad, bool_or(check_type <> 'EXACT_DUPLICATE' OR severity = 'MEDIUM') AS odd, max(metric)::DOUBLE AS score FROM f GROUP BY doc_id)"


@query("r08_sample_assessment", f"WITH {_R08} SELECT doc_id, CASE WHEN bad THEN 'POISONED' WHEN odd OR (doc_id % 2 = 0 AND doc_id % 23 = 0) THEN 'SUSPICIOUS' WHEN score IS NOT NULL THEN 'NEAR-DUPLICATE' ELSE 'CLEAN' END AS result, coalesce(score, 0) AS score FROM documents LEFT JOIN g USING (doc_id)")
def r08(s, d):
    """Every second document is on record, some with another text."""
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    history = docs.where("doc_id % 2 = 0").withColumn("digest", F.when(F.col("doc_id") % 23 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")))
    return D.assess(docs, _findings(s, d).withColumn("counts", F.lit(True)), "doc_id", D.changed_fingerprints(docs, history, "doc_id", "digest"))


@query("r08_mild_duplicates", f"WITH {_R08.replace("'MEDIUM' AS severity", "CASE WHEN doc_id % 2 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity")} SELECT doc_id, CASE WHEN bad THEN 'POISONED' WHEN odd THEN 'SUSPICIOUS' WHEN score IS NOT NULL THEN 'NEAR-DUPLICATE' ELSE 'CLEAN' END AS result, coalesce(score, 0) AS score FROM documents LEFT JOIN g USING (doc_id)")
def r08_mild(s, d):
    """Copies count as mild for odd documents."""
    f = _findings(s, d).withColumn("counts", F.lit(True))
    mild = F.when((F.col("check_type") == "EXACT_DUPLICATE") & (F.col("doc_id") % 2 == 1), "LOW").otherwise(F.col("severity"))
    return D.assess(table(s, d, "documents"), f.withColumn("severity", mild), "doc_id")


_R07 = f"""{_FIND}, g AS (SELECT doc_id, bool_or(severity IN ('CRITICAL', 'HIGH')) AS bad, bool_or(check_type <> 'EXACT_DUPLICATE' OR severity = 'MEDIUM') AS odd, list_sort(list(check_type)) AS findings FROM f GROUP BY doc_id),
q AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT -1 - doc_id FROM documents WHERE doc_id % 100 = 0), x AS (SELECT q.doc_id, d.doc_id IS NOT NULL AS known, bad, odd, findings FROM q LEFT JOIN documents d ON d.doc_id = q.doc_id LEFT JOIN g ON g.doc_id = q.doc_id)"""


@query("r07_sample_quarantine", f"WITH {_R07} SELECT doc_id, CASE WHEN NOT known THEN 'UNKNOWN' WHEN findings IS NULL THEN 'CLEAN' ELSE 'QUARANTINED' END AS outcome, CASE WHEN findings IS NULL THEN NULL WHEN bad THEN 'POISONED' WHEN odd THEN 'SUSPICIOUS' ELSE 'NEAR-DUPLICATE' END AS result, coalesce(findings, []) AS findings, CASE WHEN findings IS NOT NULL THEN 'REVOKED' END AS trust FROM x")
def r07(s, d):
    """Every third document is asked for, and some that are not there."""
    docs, f = table(s, d, "documents").select("doc_id"), _findings(s, d)
    asked = docs.where("doc_id % 3 = 0").union(docs.where("doc_id % 100 = 0").select(-1 - F.col("doc_id")))
    judged = D.assess(docs, f.withColumn("counts", F.lit(True)), "doc_id")
    done, refused = D.quarantine(asked, judged, f, "doc_id", "check_type")
    return done.select("doc_id", F.lit("QUARANTINED").alias("outcome"), "result", "findings", "trust").union(refused.select("doc_id", "outcome", F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(None).cast("string")))


@query("j10_findings_of_samples", f"WITH {_FIND} SELECT doc_id, coalesce(list_sort(list(check_type) FILTER (check_type IS NOT NULL)), []) AS findings FROM documents LEFT JOIN (SELECT doc_id, check_type FROM f) USING (doc_id) GROUP BY doc_id")
def j10(s, d):
    back = _findings(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list("check_type")).alias("findings"))
    return table(s, d, "documents").select("doc_id").join(back, "doc_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))


_J03 = """m AS (SELECT doc_id, sha256(text) AS was, CASE WHEN doc_id % 101 = 0 AND doc_id % 2 = 0 THEN 'FILE_NOT_FOUND' WHEN doc_id % 97 = 0 AND doc_id % 2 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS now, doc_id % 2 AS batch FROM documents)"""


def _manifest(s, d):
    """Two batches: of the even one some files are gone or changed, the odd one is whole."""
    docs = table(s, d, "documents").select("doc_id", "text", (F.col("doc_id") % 2).alias("batch"))
    even = F.col("doc_id") % 2 == 0
    files = docs.where(~((F.col("doc_id") % 101 == 0) & even)).select("doc_id", F.sha2(F.when((F.col("doc_id") % 97 == 0) & even, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("now"))
    return D.current_digests(docs.select("batch", "doc_id", F.sha2("text", 256).alias("sha256")), files, "doc_id", "sha256", "now")


@query("j03_manifest_check", f"WITH {_J03} SELECT doc_id, now AS current, now <> was AS tampered FROM m")
def j03(s, d):
    return _manifest(s, d).select("doc_id", "current", "tampered")


_J03_TREE = f"""RECURSIVE {_J03}, leaf AS (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY doc_id) - 1 AS idx, sha256(doc_id || ':' || now) AS hash, sha256(doc_id || ':' || was) AS hash0, count(*) OVER (PARTITION BY batch) AS n FROM m),
tree(batch, idx, hash, hash0, n) AS (SELECT batch, idx, hash, hash0, n FROM leaf UNION ALL SELECT * FROM (SELECT batch, idx // 2 AS idx, sha256(min_by(hash, idx) || max_by(hash, idx)) AS hash, sha256(min_by(hash0, idx) || max_by(hash0, idx)) AS hash0, (max(n) + 1) // 2 AS n FROM tree WHERE n > 1 GROUP BY batch, idx // 2))"""


@query("j03_manifest_result", f"WITH {_J03_TREE}, t AS (SELECT batch, count(*) FILTER (now <> was) AS tampered FROM m GROUP BY batch) SELECT batch, tampered, hash AS calculated_root, hash0 AS manifest_root, tampered = 0 AND hash = hash0 AS valid FROM tree JOIN t USING (batch) WHERE n = 1")
def j03_result(s, d):
    leaf = lambda c: F.sha2(F.concat_ws(":", "doc_id", c), 256).alias("hash")
    rows = M.numbered(_manifest(s, d), "doc_id", ["batch"])
    known = M.grouped_roots(rows.select("batch", "idx", leaf("sha256")), ["batch"]).withColumnRenamed("root", "manifest_root")
    return D.manifest_result(rows.select("batch", "idx", "tampered", leaf("current")), known, "batch")


@query("j11_changed_fingerprint", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 97 = 0")
def j11(s, d):
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    history = docs.where("doc_id % 3 = 0")
    now = docs.withColumn("digest", F.when(F.col("doc_id") % 97 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")))
    return D.changed_fingerprints(now, history, "doc_id", "digest").select("doc_id")


_PATCH = {n: "list_concat(" + ", ".join(f"px[{((0 if n[0] == 'T' else 4) + r) * 8 + (0 if n[1] == 'L' else 4) + 1}:{((0 if n[0] == 'T' else 4) + r) * 8 + (0 if n[1] == 'L' else 4) + 4}]" for r in range(4)) + ")" for n in D.CORNERS}
_CORN = f"{_G}, corn AS (" + " UNION ALL ".join(f"SELECT vec_id, label, sha, px, '{n}' AS corner, {k} AS place, {_PATCH[n]} AS v FROM hashed" for k, n in enumerate(D.CORNERS)) + ")"
_REP = f"""{_CORN}, rep AS (SELECT label, corner, sha256(array_to_string(v, ',')) AS signature, list_sort(list(DISTINCT vec_id)) AS members, count(DISTINCT sha) AS files FROM corn WHERE list_sum(v) > 0 OR list_avg(px) > 20 GROUP BY ALL HAVING count(DISTINCT vec_id) >= 2 AND count(DISTINCT sha) >= 2)"""


@query("a07_repeated_patches", f"WITH {_REP} SELECT r.label, corner, signature, unnest(members) AS vec_id, round(len(members) / n::DOUBLE, 4) AS confidence FROM rep r JOIN (SELECT label, count(*) AS n FROM hashed GROUP BY label HAVING count(*) > 1) c ON c.label = r.label")
def a07(s, d):
    return D.repeated_patches(fx.hashed_grid(s, d), "vec_id", "label", "sha", "px")


@query("a09_isolated_triggers", f"WITH {_CORN}, m AS (SELECT vec_id, corner, place, list_var_pop(v) AS variance, len(list_filter(v, lambda x: x < 32)) / 16.0 AS dark, len(list_filter(v, lambda x: x > 224)) / 16.0 AS light FROM corn), h AS (SELECT * FROM m WHERE variance >= 6000 AND dark >= 0.25 AND light >= 0.25 AND dark + light >= 0.7) SELECT vec_id, arg_min(corner, place) AS corner, round(least(1, arg_min(variance, place) / 16384), 4)::DOUBLE AS metric FROM h GROUP BY vec_id")
def a09(s, d):
    return D.isolated_triggers(fx.hashed_grid(s, d), "vec_id", "px")


@query("a08_sliding_patches")
def a08(s, d):
    from attesta.functions.pixels import window_signatures

    images = fx.hashed_grid(s, d)
    corner_hits = D.repeated_patches(images, "vec_id", "label", "sha", "px")
    return D.sliding_patches(window_signatures(images, "vec_id", "px", 8, 8), images, "vec_id", "label", "sha", corner_hits)


@query("j12_near_duplicate_exemption", f"""WITH {_REP}, mem AS (SELECT signature || corner || label AS finding, unnest(members) AS vec_id FROM rep), mir AS (SELECT vec_id, dh, list_reduce(list_transform(range(0, 56), lambda i: CASE WHEN px[(i // 7) * 8 + 8 - i % 7] > px[(i // 7) * 8 + 7 - i % 7] THEN 1 ELSE 0 END::BIGINT), lambda a, b: a * 2 + b) AS mh FROM hashed),
p AS (SELECT a.finding, a.vec_id, bool_and(bit_count(xor(x.dh, y.dh)) <= 10 OR bit_count(xor(x.dh, y.mh)) <= 10) AS exempt FROM mem a JOIN mem b ON a.finding = b.finding AND a.vec_id <> b.vec_id JOIN mir x ON x.vec_id = a.vec_id JOIN mir y ON y.vec_id = b.vec_id GROUP BY ALL) SELECT finding, vec_id, NOT exempt AS counts FROM p""")
def j12(s, d):
    images = fx.hashed_grid(s, d)
    turned = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.reverse(F.slice("px", r * 8 + 1, 8))))
    hashes = images.select("vec_id", "dh", fx.dhash(turned).alias("mh"))
    found = D.repeated_patches(images, "vec_id", "label", "sha", "px").select(F.concat("signature", "corner", "label").alias("finding"), "vec_id")
    return S.exempt_triggers(found.join(hashes, "vec_id"), "finding", "vec_id", "dh", "mh")


_KNN = """kc AS (SELECT greatest(1, least(3, min(n))) AS k, count(*) AS classes FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)),
nn AS (SELECT x.vec_id, x.label, y.label AS ly, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_sum(list_transform(range(1, 65), lambda i: (x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE) * (x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE))), y.vec_id) AS r FROM embeddings x, embeddings y WHERE x.vec_id % 100 = 0),
v AS (SELECT vec_id, label, ly, count(*) / (any_value(k)::DOUBLE) AS p0 FROM nn, kc WHERE r <= k GROUP BY ALL), p AS (SELECT vec_id, label, ly, greatest(1e-4, least(1 - 1e-4, p0)) AS p FROM v),
q0 AS (SELECT vec_id, label, max(p) AS top, arg_max(ly, (p, -ly)) AS suggested, coalesce(max(p) FILTER (ly = label), 1e-4) AS own, sum(p) + 1e-4 * (any_value(classes) - count(*)) AS total FROM p, kc GROUP BY ALL), q AS (SELECT vec_id, label, suggested, top / total AS likely, own / total AS quality FROM q0), sc AS (SELECT label AS cls, avg(quality) AS self FROM q GROUP BY label)"""


def _quality(s, d):
    """Every hundredth vector is a query, against all vectors."""
    e = table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return D.label_quality(e, "vec_id", "label", "v", e.where("vec_id % 100 = 0"))


@query("a10_label_quality", f"WITH {_KNN} SELECT vec_id, label, round(quality, 4)::DOUBLE AS quality, suggested, suggested <> label AND likely >= coalesce(self, 0) AS issue, suggested <> label AND likely >= coalesce(self, 0) OR quality < 0.4 AS flagged FROM q LEFT JOIN sc ON cls = suggested")
def a10(s, d):
    return _quality(s, d)


@query("a11_label_summary", f"WITH {_KNN} SELECT count(*) AS samples, round(avg(round(quality, 4)), 4)::DOUBLE AS overall, count(*) FILTER (quality < 0.5) AS low FROM q")
def a11(s, d):
    return _quality(s, d).agg(F.count("*").alias("samples"), F.round(F.avg("quality"), 4).alias("overall"), F.count_if(F.col("quality") < 0.5).alias("low"))


@query("a13_collection_summary", """WITH g AS (SELECT o_orderkey, o_orderstatus <> 'P' AS ok, o_orderdate AS at, 7 - count(DISTINCT l_linenumber) AS missing, sum(l_quantity) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), x AS (SELECT count(*) AS patches, count(*) FILTER (missing = 0) AS complete, count(*) FILTER (missing > 0) AS incomplete, count(*) FILTER (NOT ok) AS corrupt, sum(missing)::BIGINT AS missing_bands, sum(b)::BIGINT AS total_bytes, min(at) FILTER (ok) AS earliest, max(at) FILTER (ok) AS latest FROM g)
SELECT *, (SELECT list_sort(list(DISTINCT l_linenumber)) FROM lineitem) AS bands_present, round(total_bytes / 1048576.0::DOUBLE, 2) AS total_mb, incomplete + corrupt AS anomalies, complete > 0 AS valid, corrupt = 0 AND incomplete = 0 AS clean FROM x""".replace(" AS at,", " AS day,").replace("min(at)", "min(day)").replace("max(at)", "max(day)"))
def a13(s, d):
    """Orders as patches, their lines as bands; orders in progress have metadata that does not read."""
    meta = table(s, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("readable"), F.col("o_orderdate").alias("acquired"))
    bands = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return D.collection_summary(bands, meta, "o_orderkey", "l_linenumber", "l_quantity", list(range(1, 8)))


@query("a13_label_distribution", "SELECT unnest([o_orderpriority, o_orderstatus]) AS label, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def a13_labels(s, d):
    meta = table(s, d, "orders").select((F.col("o_orderstatus") != "P").alias("readable"), F.array("o_orderpriority", "o_orderstatus").alias("labels"))
    return D.label_distribution(meta, "labels")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'QUARANTINED' WHEN 'P' THEN 'UNDER_REVIEW' ELSE 'ACCEPTED' END"
_OVER = f"""WITH {_FIND}, o AS (SELECT *, {_STATUS} AS verdict FROM orders {{where}}), r AS (SELECT (SELECT count(*) FROM documents) AS datasets, (SELECT count(*) FROM part) AS models, (SELECT count(*) FROM events) AS inferences, count(*) AS reports, count(*) FILTER (verdict = 'QUARANTINED') AS q, count(*) FILTER (verdict = 'UNDER_REVIEW') AS under_review, count(*) FILTER (verdict = 'ACCEPTED') AS accepted, (SELECT count(*) FROM f WHERE severity IN ('CRITICAL', 'HIGH')) AS active_threats, (SELECT count(*) FROM f WHERE severity = 'CRITICAL') AS c, (SELECT max_by(sha256(event_id::VARCHAR), event_id) FROM events) AS chain_head FROM o)
SELECT datasets, models, inferences, reports, CASE WHEN q = 0 THEN c ELSE q END AS quarantined, under_review, accepted, active_threats, chain_head, CASE WHEN q > 0 OR c > 0 THEN 'CRITICAL_ALERT' WHEN under_review > 0 OR active_threats > 0 THEN 'ELEVATED_RISK' ELSE 'OPERATIONAL' END AS status FROM r"""


def _overview(s, d, reports):
    inventory = {"datasets": table(s, d, "documents"), "models": table(s, d, "part"), "inferences": table(s, d, "events")}
    verdict = T.lookup(F.col("o_orderstatus"), {"F": "QUARANTINED", "P": "UNDER_REVIEW"}, "ACCEPTED")
    chain = table(s, d, "events").select(F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("current_hash"))
    return B.system_overview(inventory, reports.withColumn("overall_verdict", verdict), _findings(s, d), chain)


@query("a14_system_overview", _OVER.format(where=""))
def a14(s, d):
    return _overview(s, d, table(s, d, "orders"))


@query("a14_without_reports", _OVER.format(where="WHERE o_orderstatus = 'O'"))
def a14_open(s, d):
    """Where no report puts anything in quarantine, critical findings count."""
    return _overview(s, d, table(s, d, "orders").where("o_orderstatus = 'O'"))


@query("a17_coverage_matrix", "SELECT event_type AS scenario, string_agg(DISTINCT 'u' || user_id % 5, ', ' ORDER BY 'u' || user_id % 5) AS evidence, CASE WHEN count(*) > 100 THEN 'COVERED' ELSE 'PARTIAL' END AS status FROM events GROUP BY event_type")
def a17(s, d):
    kinds = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("u"), F.col("user_id") % 5))), ", ")
    return table(s, d, "events").groupBy(F.col("event_type").alias("scenario")).agg(kinds.alias("evidence"), F.when(F.count("*") > 100, "COVERED").otherwise("PARTIAL").alias("status"))


@query("a18_latency_percentiles", "SELECT event_type AS stage, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def a18(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("feature"), "value", F.lit(True).alias("base"))
    g = e.groupBy("feature").agg(F.avg("value").alias("m"), F.min("value").alias("min"), F.max("value").alias("max")).join(quantiles(ranked(e), [0.5, 0.95, 0.99], "p", ("b",)), "feature")
    return g.select(F.col("feature").alias("stage"), F.round("m", 4).alias("mean"), *[F.round(F.get("p_b", F.lit(k)), 4).alias(n) for k, n in enumerate(("median", "p95", "p99"))], "min", "max")


@query("a26_category_counts", "WITH c AS (SELECT CASE WHEN event_type = 'view' THEN 'OOD' WHEN event_type = 'error' THEN 'MODEL' WHEN event_type = 'click' THEN 'BACKDOOR' WHEN event_type = 'signup' THEN 'DUPLICATE' ELSE 'DATA POISONING' END AS category FROM events) SELECT category, count(*) AS n FROM c GROUP BY category")
def a26(s, d):
    t = F.col("event_type")
    check = F.when(t == "view", "distribution_check").when(t == "error", "weight_check").when(t == "click", "trigger_check").when(t == "signup", "duplicate_check").otherwise("other")
    category = F.when(check.rlike("drift|distribution|shift"), "OOD").when(check.rlike("model|weight"), "MODEL").when(check.rlike("backdoor|trigger"), "BACKDOOR").when(check.rlike("inference|output"), "INFERENCE").when(check.contains("duplicate"), "DUPLICATE").when(check.contains("label"), "LABEL").otherwise("DATA POISONING")
    return table(s, d, "events").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


# -- fusion ---------------------------------------------------------------------------------------------------------------
_E = fx.EVIDENCE_SQL


def _contains(stems) -> str:
    return "(" + " OR ".join(f"description LIKE '%{x}%'" for x in stems) + ")"


_VETO = "coalesce(hard_veto OR severity = 'CRITICAL' AND (" + " OR ".join([_contains(("signature", "forger")), *[f"source = '{s}' AND {_contains(st)}" for s, (st, _) in U.VETO_STEMS.items()]]) + "), false)"
_FUSE = f"""{_E}, w(wsource, weight) AS (VALUES {', '.join(f"('{s}', {v})" for s, v in U.WEIGHT.items())}),
x AS (SELECT target, day, e.source, severity, metric, description, {_VETO} AS veto, CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.75 WHEN 'MEDIUM' THEN 0.4 ELSE 0.15 END::DOUBLE AS mult, severity IN ('HIGH', 'CRITICAL') AS high, weight::DOUBLE AS weight FROM ev e LEFT JOIN w ON w.wsource = e.source),
per AS (SELECT {{k}}, source, any_value(weight) AS weight, count(*) AS n, max(mult) AS mult, count(*) FILTER (high) AS n_high, max(mult) FILTER (high) AS high_mult, max(CASE WHEN metric = 0 THEN 0.5 ELSE metric END) FILTER (high) AS mh, max(metric) FILTER (high) AS mz, bool_or(severity = 'CRITICAL') AS critical, bool_or(severity = 'MEDIUM') AS medium, bool_or(severity <> 'LOW') AS not_low, bool_or(veto) AS veto,
 {', '.join(f"bool_or(source = '{s}' AND high AND {_contains(st)}) AS f_{n}" for n, (s, st) in U.STEMS.items())}, bool_or(source = 'MODEL_IDENTITY' AND high) AS f_weights, bool_or(source = 'DISTRIBUTION_SHIFT' AND {_contains(U.OPERATIONAL)}) AS f_operational FROM x GROUP BY {{k}}, source),
g AS (SELECT {{k}}, sum(n) AS n, count(*) AS sources, sum(coalesce(weight, 0) * mult) AS raw, sum(coalesce(weight, 0.1) * high_mult * (1 + 0.1 * least(n_high - 1, 3)) * (1 + greatest(0, mh - 0.5) * 1.5)) FILTER (n_high > 0) AS impact, count(*) FILTER (n_high > 0) AS hs, count(*) FILTER (n_high > 0 OR medium) AS os, bool_or(medium) AS medium, max(mz) AS top,
 bool_or(n_high > 0 AND source = 'DISTRIBUTION_SHIFT') AS hd, bool_or(critical AND source <> 'DISTRIBUTION_SHIFT') AS critical, bool_or(veto) AS veto, bool_and(source = 'DISTRIBUTION_SHIFT') AS od, bool_or(source = 'DISTRIBUTION_SHIFT') AS hasd, bool_or(source = 'DISTRIBUTION_SHIFT' AND not_low) AS oddd, bool_or(source IN ('BEHAVIOURAL_FINGERPRINT', 'MODEL_IDENTITY') AND n_high > 0) AS beh,
 bool_or(f_backdoor) AS b, bool_or(f_divergence) AS v, bool_or(f_dna) AS dn, bool_or(f_identity) AS i, bool_or(f_adversarial) AS ad, bool_or(f_weights) AS wt, bool_or(f_operational) AS op FROM per GROUP BY {{k}}),
h AS (SELECT *, list_filter([CASE WHEN b AND v THEN 'BACKDOOR_CAMPAIGN' END, CASE WHEN dn AND i THEN 'MODEL_SUBSTITUTION' END, CASE WHEN ad AND v THEN 'COORDINATED_EVASION' END, CASE WHEN ad AND wt THEN 'SHIFT_WITH_WEIGHT_DISCREPANCY' END, CASE WHEN op AND NOT dn AND NOT i AND NOT b THEN 'BENIGN_DRIFT' END, CASE WHEN dn AND NOT i THEN 'PROVENANCE_FAILURE' END, CASE WHEN i AND NOT dn THEN 'MODEL_COMPROMISE' END, CASE WHEN b AND NOT v THEN 'DATA_POISONING' END], lambda t: t IS NOT NULL) AS threats,
 CASE WHEN veto OR critical THEN greatest(raw, 0.9) WHEN hs > 0 THEN CASE WHEN hs >= 2 OR os >= 2 THEN greatest(raw, 0.5, least(0.85, 0.35 + impact)) WHEN hd THEN CASE WHEN top >= 0.7 THEN greatest(raw, 0.35) ELSE greatest(raw, least(0.25, impact)) END ELSE greatest(raw, 0.5) END WHEN medium THEN greatest(raw, 0.35) ELSE raw END AS r0 FROM g),
h1 AS (SELECT *, CASE WHEN list_contains(threats, 'BENIGN_DRIFT') AND oddd THEN greatest(r0, 0.3) ELSE r0 END AS r1 FROM h), h2 AS (SELECT *, CASE WHEN od AND NOT veto THEN least(r1, 0.65) ELSE r1 END AS r2 FROM h1),
h3 AS (SELECT *, round(greatest(0, least(1, CASE WHEN hasd AND beh THEN greatest(r2, 0.85) ELSE r2 END)), 4)::DOUBLE AS risk, least(1, sources / 5.0)::DOUBLE AS cover FROM h2)
SELECT {{k}}, risk, CASE WHEN veto OR risk >= 0.7 THEN 'CRITICAL' WHEN risk >= 0.5 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN veto OR risk >= 0.7 THEN 'QUARANTINED' WHEN risk >= 0.3 THEN 'UNDER_REVIEW' ELSE 'ACCEPTED' END AS status, CASE WHEN veto OR risk >= 0.7 THEN 'BLOCK' WHEN risk >= 0.3 THEN 'REVIEW' ELSE 'ALLOW' END AS action,
 round(cover, 2) AS coverage, CASE WHEN cover >= 0.75 THEN 'FULL' WHEN cover > 0.2 THEN 'PARTIAL' WHEN cover > 0 THEN 'MINIMAL' ELSE 'INSUFFICIENT' END AS scope, round(cover * (0.5 + 0.5 * least(n / 5.0, 1)), 4)::DOUBLE AS confidence, veto, threats FROM h3"""


@query("r01_fusion", "WITH " + _FUSE.format(k="target, day"))
def r01(s, d):
    return U.fuse(fx.evidence(s, d), ["target", "day"])


_WHY = {src: (stems, U.SAID[reason]) for src, (stems, reason) in U.VETO_STEMS.items()}
_TOLD = " UNION ALL ".join([f"SELECT evidence_id, target, '{U.SAID['SIGNATURE_INVALID']}' AS reason FROM ev WHERE NOT hard_veto AND severity = 'CRITICAL' AND {_contains(('signature', 'forger'))}", *[f"SELECT evidence_id, target, '{said}' FROM ev WHERE NOT hard_veto AND severity = 'CRITICAL' AND source = '{src}' AND {_contains(stems)}" for src, (stems, said) in _WHY.items()]])


@query("r02_hard_vetoes", f"WITH {_E} SELECT evidence_id, target, description AS reason FROM ev WHERE hard_veto UNION ALL {_TOLD}")
def r02(s, d):
    return U.explain(fx.evidence(s, d)).select("evidence_id", "target", "reason")


@query("r03_threats", "SELECT target, threats FROM (" + "WITH " + _FUSE.format(k="target") + ") WHERE len(threats) > 0")
def r03(s, d):
    return U.fuse(fx.evidence(s, d)).where(F.size("threats") > 0).select("target", "threats")


@query("r04_register", f"WITH {_E} SELECT evidence_id, sha256(evidence_id || '|' || source || '|' || severity) AS evidence_digest FROM ev")
def r04(s, d):
    return U.register(fx.evidence(s, d), F.sha2(F.concat_ws("|", "evidence_id", "source", "severity"), 256)).select("evidence_id", "evidence_digest")


@query("r06_quarantine_state", "SELECT o_custkey, arg_max(o_orderstatus = 'F', (o_orderdate, o_orderkey)) AS is_active FROM orders GROUP BY o_custkey")
def r06(s, d):
    ev = table(s, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_orderstatus") == "F").alias("is_active"))
    return U.quarantine_state(ev, "o_custkey", "at")


_R09 = f"""{_FIND}, src AS (SELECT source, count(*) AS n, length(source) + ascii(right(source, 1)) AS k FROM documents GROUP BY source), kept AS (SELECT * FROM f WHERE (length(source) + ascii(right(source, 1))) % 4 <> 0),
e AS (SELECT source AS target, 'DATA_INTEGRITY' AS src, severity, metric FROM kept UNION ALL SELECT source, 'DATA_INTEGRITY', 'LOW', 0.0 FROM src WHERE source NOT IN (SELECT source FROM kept)
 UNION ALL SELECT source, 'MODEL_IDENTITY', CASE WHEN k % 3 = 0 THEN 'CRITICAL' ELSE 'LOW' END, CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.95 END FROM src UNION ALL SELECT source, 'DISTRIBUTION_SHIFT', CASE WHEN k % 5 = 0 THEN 'CRITICAL' ELSE 'MEDIUM' END, k / 200.0::DOUBLE FROM src WHERE k % 2 = 1)"""


def _scan(s, d):
    """Each source as a scan: findings for three in four, a model and, for every other one, a drift report."""
    of = F.length("source") + F.ascii(F.right(F.col("source"), F.lit(1)))
    src = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("k", of)
    f = _findings(s, d).where(of % 4 != 0).select(F.col("source").alias("target"), F.col("doc_id").alias("finding_id"), "severity", "metric", F.col("check_type").alias("description"))
    t = F.col("source").alias("target")
    models = src.select(t, F.when(F.col("k") % 3 == 0, "MISMATCH").otherwise("MATCH").alias("status"), F.when(F.col("k") % 2 == 0, 0.0).otherwise(0.95).alias("confidence"))
    drift = src.where("k % 2 = 1").select(t, F.when(F.col("k") % 5 == 0, "CRITICAL_SHIFT").otherwise("MILD_DRIFT").alias("severity"), (F.col("k") / 200.0).alias("score"), F.lit("DATASET_DRIFT").alias("shift"))
    return U.rollup(f, src.select(t, "n"), models, drift)


@query("r09_scan_rollup", f"WITH {_R09} SELECT target, src AS source, severity, count(*) AS n, round(max(metric), 6)::DOUBLE AS metric FROM e GROUP BY ALL")
def r09(s, d):
    return _scan(s, d).groupBy("target", "source", "severity").agg(F.count("*").alias("n"), F.round(F.max("metric"), 6).alias("metric"))


@query("r09_assurance", "SELECT target, round(1 - risk, 4)::DOUBLE AS assurance FROM (WITH " + _FUSE.format(k="target") + ")")
def r09_assurance(s, d):
    return U.assurance_score(U.fuse(fx.evidence(s, d))).select("target", "assurance")


@query("j09_resolve_evidence", f"WITH {_E} SELECT evidence_id, 'FOUND' AS outcome FROM ev UNION ALL SELECT 'ev_missing_' || user_id, 'UNKNOWN' FROM (SELECT DISTINCT user_id FROM events)")
def j09(s, d):
    ev = fx.evidence(s, d)
    asked = ev.select("evidence_id").union(ev.select(F.concat(F.lit("ev_missing_"), "target").alias("evidence_id")).distinct())
    got, unknown = U.resolve(asked, ev)
    return got.select("evidence_id", F.lit("FOUND").alias("outcome")).union(unknown.select("evidence_id", F.lit("UNKNOWN").alias("outcome")))


@query("j13_subject_binding", "SELECT user_id, count(DISTINCT CASE WHEN event_type = 'error' THEN floor(value / 50)::BIGINT END) AS n_model FROM events GROUP BY user_id HAVING n_model > 1")
def j13(s, d):
    e = table(s, d, "events").withColumn("model", F.when(F.col("event_type") == "error", F.floor(F.col("value") / 50)))
    return U.binding_conflicts(e, "user_id", ["model"]).select("user_id", "n_model")


@query("a25_domain_breakdown", f"WITH {_E} SELECT target, source, count(*) AS n, CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 4 THEN 'QUARANTINED' WHEN 3 THEN 'UNDER_REVIEW' WHEN 2 THEN 'UNDER_REVIEW' ELSE 'ACCEPTED' END AS status FROM ev GROUP BY target, source")
def a25(s, d):
    rank = T.lookup(F.col("severity"), T.RANK, 0)
    g = fx.evidence(s, d).groupBy("target", "source").agg(F.count("*").alias("n"), F.max(rank).alias("rank"))
    return g.select("target", "source", "n", T.lookup(F.col("rank"), {4: "QUARANTINED", 3: "UNDER_REVIEW", 2: "UNDER_REVIEW"}, "ACCEPTED").alias("status"))


@query("a25_section_overview", f"""WITH {_E}, c AS (SELECT DISTINCT target, source FROM (SELECT target, source FROM ev UNION ALL SELECT DISTINCT target, 'CRYPTO_VERIFICATION' FROM ev UNION ALL SELECT DISTINCT target, 'CUSTOM_SOURCE' FROM ev WHERE target % 3 = 0)), k AS (SELECT target, max(metric) * 1.5 AS risk FROM ev GROUP BY target),
g AS (SELECT target, source, count(*) AS n, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS rank FROM ev GROUP BY ALL)
SELECT c.target, c.source, CASE c.source {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.SECTION_NAMES.items())} ELSE 'Custom Source' END AS layer_name, coalesce(n, 0) AS n, CASE rank WHEN 4 THEN 'QUARANTINED' WHEN 3 THEN 'UNDER_REVIEW' WHEN 2 THEN 'UNDER_REVIEW' ELSE 'ACCEPTED' END AS status, least(risk, 1)::DOUBLE AS risk_contribution FROM c LEFT JOIN g USING (target, source) JOIN k USING (target)""")
def a25_sections(s, d):
    """Sections of each target's report: sources with evidence, one that was checked without any, one without a fixed name."""
    ev = fx.evidence(s, d)
    targets = ev.select("target").distinct()
    checked = ev.select("target", "source").union(targets.withColumn("source", F.lit("CRYPTO_VERIFICATION"))).union(targets.where("target % 3 = 0").withColumn("source", F.lit("CUSTOM_SOURCE")))
    return B.sections(ev, checked, ev.groupBy("target").agg((F.max("metric") * 1.5).alias("risk")))
