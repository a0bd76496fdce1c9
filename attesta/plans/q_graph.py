"""Lineage queries over suppliers, parts, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import dashboard as B
from attesta.operators import lineage as L
from attesta.plans import fixtures as fx
from attesta.plans.lineage import cut, passing
from attesta.plans.registry import query, table

_B = f"{fx.NODES_SQL}, {fx.EDGES_SQL}"
#: The graph has three steps, so its traces are three joins: i inference, m model, t dataset, a contributor.
_STEPS = f"""{_B}, gen AS (SELECT source_id AS i, target_id AS m FROM edges WHERE edge_type = 'GENERATED_BY'), tra AS (SELECT source_id AS m, target_id AS t FROM edges WHERE edge_type = 'TRAINED_ON'),
aut AS (SELECT source_id AS t, target_id AS a FROM edges WHERE edge_type = 'AUTHORED_BY' AND source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes))"""
_FIND = f"{fx.FINDINGS_SQL}"


def _graph(s, d):
    return fx.edges(s, d), fx.nodes(s, d)


def _with_findings(s, d):
    e, n = _graph(s, d)
    new, more = L.attach_evidence(fx.findings(s, d).select("finding_id", "subject").distinct(), n)
    return e.unionByName(more), n.unionByName(new.distinct())


_HELD = "hq AS (SELECT 'q' || o_orderkey AS quarantine, 'o' || o_orderkey AS subject FROM orders WHERE o_orderkey % 200 = 1)"


def _with_quarantines(s, d):
    """The graph with findings, and a quarantine record for one order in two hundred."""
    e, n = _with_findings(s, d)
    held = table(s, d, "orders").where("o_orderkey % 200 = 1").select(F.concat(F.lit("q"), "o_orderkey").alias("q"), F.concat(F.lit("o"), "o_orderkey").alias("o"))
    return e.unionByName(held.select(F.col("q").alias("source_id"), F.col("o").alias("target_id"), F.lit("QUARANTINES").alias("edge_type"))), n.unionByName(held.select(F.col("q").alias("id"), F.lit("QUARANTINE_RECORD").alias("node_type")))


@query("g01_lineage_build", "SELECT 'node' AS kind, id AS a, node_type AS b FROM (SELECT 'c' || o_custkey AS id, 'CONTRIBUTOR' AS node_type FROM orders UNION SELECT 'o' || o_orderkey, 'MODEL' FROM orders UNION SELECT 'q' || o_orderkey, 'QUARANTINE_RECORD' FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT DISTINCT 'edge', 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'edge', 'q' || o_orderkey, 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def g01(s, d):
    wide = table(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("model_id"), F.concat(F.lit("c"), "o_custkey").alias("contributor_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("q"), "o_orderkey")).alias("quarantine_id"))
    n, e = L.build(wide, [("contributor_id", "CONTRIBUTOR"), ("model_id", "MODEL"), ("quarantine_id", "QUARANTINE_RECORD")], [("model_id", "contributor_id", "AUTHORED_BY"), ("quarantine_id", "model_id", "QUARANTINES")])
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("node_type").alias("b")).union(e.select(F.lit("edge"), "source_id", "target_id"))


@query("g02_edge_upsert", "WITH m AS (SELECT l_orderkey, l_partkey, l_returnflag AS k, max_by(l_quantity::INT, (l_shipdate, l_suppkey, l_quantity)) AS v FROM lineitem GROUP BY ALL) SELECT 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id, string_agg(k || '=' || v, ',' ORDER BY k) AS merged FROM m GROUP BY l_orderkey, l_partkey")
def g02(s, d):
    e = table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.lit("TRAINED_ON").alias("edge_type"), F.struct("l_shipdate", "l_suppkey", "l_quantity").alias("at"), F.create_map("l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("metadata"))
    up = L.upsert_edges(e, "at")
    return up.select("source_id", "target_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("merged"))


@query("g03_attach_evidence", f"WITH {_FIND}, f AS (SELECT DISTINCT finding_id, subject FROM findings) SELECT subject AS source_id, finding_id AS target_id, 'FLAGGED_WITH' AS edge_type FROM f UNION ALL SELECT finding_id, subject, 'ABOUT' FROM f")
def g03(s, d):
    _, n = _graph(s, d)
    return L.attach_evidence(fx.findings(s, d).select("finding_id", "subject").distinct(), n)[1]


@query("g04_upstream", f"WITH {_STEPS}, u AS (SELECT i AS root, m AS id, 1 AS depth FROM gen UNION SELECT i, t, 2 FROM gen JOIN tra USING (m) UNION SELECT i, a, 3 FROM gen JOIN tra USING (m) JOIN aut USING (t)) SELECT root, id, depth FROM u")
def g04(s, d):
    with passing(s):
        e, n = _graph(s, d)
        with passing(s):
            ends = L.fans(L.all_steps(e, n), keep=1)
        return L.traced(ends, n.where("node_type = 'INFERENCE'"), keep=1)


_DOWN = f"{_STEPS}, dn AS (SELECT t AS root, m AS id, 1 AS depth FROM tra UNION SELECT t, i, 2 FROM tra JOIN gen USING (m))"


@query("g05_downstream", f"WITH {_DOWN} SELECT root, id, depth FROM dn")
def g05(s, d):
    with passing(s):
        e, n = _graph(s, d)
        with passing(s):
            ends = L.fans(L.all_steps(e, n, downstream=True), keep=1)
        return L.traced(ends, n.where("node_type = 'DATASET'"), keep=1)


@query("g06_full_lineage", f"WITH {_STEPS}, {_FIND}, c AS (SELECT m AS root, m AS id FROM (SELECT DISTINCT m FROM gen) UNION SELECT m, t FROM tra UNION SELECT m, a FROM tra JOIN aut USING (t) UNION SELECT m, i FROM gen), f AS (SELECT DISTINCT subject, finding_id FROM findings) SELECT c.root, count(DISTINCT c.id) AS members, count(DISTINCT finding_id) AS findings FROM c LEFT JOIN f ON f.subject = c.id GROUP BY c.root")
def g06(s, d):
    with passing(s):
        e, n = (cut(x) for x in _with_findings(s, d))
        words = L.words_of(n.where("node_type = 'MODEL'").select("id"))
        with passing(s):
            up, down = (L.fans(L.all_steps(e, n, downstream=k), keep=1) for k in (False, True))
        evidence = cut(L.attached(e, n))

        def counts(within):
            seeds, own = within(L.seeded(words)), within(words)
            cluster = cut(L.once(L.spread(up, seeds).union(L.spread(down, seeds))))
            found = L.counted(L.once(cluster.join(evidence, "id"), "evidence"), own, "findings")
            return L.counted(cluster, own, "members").join(found, "root", "left").select("root", "members", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))

        return L.in_blocks(words, counts, keep=1)


@query("u05_cluster_union", f"WITH {_STEPS}, c AS (SELECT i AS root, i AS id FROM gen UNION SELECT i, m FROM gen UNION SELECT i, t FROM gen JOIN tra USING (m) UNION SELECT i, a FROM gen JOIN tra USING (m) JOIN aut USING (t)) SELECT root, count(*) AS members FROM c GROUP BY root")
def u05(s, d):
    with passing(s):
        e, n = _graph(s, d)
        words = L.words_of(n.where("node_type = 'INFERENCE'").select("id"))
        with passing(s):
            ends = L.fans(L.all_steps(e, n), keep=1)
        return L.members(lambda within: L.spread(ends, within(L.seeded(words))), words, keep=1)


@query("g07_attached_evidence", f"WITH {_FIND} SELECT DISTINCT subject AS id, finding_id AS evidence FROM findings")
def g07(s, d):
    e, n = _with_findings(s, d)
    return L.attached(e, n).where("id like 'o%'")


@query("g08_neighbours", f"WITH {_B}, x AS (SELECT source_id AS id, target_id AS other, 1 AS o FROM edges UNION ALL SELECT target_id, source_id, 0 FROM edges) SELECT n.id, count(*) FILTER (o = 0) AS n_in, count(*) FILTER (o = 1) AS n_out, count(DISTINCT other) FILTER (other IN (SELECT id FROM nodes) AND other <> n.id) AS n_neighbours FROM nodes n LEFT JOIN x ON x.id = n.id GROUP BY n.id")
def g08(s, d):
    return L.neighbours(*_graph(s, d))


_BLAST = f"""WITH {_DOWN}, {_FIND}, f AS (SELECT DISTINCT subject, finding_id FROM findings), c AS (SELECT root, count(*) FILTER (depth = 1) AS models, count(*) FILTER (depth = 2) AS inferences, count(*) AS downstream FROM dn GROUP BY root),
ev AS (SELECT root, count(DISTINCT finding_id) AS evidence FROM dn JOIN f ON subject = id GROUP BY root), dg AS (SELECT id, count(*) AS direct FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id)"""


@query("g09_blast_radius", f"{_BLAST}, {_HELD}, qn AS (SELECT root, count(DISTINCT quarantine) AS quarantines FROM dn JOIN hq ON subject = id GROUP BY root) SELECT n.id AS root, 0 AS runs, coalesce(models, 0) AS models, coalesce(inferences, 0) AS inferences, coalesce(downstream, 0) AS downstream, coalesce(evidence, 0) AS evidence, coalesce(quarantines, 0) AS quarantines, coalesce(direct, 0) AS direct, coalesce(models + inferences, 0) AS total, CASE WHEN quarantines > 0 THEN 'QUARANTINED' WHEN evidence > 0 THEN 'UNDER_REVIEW' ELSE 'ACCEPTED' END AS status FROM nodes n LEFT JOIN c ON c.root = n.id LEFT JOIN ev ON ev.root = n.id LEFT JOIN qn ON qn.root = n.id LEFT JOIN dg ON dg.id = n.id WHERE node_type = 'DATASET'")
def g09(s, d):
    e, n = _with_quarantines(s, d)
    return L.blast_radius(e, n, n.where("node_type = 'DATASET'").select("id"))


@query("g10_integrity", f"WITH {_B} SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM nodes) OR target_id NOT IN (SELECT id FROM nodes)) AS broken, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)) AS orphans, false AS valid")
def g10(s, d):
    return L.integrity(*_graph(s, d))


@query("g11_subgraph", f"WITH {_STEPS}, x AS (SELECT t AS root, t AS id FROM (SELECT id AS t FROM nodes WHERE node_type = 'DATASET') UNION SELECT t, m FROM tra UNION SELECT t, a FROM aut UNION SELECT t, i FROM tra JOIN gen USING (m)) SELECT root, count(*) AS members FROM x GROUP BY root")
def g11(s, d):
    with passing(s):
        e, n = _graph(s, d)
        kind = F.col("node_type")
        area, words = L.subgraph_area(cut(e), n, n.where("node_type = 'DATASET'").select("id"), stops=kind == "DATASET", passes=kind != "CONTRIBUTOR")
        return L.members(area, words, keep=1)


@query("g11_batch_subgraph", f"WITH {_STEPS}, owned AS (SELECT 'c' || o_custkey || '_' || o_orderkey AS i FROM orders WHERE o_orderkey % 7 = 0), x AS (SELECT id AS root, id FROM nodes WHERE node_type = 'DATASET' UNION SELECT t, m FROM tra WHERE t IN (SELECT id FROM nodes) UNION SELECT t, a FROM aut UNION SELECT t, i FROM tra JOIN gen USING (m) WHERE i NOT IN (SELECT i FROM owned) UNION SELECT 'p' || p_partkey, 'report' || p_partkey FROM part WHERE p_partkey % 3 = 0) SELECT root, count(*) AS members FROM x GROUP BY root")
def g11_batch(s, d):
    """Some inferences belong to another batch; a report of every third dataset names it and hangs on nothing."""
    e, n = _graph(s, d)
    owned = table(s, d, "orders").where("o_orderkey % 7 = 0").select(F.concat(F.lit("c"), "o_custkey", F.lit("_"), "o_orderkey").alias("id"), F.lit("elsewhere").alias("batch_id"))
    none = F.lit(None).cast("string")
    n = n.join(owned, "id", "left").select("id", "node_type", "batch_id", none.alias("dataset_id"), none.alias("scan_id"))
    part = table(s, d, "part").where("p_partkey % 3 = 0")
    reports = part.select(F.concat(F.lit("report"), "p_partkey"), F.lit("REPORT"), none, none, F.concat(F.lit("p"), "p_partkey"))
    with passing(s):
        area, words = L.batch_area(cut(e), n.union(reports), n.where("node_type = 'DATASET'").select("id"))
        return L.members(area, words, keep=1)


@query("g12_graph_digest", f"WITH {_B}, r AS (SELECT sha256('n|' || id || '|' || node_type) AS h FROM nodes UNION ALL SELECT sha256('e|' || source_id || '|' || target_id || '|' || edge_type) FROM edges), b AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS hh FROM r GROUP BY 1) SELECT sha256(string_agg(hh, '' ORDER BY b)) AS graph_digest FROM b")
def g12(s, d):
    return L.digest(*_graph(s, d))


@query("j14_edge_subjects", "SELECT 'e' || l_orderkey || '_' || l_partkey AS source_id, 'o' || l_orderkey AS target_id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 11 = 0)")
def j14(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    ev = F.concat(F.lit("e"), "l_orderkey", F.lit("_"), "l_partkey")
    named = F.concat(F.lit("o"), F.when(F.col("l_partkey") % 11 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")))
    nodes = li.select(ev.alias("id"), F.lit("EVIDENCE").alias("node_type"), named.alias("model_id"))
    return L.subject_mismatches(li.select(ev.alias("source_id"), F.concat(F.lit("o"), "l_orderkey").alias("target_id"), F.lit("ABOUT").alias("edge_type")), nodes, "model_id").select("source_id", "target_id")


_RISK = f"""WITH {_STEPS}, {_FIND}, f AS (SELECT finding_id, subject, min(severity) AS severity FROM findings GROUP BY ALL), g AS (SELECT DISTINCT a AS who, t FROM aut UNION SELECT 's1', 'p' || p_partkey FROM part WHERE p_partkey % 50 = 3), z AS (SELECT who, count(*) AS datasets, sum(CASE WHEN p_partkey % 100 = 7 THEN 60 ELSE p_size END)::BIGINT AS samples FROM g JOIN part ON 'p' || p_partkey = t GROUP BY who),
m AS (SELECT DISTINCT who, m FROM g JOIN tra USING (t)), x AS (SELECT who, subject, finding_id, severity FROM m JOIN f ON subject = m UNION SELECT 's2', 's2', 'fs2', 'CRITICAL'), k AS (SELECT who, count(*) AS findings, count(*) FILTER (severity = 'CRITICAL') AS critical, sum(CASE severity WHEN 'CRITICAL' THEN 0.35 ELSE 0.2 END)::DOUBLE AS penalty FROM x GROUP BY who),
hq AS (SELECT DISTINCT who FROM m JOIN orders ON 'o' || o_orderkey = m WHERE o_orderkey % 20000 = 1),
r AS (SELECT n.id AS contributor, coalesce(datasets, 0) AS datasets, coalesce(samples, 0) AS samples, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical, round(least(1, greatest(0, coalesce(penalty, 0) / greatest(1, ln(1 + coalesce(samples, 0))), CASE WHEN n.id IN (SELECT who FROM hq) THEN 0.85 WHEN critical >= 2 THEN 0.75 WHEN critical = 1 THEN 0.4 ELSE 0 END)), 4)::DOUBLE AS risk FROM nodes n LEFT JOIN z ON z.who = n.id LEFT JOIN k ON k.who = n.id WHERE node_type = 'CONTRIBUTOR')"""


def _risk(s, d):
    """Some parts are a contributor's by property only, some have more sample edges than their property says, one contributor
    has a finding of its own, and few orders are quarantined."""
    e, n = _with_findings(s, d)
    part = table(s, d, "part")
    name = F.concat(F.lit("p"), "p_partkey")
    edge = lambda df, a, b, t: df.select(a.alias("source_id"), b.alias("target_id"), F.lit(t).alias("edge_type"))
    samples = part.where("p_partkey % 100 = 7").select(name.alias("p"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("k")).select("p", F.concat("p", F.lit("_"), "k").alias("x"))
    held = table(s, d, "orders").where("o_orderkey % 20000 = 1").select(F.concat(F.lit("q"), "o_orderkey").alias("q"), F.concat(F.lit("o"), "o_orderkey").alias("o"))
    one = s.range(1).select(F.lit("fs2").alias("f"), F.lit("s2").alias("s"))
    e = e.unionByName(edge(samples, F.col("p"), F.col("x"), "CONTAINS_SAMPLE")).unionByName(edge(held, F.col("q"), F.col("o"), "QUARANTINES")).unionByName(edge(one, F.col("f"), F.col("s"), "ABOUT"))
    node = lambda df, c, t: df.select(F.col(c).alias("id"), F.lit(t).alias("node_type"))
    n = n.unionByName(node(samples, "x", "SAMPLE")).unionByName(node(held, "q", "QUARANTINE_RECORD")).unionByName(node(one, "f", "FINDING"))
    sev = fx.findings(s, d).groupBy(F.col("finding_id").alias("evidence")).agg(F.min("severity").alias("severity")).unionByName(one.select(F.col("f").alias("evidence"), F.lit("CRITICAL").alias("severity")))
    properties = part.select(name.alias("id"), F.when(F.col("p_partkey") % 50 == 3, "s1").alias("contributor_id"), F.col("p_size").alias("sample_count"))
    return L.contributor_risk(e, n, sev, properties)


@query("r05_contributor_risk", f"{_RISK} SELECT *, CASE WHEN risk >= 0.7 THEN 'QUARANTINED' WHEN risk >= 0.3 THEN 'UNDER_REVIEW' ELSE 'ACCEPTED' END AS status FROM r")
def r05(s, d):
    return _risk(s, d)


@query("t02_leaderboard", f"{_RISK} SELECT contributor, risk FROM r ORDER BY risk DESC, contributor LIMIT 20")
def t02(s, d):
    return _risk(s, d).orderBy(F.desc("risk"), "contributor").limit(20).select("contributor", "risk")


_INSPECT = f"""{_FIND}, m AS (SELECT subject AS id, CASE WHEN severity = 'HIGH' AND l % 3 = 0 THEN 'MEDIUM' WHEN severity = 'HIGH' AND l % 3 = 1 THEN 'low' ELSE severity END AS severity FROM (SELECT *, regexp_extract(subject, '[0-9]+')::BIGINT AS l FROM findings)),
w AS (SELECT id, count(*) AS n, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS rank FROM m GROUP BY id), r AS (SELECT 'o' || (o_orderkey - o_orderkey % 3) AS id, max_by('rep_' || o_orderkey, (o_orderdate, 'rep_' || o_orderkey)) AS latest_report FROM orders GROUP BY ALL)"""


@query("a15_investigation", f"WITH {_INSPECT} SELECT o.id, CASE rank WHEN 4 THEN 'QUARANTINED' WHEN 3 THEN 'UNDER_REVIEW' WHEN 2 THEN 'UNDER_REVIEW' ELSE 'ACCEPTED' END AS status, CASE rank WHEN 4 THEN 0.85 WHEN 3 THEN 0.5 WHEN 2 THEN 0.35 ELSE 0.0 END::DOUBLE AS risk, coalesce(n, 0) AS n_findings, CASE rank WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END AS worst, latest_report FROM (SELECT 'o' || o_orderkey AS id FROM orders) o LEFT JOIN w USING (id) LEFT JOIN r USING (id)")
def a15(s, d):
    """Each order with its findings, of all severities, and the latest report about it; reports of three orders are about one."""
    o, number = table(s, d, "orders"), F.regexp_extract("subject", "[0-9]+", 0).cast("long") % 3
    high = F.col("severity") == "HIGH"
    found = fx.findings(s, d).select(F.col("subject").alias("id"), F.when(high & (number == 0), "MEDIUM").when(high & (number == 1), "low").otherwise(F.col("severity")).alias("severity"))
    reports = o.select(F.concat(F.lit("o"), F.col("o_orderkey") - F.col("o_orderkey") % 3).alias("target_asset_id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("rep_"), "o_orderkey").alias("report_id"))
    return B.investigations(o.select(F.concat(F.lit("o"), "o_orderkey").alias("id")), found, reports)
