"""Chains, ledgers, provenance and Merkle trees over events and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions.canonical import canonical_sha256, zoneless_text
from attesta.functions.hashing import canonical_digest
from attesta.operators import chain as C
from attesta.operators import merkle as M
from attesta.operators.dashboard import scorecard
from attesta.operators.rows import evidence_lines
from attesta.plans import fixtures as fx
from attesta.plans.lineage import cut
from attesta.plans.prefix import dealt, scanned
from attesta.plans.registry import query, table

_C, _B, G = fx.CHAIN_SQL, fx.CHAIN_BAD_SQL, fx.GENESIS
_CHECK = f"""{_B}, checked AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(lag(current_hash) OVER w, '{G}') AS expected_prev FROM chain_bad WINDOW w AS (PARTITION BY chain ORDER BY seq)),
reasons AS (SELECT *, CASE WHEN seq <> position THEN 'SEQUENCE' WHEN prev_hash <> expected_prev THEN 'POINTER' WHEN sha256(seq || stamp || data_hash || prev_hash) <> current_hash AND current_hash <> data_hash THEN 'HASH' END AS reason FROM checked)"""


def _built(s, d):
    return C.build(fx.chain_links(s, d))


def _bad(s, d):
    return fx.break_chains(_built(s, d))


@query("c01_chain_build", f"WITH {_C} SELECT * FROM chained")
def c01(s, d):
    return _built(s, d)


@query("c02_chain_verify", f"WITH {_CHECK} SELECT chain, count(*) AS blocks, coalesce(min(position) FILTER (reason IS NOT NULL), count(*)) AS verified, min(position) FILTER (reason IS NOT NULL) AS first_bad, arg_min(reason, position) FILTER (reason IS NOT NULL) AS reason, max_by(current_hash, position) AS head FROM reasons GROUP BY chain")
def c02(s, d):
    return C.verdicts(C.checks(_bad(s, d), keep=[]))


@query("w01_pointer_continuity", f"WITH {_CHECK} SELECT chain, seq, prev_hash = expected_prev AS continuous FROM checked")
def w01(s, d):
    return C.checks(_bad(s, d), keep=[]).select("chain", "seq", (F.col("prev_hash") == F.col("expected_prev")).alias("continuous"))


@query("w02_sequence_continuity", f"WITH {_CHECK} SELECT chain, seq, seq = position AS positioned, coalesce(seq = lag(seq) OVER (PARTITION BY chain ORDER BY seq) + 1, true) AS stepped FROM checked")
def w02(s, d):
    return C.checks(_bad(s, d), keep=[]).select("chain", "seq", (F.col("seq") == F.col("position")).alias("positioned"), F.coalesce(F.col("seq") == F.col("prev_seq") + 1, F.lit(True)).alias("stepped"))


@query("w07_first_broken", f"WITH {_CHECK} SELECT chain, min(position) AS first_bad, arg_min(reason, position) AS reason FROM reasons WHERE reason IS NOT NULL GROUP BY chain")
def w07(s, d):
    return C.verdicts(C.checks(_bad(s, d), keep=[])).where("first_bad is not null").select("chain", "first_bad", "reason")


@query("a16_scorecard", f"""WITH {_CHECK}, n AS (SELECT chain, count(*) AS n FROM chained GROUP BY chain), v AS (SELECT chain, arg_min(reason, position) FILTER (reason IS NOT NULL) AS reason FROM reasons GROUP BY chain),
o AS (SELECT CASE chain % 4 WHEN 1 THEN 'data' WHEN 2 THEN 'pointer' WHEN 3 THEN 'lost' ELSE 'whole' END AS kind, (chain % 4 = 1 AND n > 3) OR (chain % 4 = 2 AND n > 5) OR (chain % 4 = 3 AND n > 7) AS expected, reason IS NOT NULL AS found, reason = 'SEQUENCE' AS review FROM n LEFT JOIN v USING (chain))
SELECT coalesce(kind, 'ALL') AS category, count(*) AS total, count(*) FILTER (expected AND found) AS detected, count(*) FILTER (expected AND NOT found) AS missed, count(*) FILTER (NOT expected AND found) AS false_positives, count(*) FILTER (review) AS reviewed, count(*) FILTER (found AND NOT review) AS blocked, round(count(*) FILTER (expected = found) / count(*)::DOUBLE, 4) AS accuracy FROM o GROUP BY ROLLUP (kind)""")
def a16(s, d):
    """The chain audit against what was planted: changed data and pointers are blocked, lost blocks go to review."""
    built = cut(_built(s, d))
    c, n = F.col("chain") % 4, F.col("n")
    kind = F.when(c == 1, "data").when(c == 2, "pointer").when(c == 3, "lost").otherwise("whole")
    sizes = built.groupBy("chain").agg(F.count("*").alias("n")).select("chain", kind.alias("kind"), ((c == 1) & (n > 3) | (c == 2) & (n > 5) | (c == 3) & (n > 7)).alias("expected"))
    found = C.verdicts(C.checks(fx.break_chains(built), keep=[])).select("chain", F.when(F.col("reason") == "SEQUENCE", "REVIEW").when(F.col("reason").isNotNull(), "BLOCK").otherwise("ALLOW").alias("actual"))
    return scorecard(sizes.join(found, "chain", "left").na.fill("ALLOW", ["actual"]), category="kind", expected="expected", actual="actual")


@query("c15_chain_state", f"WITH {_C} SELECT chain, count(*) AS records, max_by(current_hash, seq) AS tip FROM chained GROUP BY chain")
def c15(s, d):
    return C.state(_built(s, d))


# One chain over all events: every second block is a sealed root, so that the chain can be made without going through it in order.
_ONE = f"""base AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, sha256(event_type || ':' || event_id) AS data_hash FROM events), linked AS (SELECT *, lag(data_hash) OVER (ORDER BY seq) AS sealed FROM base),
hashed AS (SELECT *, CASE WHEN seq % 2 = 0 THEN sha256(seq || stamp || data_hash || coalesce(sealed, '{G}')) ELSE data_hash END AS current_hash FROM linked),
whole AS (SELECT seq, stamp, data_hash, coalesce(lag(current_hash) OVER (ORDER BY seq), '{G}') AS prev_hash, current_hash FROM hashed),
one AS (SELECT seq, CASE WHEN seq % 300 = 100 THEN sha256('x') ELSE stamp END AS stamp, data_hash, CASE WHEN seq % 500 = 77 THEN sha256('y') ELSE prev_hash END AS prev_hash, current_hash FROM whole WHERE seq <> (SELECT count(*) * 9 // 10 FROM events)),
checked AS (SELECT *, row_number() OVER w - 1 AS position, lag(seq) OVER w AS prev_seq, coalesce(lag(current_hash) OVER w, '{G}') AS expected_prev FROM one WINDOW w AS (ORDER BY seq)),
reasons AS (SELECT *, CASE WHEN seq <> position THEN 'SEQUENCE' WHEN prev_hash <> expected_prev THEN 'POINTER' WHEN sha256(seq || stamp || data_hash || prev_hash) <> current_hash AND current_hash <> data_hash THEN 'HASH' END AS reason FROM checked)"""


def _one_chain(s, d):
    """One chain over all events; changed stamps, changed pointers and, from nine tenths on, a lost block."""
    e = table(s, d, "events").select(F.lit("all").alias("chain"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.sha2(F.concat_ws(":", "event_type", "event_id"), 256).alias("data_hash"))
    parts = dealt(e, ["chain"], ["seq"])
    sealed = scanned(parts, ["chain"], ["seq"], lags={"_sealed": "data_hash"})
    own = C.block_hash(F.col("seq"), F.col("stamp"), F.col("data_hash"), F.coalesce("_sealed", F.lit(C.GENESIS)))
    hashed = sealed.withColumn("current_hash", F.when(F.col("seq") % 2 == 0, own).otherwise(F.col("data_hash")))
    whole = scanned(hashed, ["chain"], ["seq"], lags={"prev_hash": "current_hash"}).withColumn("prev_hash", F.coalesce("prev_hash", F.lit(C.GENESIS)))
    lost = e.count() * 9 // 10
    bad = whole.where(F.col("seq") != lost).withColumns({"stamp": F.when(F.col("seq") % 300 == 100, F.sha2(F.lit("x"), 256)).otherwise(F.col("stamp")), "prev_hash": F.when(F.col("seq") % 500 == 77, F.sha2(F.lit("y"), 256)).otherwise(F.col("prev_hash"))})
    return C.checks(bad.select("chain", "seq", "stamp", "data_hash", "prev_hash", "current_hash"), keep=[])


@query("c02_one_chain", f"WITH {_ONE} SELECT 'all' AS chain, count(*) AS blocks, coalesce(min(position) FILTER (reason IS NOT NULL), count(*)) AS verified, min(position) FILTER (reason IS NOT NULL) AS first_bad, arg_min(reason, position) FILTER (reason IS NOT NULL) AS reason, max_by(current_hash, position) AS head FROM reasons")
def c02_one(s, d):
    return C.verdicts(_one_chain(s, d))


@query("w01_one_chain", f"WITH {_ONE} SELECT seq, prev_hash = expected_prev AS continuous, coalesce(seq = prev_seq + 1, true) AS stepped, reason FROM reasons")
def w01_one(s, d):
    return _one_chain(s, d).select("seq", (F.col("prev_hash") == F.col("expected_prev")).alias("continuous"), F.coalesce(F.col("seq") == F.col("prev_seq") + 1, F.lit(True)).alias("stepped"), "reason")


# -- ledgers --------------------------------------------------------------------------------------------------------------
_EVENT = """sha256('{"actor":"system","entity_id":"user_' || %s || '","event_type":"' || event_type || '","payload_hash":"' || payload_hash || '","previous_hash":"' || %s || '","scan_id":' || coalesce('"' || scan_id || '"', 'null') || ',"sequence":' || %s || ',"timestamp":"' || "timestamp" || '"}')"""
_ISO = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00'"""
_FIRST = f"""SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type, CASE WHEN event_id % 4 = 0 THEN 'scan "' || event_id || '"' END AS scan, {_ISO} AS "timestamp", sha256('{{"event_type":"' || event_type || '","id":' || event_id || ',"value":' || value || '}}') AS payload_hash FROM events"""


def _ledger_sql(links: str = "SELECT * FROM l0", more: str = "") -> str:
    return f"""RECURSIVE l0 AS ({_FIRST}), {more} l AS (SELECT *, replace(scan, '"', '\\"') AS scan_id FROM ({links})),
led(chain, seq, event_type, payload_hash, prev_hash, current_hash) AS (SELECT chain, seq, event_type, payload_hash, '{G}', {_EVENT % ('chain', f"{G}", 'seq')} FROM l WHERE seq = 0
 UNION ALL SELECT l.chain, l.seq, l.event_type, l.payload_hash, c.current_hash, {_EVENT.replace("|| event_type ||", "|| l.event_type ||").replace("|| payload_hash ||", "|| l.payload_hash ||") % ('l.chain', "' || c.current_hash || '", 'l.seq')} FROM led c JOIN l ON l.chain = c.chain AND l.seq = c.seq + 1)""".replace(f"|| {G} ||", f"|| '{G}' ||").replace("|| ' || c.current_hash || ' ||", "|| c.current_hash ||")


_LEDGER = _ledger_sql()


def _ledger(s, d):
    e = table(s, d, "events")
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    payload = canonical_sha256(e, {"event_type": F.col("event_type"), "id": F.col("event_id"), "value": F.col("value")})
    scan = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('scan "'), F.col("event_id"), F.lit('"')))
    return _link(e.select(F.col("user_id").alias("chain"), seq.alias("seq"), "event_type", payload.alias("payload_hash"), scan.alias("scan_id"), zoneless_text(F.col("ts")).alias("timestamp")))


def _named(rows):
    return rows.withColumns({"actor": F.lit("system"), "entity_id": F.concat(F.lit("user_"), "chain")})


def _link(rows):
    rows = _named(rows)
    return C.build(rows, envelope=C.ledger_envelope(rows))


_LINKS = ["chain", "seq", "event_type", "payload_hash", "prev_hash", "current_hash"]


@query("c03_ledger_build", f"WITH {_LEDGER} SELECT * FROM led")
def c03(s, d):
    return _ledger(s, d).select(*_LINKS)


@query("c04_ledger_verify", f"""WITH {_LEDGER}, n AS (SELECT chain, count(*) AS n FROM led GROUP BY chain), f AS (SELECT chain, n, CASE WHEN chain % 5 = 0 AND n > 4 THEN 4 END AS tampered, CASE WHEN chain % 3 = 0 AND n > 6 THEN 6 END AS unsigned FROM n), x AS (SELECT *, least(tampered, unsigned) AS first FROM f)
SELECT chain, first IS NULL AS valid, coalesce(first, n) AS events_checked, coalesce(first, n) - 1 AS last_verified, first::BIGINT AS first_invalid, CASE WHEN first IS NULL THEN NULL WHEN first = tampered THEN 'HASH' ELSE 'SIGNATURE' END AS reason, CASE WHEN first IS NULL THEN NULL WHEN first = tampered OR chain % 2 = 0 THEN 'TAMPER' ELSE 'KEY_ROTATION' END AS likely_cause FROM x""")
def c04(s, d):
    """Ledgers with a changed payload, and with signatures that fail: of the present key, or of one before it."""
    c, seq = F.col("chain"), F.col("seq")
    bad = _ledger(s, d).withColumn("payload_hash", F.when((c % 5 == 0) & (seq == 4), F.sha2(F.lit("x"), 256)).otherwise(F.col("payload_hash")))
    bad = bad.withColumns({"signed": ~((c % 3 == 0) & (seq == 6)), "key": F.when(c % 2 == 0, "now").when(c % 4 == 1, "old")})
    return C.ledger_verdicts(C.checks(bad, envelope=C.ledger_envelope(bad), keep=["signed", "key"]), signed="signed", fingerprint="key", current="now")


_ASKED = """a AS (SELECT user_id AS chain, event_id, CASE event_type WHEN 'error' THEN 'QUARANTINE' WHEN 'view' THEN 'ACCEPT' ELSE 'MAYBE' END AS decision FROM events WHERE value >= 150), m AS (SELECT chain, max(seq) AS m FROM l0 GROUP BY chain),"""
_DECIDED = """SELECT * FROM l0 UNION ALL SELECT a.chain, m + row_number() OVER (PARTITION BY a.chain ORDER BY event_id), 'ANALYST_DECISION', NULL, '', sha256('{"decision":"' || decision || '","event":' || event_id || '}') FROM a JOIN m USING (chain) WHERE decision <> 'MAYBE'"""


@query("c05_decisions", f"WITH {_ledger_sql(_DECIDED, _ASKED)} SELECT chain, seq, prev_hash, current_hash FROM led WHERE event_type = 'ANALYST_DECISION'")
def c05(s, d):
    """Decisions about large events, those that are none left out, appended to each user's ledger."""
    e = table(s, d, "events").where("value >= 150")
    choice = F.when(F.col("event_type") == "error", "QUARANTINE").when(F.col("event_type") == "view", "ACCEPT").otherwise("MAYBE")
    asked = C.decisions(e.select(F.col("user_id").alias("chain"), "event_id", choice.alias("decision")))
    payload = canonical_sha256(asked, {"decision": F.col("decision"), "event": F.col("event_id")})
    rows = _named(asked.select("chain", "event_id", F.lit("ANALYST_DECISION").alias("event_type"), payload.alias("payload_hash"), F.lit(None).cast("string").alias("scan_id"), F.lit("").alias("timestamp")))
    numbered = rows.withColumn("seq", F.lit(0).cast("long"))
    return C.extend(_ledger(s, d), rows, order="event_id", envelope=C.ledger_envelope(numbered)).select("chain", "seq", "prev_hash", "current_hash")


@query("w03_replay", "SELECT event_id, event_id > min(event_id) OVER (PARTITION BY user_id, floor(value)) AS replayed FROM events")
def w03(s, d):
    dna = table(s, d, "events").withColumn("nonce", F.sha2(F.concat_ws(":", "user_id", F.floor("value")), 256)).withColumn("record", F.col("event_id"))
    return C.replays(dna, "event_id", ["nonce", "record"]).select("event_id", "replayed")


@query("w04_recent_duplicate", "SELECT event_id, coalesce(list_contains(list(floor(value)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), floor(value)), false) AS recent FROM events")
def w04(s, d):
    frames = table(s, d, "events").withColumn("h", F.floor("value"))
    return C.recent_duplicates(frames, "event_type", ["event_id"], "h").select("event_id", "recent")


@query(
    "w05_evidence_lines",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw0, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM conversations), p AS (SELECT conv_id, turn * 100000 + k AS pos, CASE WHEN turn % 2 = 1 THEN 'spatial_window_' || turn % 5 ELSE raw0 END AS raw FROM l),
n AS (SELECT conv_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line, min((pos, raw)) AS f FROM p GROUP BY ALL), x AS (SELECT conv_id, line LIKE '%spatial_window_%' OR lower(line) LIKE '%sliding window%' AS sp, f[1] AS pos, f[2] AS raw FROM n),
m AS (SELECT conv_id, count(*) AS c, min((pos, raw)) AS f FROM x WHERE sp GROUP BY conv_id), e AS (SELECT conv_id, 0 AS z, pos, raw FROM x WHERE NOT sp UNION ALL SELECT conv_id, 1, f[1], CASE WHEN c = 1 THEN f[2] ELSE 'Suspicious repeated static localized patch patterns detected across ' || c || ' spatial windows.' END FROM m)
SELECT conv_id, list(raw ORDER BY z, pos)[1:3] AS first_lines, count(*) AS n FROM e GROUP BY conv_id""".replace("f[1]", "struct_extract_at(f, 1)").replace("f[2]", "struct_extract_at(f, 2)"),
)
def w05(s, d):
    """Lines of conversations; those of odd turns stand for windows."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    raw = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("spatial_window_"), F.col("turn") % 5)).otherwise(F.col("raw"))
    return evidence_lines(c.select("conv_id", (F.col("turn") * 100_000 + F.col("k")).alias("at"), raw.alias("raw")), ["conv_id"], "at", "raw")


# -- Merkle ---------------------------------------------------------------------------------------------------------------
_TREE = """RECURSIVE leaf AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, sha256(text) AS hash, doc_id FROM documents),
tree(lvl, idx, hash, n) AS (SELECT 0, idx, hash, (SELECT count(*) FROM leaf) FROM leaf
 UNION ALL SELECT * FROM (SELECT max(lvl) + 1 AS lvl, idx // 2 AS idx, sha256(min_by(hash, idx) || max_by(hash, idx)) AS hash, (max(n) + 1) // 2 AS n FROM tree WHERE n > 1 GROUP BY idx // 2))"""
_ROOT = "SELECT hash FROM tree WHERE n = 1"


def _leaves(s, d):
    return M.numbered(table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), "doc_id")


@query("c06_merkle_root", f"WITH {_TREE} SELECT hash AS root FROM tree WHERE n = 1")
def c06(s, d):
    return M.root(_leaves(s, d))


@query("c07_merkle_proofs", f"""WITH {_TREE} SELECT l.idx, l.hash, string_agg(coalesce(sib.hash, own.hash) || CASE WHEN (l.idx >> own.lvl) % 2 = 1 THEN 'L' ELSE 'R' END, ',' ORDER BY own.lvl) AS proof
FROM leaf l JOIN tree own ON own.idx = l.idx >> own.lvl AND own.n > 1 LEFT JOIN tree sib ON sib.lvl = own.lvl AND sib.idx = xor(own.idx, 1) GROUP BY l.idx, l.hash""")
def c07(s, d):
    leaves = _leaves(s, d)
    p = M.proofs(leaves, leaves)
    return p.select("idx", "hash", F.array_join(F.transform("proof", lambda x: F.concat(x["hash"], F.when(x["left"], "L").otherwise("R"))), ",").alias("proof"))


@query("c08_proof_verify", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id % 100 <> 0 AS valid FROM documents")
def c08(s, d):
    leaves = _leaves(s, d)
    p = M.proofs(leaves, leaves).join(F.broadcast(M.root(leaves)))
    ids = leaves.select("idx", "doc_id")
    forged = p.join(ids, "idx").withColumn("hash", F.when(F.col("doc_id") % 100 == 0, F.sha2(F.lit("forged"), 256)).otherwise(F.col("hash")))
    return M.verify(forged).select("idx", "valid")


@query("c09_leaf_digest", """SELECT doc_id, sha256('{"label":' || coalesce(quality::VARCHAR, 'null') || ',"sample_id":' || doc_id || ',"sha256":"' || sha256(text) || '"}') AS leaf FROM documents LEFT JOIN labels USING (doc_id)""")
def c09(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", canonical_digest({"label": F.col("quality"), "sample_id": F.col("doc_id"), "sha256": F.sha2("text", 256)}).alias("leaf"))


_GROUP_TREE = """RECURSIVE leaf AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, sha256(doc_id || ':' || n_chars || ':' || sha256(text)) AS hash, count(*) OVER (PARTITION BY source) AS n FROM documents),
tree(source, idx, hash, n) AS (SELECT source, idx, hash, n FROM leaf UNION ALL SELECT * FROM (SELECT source, idx // 2 AS idx, sha256(min_by(hash, idx) || max_by(hash, idx)) AS hash, (max(n) + 1) // 2 AS n FROM tree WHERE n > 1 GROUP BY source, idx // 2))"""


@query("c10_dataset_digest", f"WITH {_GROUP_TREE} SELECT source, hash AS root FROM tree WHERE n = 1")
def c10(s, d):
    leaf = F.sha2(F.concat_ws(":", "doc_id", "n_chars", F.sha2("text", 256)), 256)
    rows = M.numbered(table(s, d, "documents").select("source", "doc_id", leaf.alias("hash")), "doc_id", ["source"])
    return M.grouped_roots(rows, ["source"])


# -- provenance -----------------------------------------------------------------------------------------------------------
_RECORD = """'{"inference_config_hash":"' || repeat('0', 64) || '","input_hash":"' || sha256(props) || '","model_digest":"' || sha256(event_type) || CASE WHEN event_id % 3 = 0 THEN '","model_id":"' || event_type ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '","model_version":"1.0.' || event_id % 7 ELSE '' END
|| '","nonce":"n' || event_id || '","output_hash":"' || sha256(user_id::VARCHAR) || '","prep_digest":"' || sha256('prep') || '","prev_chain_hash":"' || repeat('0', 64) || CASE WHEN event_id % 2 = 0 THEN '","record_id":"r' || event_id ELSE '' END || '","score":' || value || ',"sequence_id":' || event_id || ',"timestamp":"' || """ + _ISO + """ || '"}'"""


@query("c11_provenance_digest", f"SELECT event_id, sha256({_RECORD}) AS digest FROM events")
def c11(s, d):
    e, n = table(s, d, "events"), F.col("event_id")
    zeros, sha = F.lit("0" * 64), lambda c: F.sha2(c.cast("string"), 256)
    fields = {"sequence_id": n, "timestamp": zoneless_text(F.col("ts")), "nonce": F.concat(F.lit("n"), n), "input_hash": sha(F.col("props")), "model_digest": sha(F.col("event_type")), "prep_digest": sha(F.lit("prep")), "inference_config_hash": zeros, "output_hash": sha(F.col("user_id")), "prev_chain_hash": zeros}
    optional = {"model_id": F.when(n % 3 == 0, F.col("event_type")), "model_version": F.when(n % 5 == 0, F.concat(F.lit("1.0."), n % 7)), "record_id": F.when(n % 2 == 0, F.concat(F.lit("r"), n)), "score": F.col("value")}
    return e.select("event_id", C.provenance_digest(e, fields, optional).alias("digest"))


_ADMIT = """h AS (SELECT * FROM events WHERE event_id % 50 <> 7), tip AS (SELECT user_id % 4 AS lane, max(event_id) AS last FROM h GROUP BY ALL), n0 AS (SELECT event_id AS e, user_id % 4 AS lane, event_id + CASE WHEN event_id % 100 = 7 THEN 0 ELSE 10000000 END AS code FROM events WHERE event_id % 50 IN (0, 7)),
n AS (SELECT e, lane, CASE WHEN e % 400 = 200 THEN NULL WHEN e % 500 = 250 THEN code - 3000 ELSE code END AS seq, CASE WHEN e % 450 = 350 THEN e - 1 WHEN e % 300 = 0 THEN code - 50 ELSE code END AS record, CASE WHEN e % 450 = 400 THEN 'n' || (e - 1) WHEN e % 350 = 250 THEN 'n' || (code - 50) ELSE 'n' || code END AS nonce FROM n0),
o AS (SELECT n.*, row_number() OVER (ORDER BY e) AS k, record IN (SELECT event_id FROM h) AS old_record, nonce IN (SELECT 'n' || event_id FROM h) AS old_nonce, coalesce(last, 0) AS last FROM n LEFT JOIN tip USING (lane)),
walk AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS e, NULL::BIGINT AS lane, NULL::VARCHAR AS outcome, NULL::BIGINT AS assigned, NULL::BIGINT AS record, NULL::VARCHAR AS nonce, []::STRUCT(lane BIGINT, n BIGINT, record BIGINT, nonce VARCHAR)[] AS done
UNION ALL SELECT k, e, lane, outcome, assigned, record, nonce, CASE WHEN outcome = 'ADMITTED' THEN list_append(done, {'lane': lane, 'n': assigned, 'record': record, 'nonce': nonce}) ELSE done END FROM (SELECT *, CASE WHEN outcome = 'ADMITTED' THEN coalesce(seq, counter + 1) END AS assigned FROM (
SELECT *, CASE WHEN old_record OR list_contains(list_transform(done, lambda x: x.record), record) THEN 'REUSED_RECORD' WHEN old_nonce OR list_contains(list_transform(done, lambda x: x.nonce), nonce) THEN 'REUSED_NONCE' WHEN seq <= counter THEN 'ROLLBACK' ELSE 'ADMITTED' END AS outcome FROM (
SELECT o.*, w.done, greatest(o.last, coalesce(list_max(list_transform(list_filter(w.done, lambda x: x.lane = o.lane), lambda x: x.n)), 0)) AS counter FROM walk w JOIN o ON o.k = w.k + 1))))"""


def _admission(s, d):
    """Records of four chains: some reuse a record or a nonce of the history or of a new record, some have no number, some fall behind."""
    e = table(s, d, "events").select(F.col("event_id").alias("e"), (F.col("user_id") % 4).alias("lane"))
    at, code = F.col("e"), F.col("code")
    history = e.where("e % 50 <> 7").select("e", "lane", at.alias("seq"), at.alias("record"), F.concat(F.lit("n"), at).alias("nonce"))
    new = e.where("e % 50 in (0, 7)").withColumn("code", at + F.when(at % 100 == 7, 0).otherwise(10_000_000))
    seq = F.when(at % 400 == 200, None).when(at % 500 == 250, code - 3000).otherwise(code)
    record = F.when(at % 450 == 350, at - 1).when(at % 300 == 0, code - 50).otherwise(code)
    nonce = F.concat(F.lit("n"), F.when(at % 450 == 400, at - 1).when(at % 350 == 250, code - 50).otherwise(code))
    new = new.select("e", "lane", seq.alias("seq"), record.alias("record"), nonce.alias("nonce"))
    return history, C.admit(new, history, record="record", nonce="nonce", seq="seq", key="lane", order="e")


@query("c12_admit_records", f"WITH RECURSIVE {_ADMIT} SELECT e AS event_id, outcome, assigned FROM walk WHERE k > 0")
def c12(s, d):
    return _admission(s, d)[1].select(F.col("e").alias("event_id"), "outcome", "assigned")


@query("c12_appended_records", f"""WITH RECURSIVE {_ADMIT}, good AS (SELECT lane, assigned, nonce, row_number() OVER (PARTITION BY lane ORDER BY assigned) AS i FROM walk WHERE outcome = 'ADMITTED'), first AS (SELECT lane, sha256('tip' || last) AS tip FROM tip),
linked AS (SELECT g.lane, assigned, i, tip AS prev_hash, sha256(assigned || nonce || tip) AS current_hash FROM good g JOIN first USING (lane) WHERE i = 1 UNION ALL SELECT g.lane, g.assigned, g.i, c.current_hash, sha256(g.assigned || g.nonce || c.current_hash) FROM linked c JOIN good g ON g.lane = c.lane AND g.i = c.i + 1)
SELECT lane, assigned, prev_hash, current_hash FROM linked""")
def c12_appended(s, d):
    """Those admitted, linked to the tip of their chain in the order of their numbers."""
    history, judged = _admission(s, d)
    tips = history.withColumn("current_hash", F.sha2(F.concat(F.lit("tip"), "seq"), 256)).withColumnRenamed("lane", "key").select(F.col("key").alias("lane"), "seq", "current_hash")
    good = judged.where("outcome = 'ADMITTED'").select("lane", "assigned", "nonce")
    return C.append(tips, good, payload=("assigned", "nonce"), key="lane").select("lane", "assigned", "prev_hash", "current_hash")


_AUDIT = f"""{_B}, r0 AS (SELECT chain, seq AS link, seq + 1 AS seq, stamp, data_hash, CASE WHEN chain % 11 = 3 AND seq = 0 THEN sha256('foreign') WHEN chain % 7 = 2 AND seq = 9 THEN 'short' ELSE prev_hash END AS prev_hash, current_hash, CASE WHEN chain % 13 = 5 AND seq % 17 = 4 THEN sha256('other') ELSE data_hash END AS frame FROM chain_bad),
r AS (SELECT *, sha256(chain || ':' || link % 40) AS nonce, row_number() OVER w - 1 AS position, lag(seq) OVER w AS ps, lag(current_hash) OVER w AS ph FROM r0 WINDOW w AS (PARTITION BY chain ORDER BY seq)), x AS (SELECT *, seq > min(seq) OVER (PARTITION BY nonce) AS replayed FROM r),
found AS (SELECT chain, seq, position, 'DIGEST_MISMATCH' AS "check", 'CRITICAL' AS severity FROM x WHERE sha256(link || stamp || data_hash || prev_hash) <> current_hash UNION ALL SELECT chain, seq, position, 'REPLAY', 'CRITICAL' FROM x WHERE replayed
UNION ALL SELECT chain, seq, position, 'BAD_FORMAT', 'HIGH' FROM x WHERE length(prev_hash) <> 64 UNION ALL SELECT chain, seq, position, 'ALIAS_MISMATCH', 'CRITICAL' FROM x WHERE frame <> data_hash
UNION ALL SELECT chain, seq, position, 'SEQUENCE_GAP', 'HIGH' FROM x WHERE seq <> ps + 1 UNION ALL SELECT chain, seq, position, 'CHAIN_BREAK', 'CRITICAL' FROM x WHERE position > 0 AND prev_hash <> ph UNION ALL SELECT chain, seq, position, 'GENESIS_POINTER', 'CRITICAL' FROM x WHERE position = 0 AND seq = 1 AND prev_hash <> '{G}')"""


def _audited(s, d):
    """Provenance records numbered from 1; some begin with a foreign pointer, some have a short one, some name two inputs."""
    c, n = F.col("chain"), F.col("seq")
    prev = F.when((c % 11 == 3) & (n == 0), F.sha2(F.lit("foreign"), 256)).when((c % 7 == 2) & (n == 9), "short").otherwise(F.col("prev_hash"))
    rows = _bad(s, d).withColumn("prev_hash", prev).withColumns({"nonce": F.sha2(F.concat_ws(":", "chain", n % 40), 256), "record": F.concat_ws("_", "chain", "seq"), "frame": F.when((c % 13 == 5) & (n % 17 == 4), F.sha2(F.lit("other"), 256)).otherwise(F.col("data_hash"))})
    rows = rows.withColumns({"at": n, "seq": n + 1})
    ok = C.block_hash(F.col("at"), F.col("stamp"), F.col("data_hash"), F.col("prev_hash")) == F.col("current_hash")
    return rows, C.provenance_audit(rows, key="chain", seq="seq", record="record", nonce="nonce", digest="current_hash", expected=ok, aliases=[("data_hash", "frame")])


@query("c13_provenance_audit", f'WITH {_AUDIT} SELECT chain, seq, "check", severity FROM found')
def c13(s, d):
    return _audited(s, d)[1].select("chain", "seq", "check", "severity")


@query("c13_provenance_summary", f"""WITH {_AUDIT} SELECT chain, total_records, coalesce(findings, 0) AS findings, coalesce(replay_detected, false) AS replay_detected, broken_sequence, findings IS NULL AS is_valid FROM (SELECT chain, count(*) AS total_records FROM x GROUP BY chain) LEFT JOIN (SELECT chain, count(*) AS findings, bool_or("check" = 'REPLAY') AS replay_detected, min_by(seq, position) AS broken_sequence FROM found GROUP BY chain) USING (chain)""")
def c13_summary(s, d):
    rows, evidence = _audited(s, d)
    return C.provenance_summary(rows, evidence, key="chain", seq="seq")


_REPORT = """'{"assessment_id":"a' || o_orderkey || '","confidence_score":0.95,"coverage_ratio":' || (o_orderkey % 8) / 8 || ',"findings_summary":[{"count":' || o_orderkey % 3 || ',"source":"' || o_orderpriority || '"},{"count":null,"source":"DATA"}],"gatekeeper_action":"' || o_orderstatus || '","hard_veto_triggered":' || (o_orderkey % 2 = 0) || ',"overall_verdict":"' || o_orderstatus || '","risk_level":"' || o_orderpriority || '","risk_score":' || o_totalprice || ',"target_asset_id":"' || o_custkey || '","target_asset_type":"DATASET"}'"""


def _reports(s, d):
    o, n = table(s, d, "orders"), F.col("o_orderkey")
    finding = lambda source, count: F.struct(source.alias("source"), count.cast("long").alias("count"))
    return o.select("o_orderkey", F.col("o_custkey").cast("string").alias("target_asset_id"), F.lit("DATASET").alias("target_asset_type"), F.concat(F.lit("a"), n).alias("assessment_id"), F.col("o_orderstatus").alias("overall_verdict"), F.col("o_orderstatus").alias("gatekeeper_action"), F.col("o_totalprice").cast("double").alias("risk_score"), F.col("o_orderpriority").alias("risk_level"),
                    F.lit(0.95).alias("confidence_score"), (n % 8 / 8).alias("coverage_ratio"), (n % 2 == 0).alias("hard_veto_triggered"), F.array(finding(F.col("o_orderpriority"), n % 3), finding(F.lit("DATA"), F.lit(None))).alias("findings_summary"))


@query("c14_report_digest", f"SELECT o_orderkey, sha256({_REPORT}) AS digest FROM orders")
def c14_digest(s, d):
    reports = _reports(s, d)
    return reports.select("o_orderkey", C.report_digest(reports).alias("digest"))


@query("c14_report_seal", "SELECT o_orderkey, o_orderkey % 10 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 11 <> 0) AS valid FROM orders")
def c14(s, d):
    """Reports sealed over the present or the former fields; a changed verdict breaks both seals, a changed action only the present one."""
    reports, n = _reports(s, d), F.col("o_orderkey")
    sealed = reports.withColumn("report_digest", F.when(n % 7 == 0, C.report_digest(reports, C.LEGACY_REPORT_FIELDS)).otherwise(C.report_digest(reports)))
    changed = sealed.withColumns({"overall_verdict": F.when(n % 10 == 0, "X").otherwise(F.col("overall_verdict")), "gatekeeper_action": F.when(n % 11 == 0, "X").otherwise(F.col("gatekeeper_action"))})
    return C.verify_reports(changed).select("o_orderkey", F.col("digest_match").alias("valid"))
