"""Hash chains, ledgers and provenance records: built by an ordered fold per chain, verified row by row in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.canonical import canonical_around, canonical_sha256
from attesta.functions.hashing import HEX64
from attesta.plans.lineage import cut, shuffle_partitions
from attesta.plans.prefix import dealt, scanned

GENESIS = "0" * 64


def block_hash(seq: Column, stamp: Column, data_hash: Column, prev: Column) -> Column:
    return F.sha2(F.concat(seq.cast("string"), stamp, data_hash, prev), 256)


def _envelope(payload: Sequence[str], envelope: tuple[Column, Column] | None) -> tuple[Column, Column]:
    """The texts before and after the previous hash: the payload's columns and nothing, or those given."""
    return envelope or (F.concat(*[F.col(c).cast("string") for c in payload]), F.lit(""))


def build(links: DataFrame, *, key: str = "chain", seq: str = "seq", payload: Sequence[str] = ("seq", "stamp", "data_hash"), envelope: tuple[Column, Column] | None = None, start: str | None = None) -> DataFrame:
    """Adds prev_hash and current_hash: the digest of the payload columns as text and the hash before, from 64 zeros on, or from
    what column ``start`` holds in a chain's first row. ``envelope`` gives other texts around the hash before.

    Chains are dealt by key and sorted on disk where they do not fit; a chain streams through its task and is never held. They are dealt by
    a hash of the key, not by the key: after a join by key, Spark would take the join's own order of partitions for enough, and adaptive
    execution may then read the join's sides where they lie, so that a chain comes to many tasks.
    """
    n = shuffle_partitions(links.sparkSession)
    head, tail = _envelope(payload, envelope)
    more = {"_start": F.coalesce(F.col(start), F.lit(GENESIS))} if start else {}
    rows = links.withColumns({"_head": head, "_tail": tail} | more).repartition(n, F.xxhash64(key)).sortWithinPartitions(key, seq)
    names = links.columns
    at = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prev = object(), GENESIS
        for batch in batches:
            before, after = [], []
            begins = batch.column("_start").to_pylist() if start else [GENESIS] * batch.num_rows
            for k, head, tail, begin in zip(*(batch.column(c).to_pylist() for c in (at, len(names), len(names) + 1)), begins, strict=True):
                if k != now:
                    now, prev = k, begin
                before.append(prev)
                prev = hashlib.sha256((head + prev + tail).encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(before, pa.string()), pa.array(after, pa.string())], [*names, "prev_hash", "current_hash"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema.fields)
    return rows.mapInArrow(run, f"{kept}, prev_hash string, current_hash string")


def checks(chained: DataFrame, *, key: str = "chain", seq: str = "seq", payload: Sequence[str] = ("seq", "stamp", "data_hash"), envelope: tuple[Column, Column] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds position, expected_prev, prev_seq and reason: what is wrong with a block (SEQUENCE, POINTER, HASH), or null.

    Blocks are dealt by ranges of key and number, and the last block of a range is carried over to the next, so one chain may be
    verified by many tasks. A block whose hash is its data hash is accepted, as a sealed root. Blocks of one number are taken in
    the order of their hashes. A block's own hash is checked where the block lies; then, beside key, number and the two hashes, only the
    columns of ``keep`` are moved and returned (all, where it is None).
    """
    order = [seq, "current_hash"]
    head, tail = _envelope(payload, envelope)
    hashed = F.sha2(F.concat(head, F.col("prev_hash"), tail), 256) == F.col("current_hash")
    if "data_hash" in chained.columns:
        hashed = hashed | (F.col("current_hash") == F.col("data_hash"))
    kept = [c for c in chained.columns if keep is None or c in {key, seq, "prev_hash", "current_hash", *keep}]
    # Ranges are found in a sample, for which all before them is run: written first, chains are not built twice.
    rows = cut(chained.select(*kept, hashed.alias("_hashed")))
    parts = dealt(rows.withColumn("_one", F.lit(1).cast("long")), [key], order)
    out = scanned(parts, [key], order, sums={"position": "_one"}, lags={"expected_prev": "current_hash", "prev_seq": seq}).drop("_one", "_part")
    out = out.withColumns({"position": F.col("position") - 1, "expected_prev": F.coalesce("expected_prev", F.lit(GENESIS))})
    reason = F.when(F.col(seq) != F.col("position"), "SEQUENCE").when(F.col("prev_hash") != F.col("expected_prev"), "POINTER").when(~F.col("_hashed"), "HASH")
    return out.withColumn("reason", reason).drop("_hashed")


def verdicts(checked: DataFrame, key: str = "chain") -> DataFrame:
    """One row a chain: blocks, verified (before the first failure), first_bad, reason and head."""
    bad = F.col("reason").isNotNull()
    g = checked.groupBy(key).agg(F.count("*").alias("blocks"), F.min(F.when(bad, F.struct("position", "reason"))).alias("f"), F.max(F.struct("position", "current_hash")).alias("h"))
    return g.select(key, "blocks", F.coalesce("f.position", "blocks").alias("verified"), F.col("f.position").alias("first_bad"), F.col("f.reason").alias("reason"), F.col("h.current_hash").alias("head"))


def ledger_verdicts(checked: DataFrame, *, signed: str, fingerprint: str, current: str, key: str = "chain", seq: str = "seq") -> DataFrame:
    """One row a ledger: valid, events_checked and last_verified before the first failure, first_invalid, reason and likely_cause.

    ``signed`` says whether a signature holds (null: there is none). One that fails points to a change of keys unless it was made
    with the ``current`` key; all other failures point to tampering.
    """
    reason = F.coalesce("reason", F.when(~F.coalesce(signed, F.lit(True)), "SIGNATURE"))
    rotated = (reason == "SIGNATURE") & (F.coalesce(F.col(fingerprint), F.lit("")) != current)
    fail = F.when(reason.isNotNull(), F.struct("position", F.col(seq).alias("at"), reason.alias("reason"), F.when(rotated, "KEY_ROTATION").otherwise("TAMPER").alias("cause")))
    g = checked.groupBy(key).agg(F.count("*").alias("n"), F.max(seq).alias("last"), F.min(fail).alias("f"))
    return g.select(key, F.col("f").isNull().alias("valid"), F.coalesce("f.position", "n").alias("events_checked"), F.coalesce(F.col("f.position") - 1, "last").alias("last_verified"), F.col("f.at").alias("first_invalid"), F.col("f.reason").alias("reason"), F.col("f.cause").alias("likely_cause"))


def extend(chained: DataFrame, rows: DataFrame, *, order: str, payload: Sequence[str] = (), envelope: tuple[Column, Column] | None = None, key: str = "chain", seq: str = "seq") -> DataFrame:
    """New links for chains that exist: numbered on from each chain's last one in ``order`` (unique in a chain), and linked to its tip."""
    tips = chained.groupBy(key).agg(F.max(seq).alias("_last"), F.max_by("current_hash", seq).alias("_tip"))
    numbered = scanned(dealt(rows.withColumn("_one", F.lit(1).cast("long")), [key], [order]), [key], [order], sums={"_k": "_one"})
    new = numbered.drop("_one", "_part").join(tips, key, "left").withColumn(seq, (F.coalesce("_last", F.lit(-1)) + F.col("_k")).cast("long"))
    return build(new.drop("_k", "_last"), key=key, seq=seq, payload=payload, envelope=envelope, start="_tip").drop("_tip")


def state(chained: DataFrame, key: str = "chain", seq: str = "seq") -> DataFrame:
    return chained.groupBy(key).agg(F.count("*").alias("records"), F.max_by("current_hash", seq).alias("tip"))


#: The fields that a ledger event's hash covers, beside the hash before.
LEDGER_FIELDS = ("actor", "entity_id", "event_type", "payload_hash", "scan_id", "sequence", "timestamp")


def ledger_envelope(rows: DataFrame, sequence: str = "seq") -> tuple[Column, Column]:
    """The canonical text of a ledger event around its previous hash; ``rows`` has the other fields of :data:`LEDGER_FIELDS`."""
    fields = {f: F.col(sequence if f == "sequence" else f) for f in LEDGER_FIELDS}
    return canonical_around(rows, fields, "previous_hash")


def decisions(requests: DataFrame, decision: str = "decision") -> DataFrame:
    """Analyst decisions that may be appended."""
    return requests.where(F.col(decision).isin("ACCEPT", "REVIEW", "QUARANTINE"))


def replays(records: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """Adds ``replayed``: any of ``keys`` was seen earlier in ``order``.

    First sights are aggregated, so a key with very many records does not meet in one task; ties of ``order`` are not replays.
    """
    out = records
    for k in keys:
        first = records.groupBy(k).agg(F.min(order).alias(f"_first_{k}"))
        out = out.join(first, k)
    flag = None
    for k in keys:
        one = F.col(order) > F.col(f"_first_{k}")
        flag = one if flag is None else flag | one
    return out.withColumn("replayed", flag).select(*records.columns, "replayed")


def recent_duplicates(frames: DataFrame, key: str, order: Sequence[str], value: str, last: int = 5) -> DataFrame:
    """Adds ``recent``: the value is among the ``last`` of its key before it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-last, -1)
    return frames.withColumn("recent", F.array_contains(F.collect_list(value).over(w), F.col(value)))


def provenance_digest(rows: DataFrame, fields: dict[str, Column], optional: dict[str, Column]) -> Column:
    """Digest of a provenance record's canonical text: all of ``fields``, and those of ``optional`` that are not null."""
    return canonical_sha256(rows, fields | optional, drop_null=set(optional))


def admit(new: DataFrame, history: DataFrame, *, record: str, nonce: str, seq: str, key: str, order: str) -> DataFrame:
    """``new`` with ``outcome`` (ADMITTED, REUSED_RECORD, REUSED_NONCE or ROLLBACK, tested in this order) and ``assigned``, the
    sequence number of those admitted.

    Records count as given in ``order`` (unique). One is turned away if an admitted record before it, of the history or new, has its
    record id or its nonce, or if its number isn't above the chain's counter; one without a number gets the counter's next. The
    counter starts at the history's last number (0 without history) and moves with admitted records only.

    The counter at a row is its chain's number of unnumbered rows so far plus the maximum, over numbered rows before, of number less
    unnumbered rows until there: a running sum and a running maximum over ranges, so a chain may spread over many tasks. Whether a
    record is reused and whether it is rolled back can hinge on each other; rounds repeat until nothing changes, as many as the
    longest row of records that hinge one on the other, whatever the number of records.
    """
    tips = history.groupBy(key).agg(F.max(seq).alias("_last"))
    known = new.join(history.select(F.col(record), F.lit(True).alias("_r")).distinct(), record, "left")
    known = known.join(history.select(F.col(nonce), F.lit(True).alias("_n")).distinct(), nonce, "left").join(tips, key, "left")
    past = F.when(F.col("_r"), "REUSED_RECORD").when(F.col("_n"), "REUSED_NONCE").otherwise("ADMITTED")
    rows = known.withColumns({"outcome": past, "_last": F.coalesce("_last", F.lit(0)).cast("long")})
    now = dealt(rows.select(*new.columns, "_last", "_r", "_n", "outcome"), [key], [order])
    while True:
        good = now.where("outcome = 'ADMITTED'")
        met = now
        for name, by in (("_fr", record), ("_fn", nonce)):
            met = met.join(good.groupBy(by).agg(F.min(order).alias(name)), by, "left")
        reused = F.when(F.col("_r") | (F.col("_fr") < F.col(order)), "REUSED_RECORD").when(F.col("_n") | (F.col("_fn") < F.col(order)), "REUSED_NONCE")
        met = met.withColumn("_reused", reused).withColumn("_blank", (F.col("_reused").isNull() & F.col(seq).isNull()).cast("long"))
        met = scanned(met, [key], [order], sums={"_blanks": "_blank"})
        met = met.withColumn("_level", F.when(F.col("_reused").isNull(), F.col(seq) - F.col("_blanks")))
        met = scanned(met, [key], [order], maxima_before={"_top": "_level"})
        counter = F.col("_blanks") + F.greatest("_last", "_top")
        found = F.coalesce("_reused", F.when(F.col(seq) <= counter, "ROLLBACK"), F.lit("ADMITTED"))
        assigned = F.when(found == "ADMITTED", F.coalesce(F.col(seq), counter)).cast("long")
        after = cut(met.select(*now.columns[: len(new.columns) + 3], "_part", found.alias("outcome"), assigned.alias("assigned"), (found != F.col("outcome")).alias("_changed")))
        if after.where("_changed").isEmpty():
            return after.select(*new.columns, "outcome", "assigned")
        now = after.drop("_changed", "assigned")


def append(chained: DataFrame, admitted: DataFrame, *, payload: Sequence[str], key: str, seq: str = "assigned") -> DataFrame:
    """Admitted records as links after the tips of ``chained`` (key, seq, current_hash), in the order of their numbers."""
    tips = chained.groupBy(key).agg(F.max_by("current_hash", "seq").alias("_tip"))
    return build(admitted.join(tips, key, "left"), key=key, seq=seq, payload=payload, start="_tip").drop("_tip")


def _later(rows: DataFrame, order: str, by: str) -> DataFrame:
    """The rows that come later in ``order`` than the first of equal ``by``; only what repeats is met again."""
    first = rows.groupBy(by).agg(F.min(order).alias("_first"), F.max(order).alias("_end")).where("_first < _end").drop("_end")
    return rows.select("_id", order, by).join(first, by).where(F.col(order) > F.col("_first"))


def provenance_audit(records: DataFrame, *, key: str, seq: str, record: str, nonce: str, digest: str, expected: Column, aliases: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Typed evidence rows about provenance records: key, seq, position (from 0, in order of seq), check, severity.

    ``aliases`` name columns that should agree where both are given. The first record of a chain must point to zeros if its number is 1;
    every other must point to the digest of the one before and be numbered one higher. Records are dealt by ranges, so one chain
    may be audited by many tasks; nonces and record ids count over all chains. Records are written once, with no more than the checks
    ask for, and replays are found by numbers of rows.
    """
    order = [seq, digest]
    odd = F.lit(False)
    for a, b in aliases:
        odd = odd | F.coalesce((F.col(a).cast("string") != "") & (F.col(b).cast("string") != "") & (F.col(a) != F.col(b)), F.lit(False))
    brief = lambda c: F.unhex(F.sha2(F.col(c).cast("string"), 256))
    base = cut(records.select(key, seq, digest, brief("prev_hash").alias("_to"), (~F.col("prev_hash").rlike(HEX64)).alias("_odd_form"), (F.col("prev_hash") != GENESIS).alias("_linked"), expected.alias("_ok"), odd.alias("_odd"), brief(nonce).alias("_nonce"), brief(record).alias("_record"), F.monotonically_increasing_id().alias("_id")))
    late = [again.select("_id") for again in (_later(base, seq, k) for k in ("_nonce", "_record"))]
    seen = base.drop("_nonce", "_record").join(late[0].union(late[1]).distinct().withColumn("_late", F.lit(True)), "_id", "left")
    seen = seen.select(key, *order, "_to", "_odd_form", "_linked", "_ok", "_odd", F.col("_late").isNotNull().alias("replayed"), F.lit(1).cast("long").alias("_one"))
    seen = scanned(dealt(seen, [key], order), [key], order, sums={"position": "_one"}, lags={"_seq": seq, "_prev": digest}).withColumn("position", F.col("position") - 1)
    first = F.col("position") == 0
    kinds = [
        ("DIGEST_MISMATCH", ~F.col("_ok"), "CRITICAL"),
        ("BAD_FORMAT", F.col("_odd_form"), "HIGH"),
        ("ALIAS_MISMATCH", F.col("_odd"), "CRITICAL"),
        ("REPLAY", F.col("replayed"), "CRITICAL"),
        ("SEQUENCE_GAP", ~first & (F.col(seq) != F.col("_seq") + 1), "HIGH"),
        ("CHAIN_BREAK", ~first & (F.col("_to") != brief("_prev")), "CRITICAL"),
        ("GENESIS_POINTER", first & (F.col(seq) == 1) & F.col("_linked"), "CRITICAL"),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("check"), F.lit(v).alias("severity"))) for k, c, v in kinds]), lambda x: x.isNotNull())
    return seen.select(key, seq, "position", F.inline(found))


def provenance_summary(records: DataFrame, evidence: DataFrame, *, key: str, seq: str) -> DataFrame:
    """One row a chain: total_records, findings, replay_detected, broken_sequence (the number of the first record with a finding)
    and is_valid."""
    g = evidence.groupBy(key).agg(F.count("*").alias("findings"), F.bool_or(F.col("check") == "REPLAY").alias("replay_detected"), F.min_by(seq, "position").alias("broken_sequence"))
    total = records.groupBy(key).agg(F.count("*").alias("total_records")).join(g, key, "left")
    return total.select(key, "total_records", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("replay_detected", F.lit(False)).alias("replay_detected"), "broken_sequence", F.col("findings").isNull().alias("is_valid"))


#: The fields that a report's digest covers, and those that it covered before.
REPORT_FIELDS = ("target_asset_id", "target_asset_type", "assessment_id", "overall_verdict", "gatekeeper_action", "risk_score", "risk_level", "confidence_score", "coverage_ratio", "hard_veto_triggered", "findings_summary")
LEGACY_REPORT_FIELDS = ("target_asset_id", "target_asset_type", "assessment_id", "overall_verdict", "risk_score", "confidence_score", "coverage_ratio", "findings_summary")


def report_digest(reports: DataFrame, fields: Sequence[str] = REPORT_FIELDS) -> Column:
    return canonical_sha256(reports, {f: F.col(f) for f in fields})


def verify_reports(reports: DataFrame, digest: str = "report_digest") -> DataFrame:
    """Adds ``digest_match``: the digest is that of the present fields or that of the former ones."""
    return reports.withColumn("digest_match", (F.col(digest) == report_digest(reports)) | (F.col(digest) == report_digest(reports, LEGACY_REPORT_FIELDS)))
