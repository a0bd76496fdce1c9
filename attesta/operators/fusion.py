"""Evidence fusion: vetoes, correlated threats, graduated risk and verdicts, for all targets in one grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.tiers import MULTIPLIER, contains_any, lookup

# The sources, the weight of each, and the stems that rules look for.
REQUIRED = ("DATA_INTEGRITY", "MODEL_IDENTITY", "BEHAVIOURAL_FINGERPRINT", "INFERENCE_DNA", "DISTRIBUTION_SHIFT")
DRIFT = "DISTRIBUTION_SHIFT"
WEIGHT = {"CRYPTO_VERIFICATION": 0.35, "INFERENCE_DNA": 0.25, "MODEL_IDENTITY": 0.20, "BEHAVIOURAL_FINGERPRINT": 0.15, "DATA_INTEGRITY": 0.15, "CONTRIBUTOR_RISK": 0.10, "DISTRIBUTION_SHIFT": 0.10}
VETO_TYPES = ("WEIGHT_TAMPERING", "CRYPTO_TAMPERING", "BACKDOOR_POISONING")
VETO_STEMS = {
    "INFERENCE_DNA": (("replay", "tamper", "broken", "mismatch", "reuse", "break"), "PROVENANCE_BROKEN"),
    "MODEL_IDENTITY": (("mismatch", "substitution", "tamper", "unauthorized", "discrepancy", "modified", "mutation"), "MODEL_SUBSTITUTED"),
    "DATA_INTEGRITY": (("tamper", "mismatch", "backdoor", "trigger", "poison"), "DATA_POISONED"),
}
STEMS = {
    "backdoor": ("DATA_INTEGRITY", ("trigger", "backdoor", "poison")),
    "divergence": ("BEHAVIOURAL_FINGERPRINT", ("diverg", "quarantin", "cosine", "drift")),
    "dna": ("INFERENCE_DNA", ("tamper", "replay", "mismatch", "signature", "forger")),
    "identity": ("MODEL_IDENTITY", ("mismatch", "tamper", "unauthoriz", "hash")),
    "adversarial": ("DISTRIBUTION_SHIFT", ("adversarial", "anomaly", "entropy", "collapse", "severe", "shift", "drift")),
}
OPERATIONAL = ("operational", "environmental", "illumination", "sensor", "dusk")


def veto_reasons(evidence: DataFrame) -> Column:
    """Why a row alone decides, as an array: policy flag, then type (each ends the row's checks), then the rules by source."""
    said, kind = F.lower(F.coalesce("description", F.lit(""))), F.upper(F.coalesce("evidence_type", F.lit(""))) if "evidence_type" in evidence.columns else F.lit("")
    critical = F.col("severity") == "CRITICAL"
    rules = [F.when(((F.col("source") == "CRYPTO_VERIFICATION") | contains_any(said, ("signature", "forger"))) & critical, "SIGNATURE_INVALID")]
    rules += [F.when((F.col("source") == s) & critical & contains_any(said, stems), reason) for s, (stems, reason) in VETO_STEMS.items()]
    return F.when(F.col("hard_veto"), F.array(F.lit("POLICY"))).when(kind.isin(*VETO_TYPES) & critical, F.array(kind)).otherwise(F.filter(F.array(*rules), lambda r: r.isNotNull()))


#: What the rules say where they decide.
SAID = {
    "SIGNATURE_INVALID": "Invalid or forged cryptographic signature detected.",
    VETO_STEMS["INFERENCE_DNA"][1]: "Inference provenance chain broken or replay attack detected.",
    VETO_STEMS["MODEL_IDENTITY"][1]: "Model identity hash mismatch: unauthorized model substitution or weight modification detected.",
    VETO_STEMS["DATA_INTEGRITY"][1]: "Critical training data tampering or backdoor trigger pattern detected.",
}


def explain(evidence: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """keys, evidence_id, reason: a row for each reason of each piece of evidence that alone decides a verdict, in words."""
    rows = evidence.select(*keys, "evidence_id", "description", F.explode(veto_reasons(evidence)).alias("_why"))
    told = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.when(F.col("_why") == "POLICY", "Hard veto triggered via evidence policy.").otherwise(F.concat(F.lit("Critical security violation ("), "_why", F.lit(")."))))
    return rows.select(*keys, "evidence_id", F.coalesce(lookup(F.col("_why"), SAID), told).alias("reason"))


def rollup(findings: DataFrame, samples: DataFrame, models: DataFrame, drift: DataFrame) -> DataFrame:
    """A scan as evidence for :func:`fuse`: target, evidence_id, source, severity, metric, description, hard_veto.

    ``findings`` (target, finding_id, severity, metric, description); ``samples`` (target, n): a scan with samples and without
    findings is one LOW row; ``models`` (target, status, confidence): a MISMATCH is CRITICAL, else LOW; ``drift`` (target,
    severity, score, shift): a CRITICAL_SHIFT is CRITICAL, else MEDIUM. A metric of 0 or none counts as a half.
    """
    half = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 0.5).otherwise(F.col(c))
    row = lambda df, eid, source, severity, metric, said: df.select("target", eid.alias("evidence_id"), F.lit(source).alias("source"), severity.alias("severity"), metric.alias("metric"), said.alias("description"), F.lit(False).alias("hard_veto"))
    known = F.upper("severity")
    own = row(findings, F.concat(F.lit("integrity_"), "finding_id"), "DATA_INTEGRITY", F.when(known.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), known).otherwise("MEDIUM"), half("metric"), F.col("description"))
    clean = samples.where("n > 0").join(findings.select("target").distinct(), "target", "left_anti")
    clean = row(clean, F.concat(F.lit("integrity_clean_"), "target"), "DATA_INTEGRITY", F.lit("LOW"), F.lit(0.0), F.concat(F.lit("Training data integrity verified clean across "), "n", F.lit(" samples.")))
    model = row(models, F.concat(F.lit("model_"), "target"), "MODEL_IDENTITY", F.when(F.col("status") == "MISMATCH", "CRITICAL").otherwise("LOW"), half("confidence"), F.concat(F.lit("Model assurance: "), "status"))
    shift = row(drift, F.concat(F.lit("drift_"), "target"), "DISTRIBUTION_SHIFT", F.when(F.col("severity") == "CRITICAL_SHIFT", "CRITICAL").otherwise("MEDIUM"), F.coalesce("score", F.lit(0.5)), F.concat(F.lit("Distribution shift: "), "shift"))
    return own.unionByName(clean).unionByName(model).unionByName(shift)


def assurance_score(fused: DataFrame) -> DataFrame:
    """Adds ``assurance``: one less the risk, with four digits; null where nothing was covered."""
    return fused.withColumn("assurance", F.when(F.col("coverage") > 0, F.round(1 - F.col("risk"), 4)))


def _flags() -> dict[str, Column]:
    said, high = F.lower(F.coalesce("description", F.lit(""))), F.col("severity").isin("HIGH", "CRITICAL")
    out = {name: F.bool_or((F.col("source") == source) & high & contains_any(said, stems)) for name, (source, stems) in STEMS.items()}
    out["weights"] = F.bool_or((F.col("source") == "MODEL_IDENTITY") & high)
    out["operational"] = F.bool_or((F.col("source") == DRIFT) & contains_any(said, OPERATIONAL))
    return out


def threats() -> Column:
    """Names of correlated threats from the flags, composite ones first."""
    c = F.col
    composite = [
        (c("backdoor") & c("divergence"), "BACKDOOR_CAMPAIGN"),
        (c("dna") & c("identity"), "MODEL_SUBSTITUTION"),
        (c("adversarial") & c("divergence"), "COORDINATED_EVASION"),
        (c("adversarial") & c("weights"), "SHIFT_WITH_WEIGHT_DISCREPANCY"),
        (c("operational") & ~c("dna") & ~c("identity") & ~c("backdoor"), "BENIGN_DRIFT"),
        (c("dna") & ~c("identity"), "PROVENANCE_FAILURE"),
        (c("identity") & ~c("dna"), "MODEL_COMPROMISE"),
        (c("backdoor") & ~c("divergence"), "DATA_POISONING"),
    ]
    return F.filter(F.array(*[F.when(x, F.lit(n)) for x, n in composite]), lambda x: x.isNotNull())


def fuse(evidence: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """One verdict for each target from its evidence (evidence_id, source, severity, metric, description, hard_veto).

    Rows are reduced by target and source first and by target then, both with partial aggregation, so a target with very many
    rows does not meet in one task. Columns: risk, level, status, action, coverage, scope, confidence, veto, threats.
    """
    sev = F.col("severity")
    mult = lookup(sev, MULTIPLIER, 0.0)
    high = sev.isin("HIGH", "CRITICAL")
    rows = evidence.withColumn("_veto", F.size(veto_reasons(evidence)) > 0)
    metric = F.col("metric")
    per = rows.groupBy(*keys, "source").agg(
        F.count("*").alias("n"), F.max(mult).alias("mult"), F.count_if(high).alias("n_high"), F.max(F.when(high, mult)).alias("high_mult"),
        F.max(F.when(high, F.when(F.coalesce(metric, F.lit(0.0)) == 0, 0.5).otherwise(metric))).alias("metric_half"),
        F.max(F.when(high, F.coalesce(metric, F.lit(0.0)))).alias("metric_zero"),
        F.bool_or(sev == "CRITICAL").alias("critical"), F.bool_or(sev == "MEDIUM").alias("medium"), F.bool_or(sev != "LOW").alias("not_low"), F.bool_or("_veto").alias("veto"),
        *[x.alias(n) for n, x in _flags().items()],
    )
    drift = F.col("source") == DRIFT
    weight = lookup(F.col("source"), WEIGHT)
    boost = 1 + F.greatest(F.lit(0.0), F.col("metric_half") - 0.5) * 1.5
    impact = F.coalesce(weight, F.lit(0.10)) * F.col("high_mult") * (1 + 0.10 * F.least(F.col("n_high") - 1, F.lit(3))) * boost
    has_high = F.col("n_high") > 0
    g = per.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("sources"), F.sum(F.coalesce(weight, F.lit(0.0)) * F.col("mult")).alias("raw"), F.sum(F.when(has_high, impact)).alias("impact"),
        F.count_if(has_high).alias("high_sources"), F.count_if(has_high | F.col("medium")).alias("odd_sources"), F.bool_or("medium").alias("medium"),
        F.max(F.when(has_high, F.col("metric_zero"))).alias("top"), F.bool_or(has_high & drift).alias("high_drift"),
        F.bool_or(F.col("critical") & ~drift).alias("critical"), F.bool_or("veto").alias("veto"), F.bool_and(drift).alias("only_drift"), F.bool_or(drift).alias("has_drift"),
        F.bool_or(drift & F.col("not_low")).alias("odd_drift"), F.bool_or(F.col("source").isin("BEHAVIOURAL_FINGERPRINT", "MODEL_IDENTITY") & has_high).alias("behaviour"),
        *[F.bool_or(n).alias(n) for n in (*STEMS, "weights", "operational")],
    ).withColumn("threats", threats())
    raw, top, c = F.col("raw"), F.greatest, F.lit
    single = F.when(F.col("high_drift"), F.when(F.col("top") >= 0.70, top(raw, c(0.35))).otherwise(top(raw, F.least(c(0.25), F.col("impact"))))).otherwise(top(raw, c(0.50)))
    many = top(raw, top(c(0.50), F.least(c(0.85), 0.35 + F.col("impact"))))
    risk = (
        F.when(F.col("veto") | F.col("critical"), top(raw, c(0.90)))
        .when(F.col("high_sources") > 0, F.when((F.col("high_sources") >= 2) | (F.col("odd_sources") >= 2), many).otherwise(single))
        .when(F.col("medium"), top(raw, c(0.35)))
        .otherwise(raw)
    )
    g = g.withColumn("risk", risk)
    g = g.withColumn("risk", F.when(F.array_contains("threats", "BENIGN_DRIFT") & F.col("odd_drift"), top(F.col("risk"), c(0.30))).otherwise(F.col("risk")))
    g = g.withColumn("risk", F.when(F.col("only_drift") & ~F.col("veto"), F.least(F.col("risk"), c(0.65))).otherwise(F.col("risk")))
    g = g.withColumn("risk", F.when(F.col("has_drift") & F.col("behaviour"), top(F.col("risk"), c(0.85))).otherwise(F.col("risk")))
    g = g.withColumn("risk", F.round(top(c(0.0), F.least(c(1.0), F.col("risk"))), 4))
    cover = F.least(c(1.0), F.col("sources") / len(REQUIRED))
    block, review = F.col("veto") | (F.col("risk") >= 0.70), F.col("risk") >= 0.30
    return g.select(
        *keys, "risk",
        F.when(block, "CRITICAL").when(F.col("risk") >= 0.50, "HIGH").when(review, "MEDIUM").otherwise("LOW").alias("level"),
        F.when(block, "QUARANTINED").when(review, "UNDER_REVIEW").otherwise("ACCEPTED").alias("status"),
        F.when(block, "BLOCK").when(review, "REVIEW").otherwise("ALLOW").alias("action"),
        F.round(cover, 2).alias("coverage"), F.when(cover >= 0.75, "FULL").when(cover > 0.20, "PARTIAL").when(cover > 0, "MINIMAL").otherwise("INSUFFICIENT").alias("scope"),
        F.round(cover * (0.5 + 0.5 * F.least(F.col("n") / 5, c(1.0))), 4).alias("confidence"), "veto", "threats",
    )


def register(evidence: DataFrame, digest: Column) -> DataFrame:
    """Evidence with a digest where it has none; rows without an id are left out."""
    given = F.col("evidence_digest") if "evidence_digest" in evidence.columns else F.lit(None).cast("string")
    return evidence.where(F.trim(F.coalesce("evidence_id", F.lit(""))) != "").withColumn("evidence_digest", F.coalesce(given, digest))


def resolve(requests: DataFrame, stored: DataFrame, key: str = "evidence_id") -> tuple[DataFrame, DataFrame]:
    """Stored evidence that is asked for, and requests for what is not stored."""
    return stored.join(requests.select(key).distinct(), key, "left_semi"), requests.join(stored.select(key), key, "left_anti")


def binding_conflicts(evidence: DataFrame, target: str, subjects: Sequence[str]) -> DataFrame:
    """Targets whose evidence names more than one of any kind of subject."""
    counts = [F.count_distinct(s).alias(f"n_{s}") for s in subjects]
    g = evidence.groupBy(target).agg(*counts)
    cond = F.lit(False)
    for s in subjects:
        cond = cond | (F.col(f"n_{s}") > 1)
    return g.where(cond)


def quarantine_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """The present state of each record from its appended events (is_active and the rest of the last one)."""
    cols = [c for c in events.columns if c not in (key, order)]
    last = events.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("s"))
    return last.select(key, *[F.col(f"s.{c}").alias(c) for c in cols])
