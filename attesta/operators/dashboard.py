"""Roll-ups for people who look on: the system, an entity, a report's sections, a detector's score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.tiers import RANK, lookup
from attesta.operators.chain import GENESIS

# Verdicts, and the names of a report's sections by source.
VERDICTS = {"quarantined": "QUARANTINED", "under_review": "UNDER_REVIEW", "accepted": "ACCEPTED"}
SECTION_NAMES = {
    "DATA_INTEGRITY": "Dataset & Training Data Integrity",
    "MODEL_IDENTITY": "Model Identity & Weight Integrity",
    "BEHAVIOURAL_FINGERPRINT": "Behavioral Fingerprint & Probes",
    "INFERENCE_DNA": "Runtime Inference DNA & Nonce Integrity",
    "DISTRIBUTION_SHIFT": "Distribution Shift & Drift Analysis",
    "CRYPTO_VERIFICATION": "Cryptographic Verification & Signing",
    "CONTRIBUTOR_RISK": "Contributor Risk & Accountability",
}


def _rank(severity: str) -> Column:
    return lookup(F.upper(F.col(severity)), RANK, 0)


def system_overview(inventory: dict[str, DataFrame], reports: DataFrame, findings: DataFrame, chain: DataFrame, *, verdict: str = "overall_verdict", severity: str = "severity", seq: str = "seq") -> DataFrame:
    """One row: how many of each of ``inventory``, reports by verdict, active_threats (grave findings), head of the chain and status.

    Critical findings stand in for quarantined assets where no report is. No chain has 64 zeros as its head.
    """
    counts = [rows.agg(F.count("*").alias(name)) for name, rows in inventory.items()]
    counts.append(reports.agg(F.count("*").alias("reports"), *[F.count_if(F.col(verdict) == v).alias(name) for name, v in VERDICTS.items()]))
    level = F.upper(F.col(severity))
    counts.append(findings.agg(F.count_if(level.isin("CRITICAL", "HIGH")).alias("active_threats"), F.count_if(level == "CRITICAL").alias("_critical")))
    counts.append(chain.agg(F.coalesce(F.max_by("current_hash", seq), F.lit(GENESIS)).alias("chain_head")))
    row = reduce(DataFrame.join, counts).withColumn("quarantined", F.when(F.col("quarantined") == 0, F.col("_critical")).otherwise(F.col("quarantined")))
    status = F.when(F.col("quarantined") > 0, "CRITICAL_ALERT").when((F.col("under_review") > 0) | (F.col("active_threats") > 0), "ELEVATED_RISK").otherwise("OPERATIONAL")
    return row.withColumn("status", status).drop("_critical")


def investigations(entities: DataFrame, findings: DataFrame, reports: DataFrame, *, key: str = "id", target: str = "target_asset_id", severity: str = "severity", order: str = "created_at", report: str = "report_id") -> DataFrame:
    """key, status, risk, n_findings, worst (severity), latest_report: what is known of each entity, from findings (key, severity) that its
    lineage carries and reports about it."""
    g = findings.groupBy(key).agg(F.max(_rank(severity)).alias("_rank"), F.count("*").alias("n_findings"))
    last = reports.groupBy(F.col(target).alias(key)).agg(F.max_by(report, F.struct(order, report)).alias("latest_report"))
    j = entities.select(key).join(g, key, "left").join(last, key, "left")
    rank = F.coalesce("_rank", F.lit(0))
    status = lookup(rank, {4: "QUARANTINED", 3: "UNDER_REVIEW", 2: "UNDER_REVIEW"}, "ACCEPTED")
    risk = F.when(rank == 4, 0.85).when(rank == 3, 0.5).when(rank == 2, 0.35).otherwise(0.0)
    worst = lookup(rank, {v: k for k, v in RANK.items()}, None)
    return j.select(key, status.alias("status"), risk.alias("risk"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"), worst.alias("worst"), "latest_report")


def sections(evidence: DataFrame, checked: DataFrame, risk: DataFrame, *, key: str = "target", source: str = "source", severity: str = "severity") -> DataFrame:
    """key, source, layer_name, n, status, risk_contribution: a row for each source that was checked for each key (``checked``: key,
    source), whether there is evidence or not.

    ``risk`` (key, risk) is the key's own, at most 1. Sources without a fixed name are written as words.
    """
    g = evidence.groupBy(key, source).agg(F.count("*").alias("n"), F.max(_rank(severity)).alias("_rank"))
    j = checked.select(key, source).distinct().join(g, [key, source], "left").join(risk, key, "left")
    plain = F.initcap(F.lower(F.replace(F.col(source), F.lit("_"), F.lit(" "))))
    name = F.coalesce(lookup(F.col(source), SECTION_NAMES, None), plain)
    status = lookup(F.coalesce("_rank", F.lit(0)), {4: "QUARANTINED", 3: "UNDER_REVIEW", 2: "UNDER_REVIEW"}, "ACCEPTED")
    return j.select(key, source, name.alias("layer_name"), F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), F.least(F.coalesce("risk", F.lit(0.0)), F.lit(1.0)).alias("risk_contribution"))


def scorecard(outcomes: DataFrame, *, category: str, expected: str, actual: str) -> DataFrame:
    """category (ALL: all of them), total, detected, missed, false_positives, reviewed, blocked, accuracy.

    ``expected`` says whether something is there to find; ``actual`` is the verdict: BLOCK and REVIEW both detect, ALLOW doesn't.
    """
    found = F.col(actual).isin("BLOCK", "REVIEW")
    g = outcomes.rollup(category).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(expected) & found).alias("detected"),
        F.count_if(F.col(expected) & ~found).alias("missed"),
        F.count_if(~F.col(expected) & found).alias("false_positives"),
        F.count_if(F.col(actual) == "REVIEW").alias("reviewed"),
        F.count_if(F.col(actual) == "BLOCK").alias("blocked"),
        F.round(F.count_if(F.col(expected) == found) / F.count("*"), 4).alias("accuracy"),
        F.grouping(category).alias("_all"),
    )
    return g.withColumn(category, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(category))).drop("_all").withColumnRenamed(category, "category")
