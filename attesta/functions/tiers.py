"""Mapping of scores and raw labels to tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_NAMES = ("unknown", "anonymous", "none", "null")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
PENALTY = {"CRITICAL": 0.30, "HIGH": 0.15, "MEDIUM": 0.05, "LOW": 0.02}
MULTIPLIER = {"CRITICAL": 1.0, "HIGH": 0.75, "MEDIUM": 0.40, "LOW": 0.15}
RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def tier(score: Column, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first cut that the score reaches."""
    out = None
    for at, name in cuts:
        out = F.when(score >= at, name) if out is None else out.when(score >= at, name)
    return out.otherwise(otherwise)


def lookup(key: Column, values: dict[str, object], otherwise: object = None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def clean_identity(name: Column) -> Column:
    """Trimmed; UNKNOWN for null, empty and placeholder names."""
    bare = F.trim(name)
    return F.when(bare.isNull() | (bare == "") | F.lower(bare).isin(*UNKNOWN_NAMES), "UNKNOWN").otherwise(bare)


def contains_any(text: Column, stems: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in stems:
        out = out | text.contains(s)
    return out


#: Words of a raw status, tried in this order.
STATUS_WORDS = {
    "critical": ("QUARANTINED", "REJECTED", "TAMPERED", "FAILED", "REVOKED", "POISONED", "MISMATCH", "CRITICAL", "HIGH", "HARD_VETO", "VETO"),
    "warning": ("UNDER_REVIEW", "REVIEW", "DRIFT", "WARNING", "MEDIUM", "FLAGGED"),
    "normal": ("ACCEPTED", "VERIFIED", "PASS", "SEALED", "AUTHENTICATED", "CLEAN", "LOW", "INFO", "NORMAL"),
}


def normal_status(raw: Column) -> Column:
    up = F.upper(F.trim(raw))
    out = F.when(up.isNull() | (up == "") | (up == "UNKNOWN"), "unknown")
    for name, words in STATUS_WORDS.items():
        out = out.when(contains_any(up, words), name)
    return out.otherwise("unknown")


def edge_category(source: Column, target: Column) -> Column:
    return (
        F.when((source == "critical") & (target != "critical"), "interrupted")
        .when((source == "critical") | (target == "critical"), "critical")
        .when((source == "warning") | (target == "warning"), "warning")
        .otherwise("normal")
    )
