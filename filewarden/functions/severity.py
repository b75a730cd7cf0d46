"""Severity order, score bands, triage priority and status rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity_rank(severity: Column) -> Column:
    """low 1 < medium 2 < high 3 < critical 4; anything else 0."""
    return (
        F.when(severity == "critical", 4)
        .when(severity == "high", 3)
        .when(severity == "medium", 2)
        .when(severity == "low", 1)
        .otherwise(0)
    )


def entropy_band(entropy: Column) -> Column:
    return (
        F.when(entropy < 4.0, "structured")
        .when(entropy < 6.0, "normal")
        .when(entropy < 7.0, "monitor")
        .when(entropy <= 7.5, "warning")
        .otherwise("alert")
    )


def obfuscation_band(score: Column) -> Column:
    return F.when(score < 0.3, "none").when(score < 0.5, "low").when(score <= 0.7, "medium").otherwise("alert")


def triage_priority(severity: Column, confidence: Column) -> Column:
    """1 (act at once) to 7 (log only); NULL for an unknown severity."""
    return (
        F.when(severity == "critical", F.when(confidence > 0.8, 1).otherwise(2))
        .when(severity == "high", F.when(confidence > 0.8, 3).otherwise(4))
        .when(severity == "medium", F.when(confidence > 0.7, 5).otherwise(6))
        .when(severity == "low", 7)
    )


def site_status(critical: Column, high: Column) -> Column:
    return F.when(critical > 0, "critical").when(high > 0, "warning").otherwise("safe")


def scan_audit_severity(threats_found: Column) -> Column:
    return F.when(threats_found > 0, "warning").otherwise("info")


def threat_audit_severity(threat_severity: Column) -> Column:
    return F.when(threat_severity.isin("critical", "high"), "critical").otherwise("warning")


def confidence_percent(confidence: Column) -> Column:
    return F.round(confidence * 100).cast("int")


def stored_confidence(confidence: Column) -> Column:
    """Confidence as it is stored: six decimals on the wire, then DECIMAL(3,2), half up."""
    return confidence.cast("decimal(9,6)").cast("decimal(3,2)")


def number_text(value: Column) -> Column:
    """A rounded score as text without a trailing `.0`."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
