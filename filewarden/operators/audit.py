"""The audit log: event builders, filters, pages, statistics and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.functions.severity import scan_audit_severity, threat_audit_severity
from filewarden.functions.text import sanitize_text
from filewarden.operators.results import as_timestamp, days_before
from filewarden.schema import AUDIT_LOG

# Audit defaults.
AUDIT_LIMIT = 100
AUDIT_KEEP_DAYS = 90
TOP_EVENT_TYPES = 10


def audit_events(
    rows: DataFrame,
    event_type: Column,
    description: Column,
    severity: Column,
    metadata: Column | None,
    created_at: Column,
    user_id: Column | None = None,
    user_ip: Column | None = None,
) -> DataFrame:
    """One audit row per input row. The id is a digest of the row, stable under recomputation."""
    none = F.lit(None)
    row = rows.select(
        sanitize_text(event_type).alias("event_type"),
        sanitize_text(description).alias("description"),
        severity.alias("severity"),
        (none if user_id is None else user_id).cast("bigint").alias("user_id"),
        (none if user_ip is None else user_ip).cast("string").alias("user_ip"),
        (none if metadata is None else F.to_json(metadata)).cast("string").alias("metadata"),
        created_at.cast("timestamp").alias("created_at"),
    )
    digest = F.sha2(F.to_json(F.struct(*row.columns)), 256)
    return row.select(digest.alias("id"), *row.columns).select(AUDIT_LOG.fieldNames())


# Fixed values in the builders below: event types, description formats, metadata keys.


def scan_started(scans: DataFrame, at: Column) -> DataFrame:
    """From `scans(scan_id, scan_type)`."""
    return audit_events(
        scans,
        F.lit("scan_started"),
        F.format_string("Security scan started (ID: %s)", "scan_id"),
        F.lit("info"),
        F.struct("scan_id", "scan_type"),
        at,
    )


def scan_completed(outcomes: DataFrame, at: Column) -> DataFrame:
    """From `outcomes(scan_id, scanned_files, threats_found)`."""
    return audit_events(
        outcomes,
        F.lit("scan_completed"),
        F.format_string("Security scan completed (ID: %s)", "scan_id"),
        scan_audit_severity(F.col("threats_found")),
        F.struct("scan_id", F.col("scanned_files").alias("files_scanned"), "threats_found"),
        at,
    )


def threat_detected(results: DataFrame) -> DataFrame:
    """From `scan_results` rows."""
    return audit_events(
        results,
        F.lit("threat_detected"),
        F.format_string("Threat detected: %s in %s", "threat_type", "file_path"),
        threat_audit_severity(F.col("threat_severity")),
        F.struct("file_path", "threat_type", "threat_severity"),
        F.col("detected_at"),
    )


def file_quarantined(quarantine: DataFrame) -> DataFrame:
    """From new `quarantine` rows."""
    return audit_events(
        quarantine,
        F.lit("file_quarantined"),
        F.format_string("File quarantined: %s", "file_path"),
        F.lit("warning"),
        F.struct("file_path", F.col("quarantine_reason").alias("reason")),
        F.col("quarantined_at"),
    )


def file_restored(restored: DataFrame) -> DataFrame:
    """From `restored(file_path, restored_at)`."""
    return audit_events(
        restored,
        F.lit("file_restored"),
        F.format_string("File restored from quarantine: %s", "file_path"),
        F.lit("info"),
        F.struct("file_path"),
        F.col("restored_at"),
    )


def settings_changed(changes: DataFrame, at: Column) -> DataFrame:
    """From `changes(settings MAP)`; only the names of the changed fields are kept."""
    return audit_events(
        changes,
        F.lit("settings_changed"),
        F.lit("Security scanner settings updated"),
        F.lit("info"),
        F.struct(F.map_keys("settings").alias("changed_fields")),
        at,
    )


def api_key_changed(changes: DataFrame, at: Column) -> DataFrame:
    """From `changes(api_name, was_added)`."""
    action = F.when(F.col("was_added"), "configured").otherwise("removed")
    return audit_events(
        changes,
        F.lit("api_key_changed"),
        F.format_string("%s API key %s", "api_name", action),
        F.lit("info"),
        F.struct("api_name", action.alias("action")),
        at,
    )


def rate_limit_exceeded(rejected: DataFrame) -> DataFrame:
    """From rejected calls `(api, ts)`."""
    return audit_events(
        rejected,
        F.lit("rate_limit_exceeded"),
        F.format_string("Rate limit exceeded for %s API", "api"),
        F.lit("warning"),
        None,
        F.col("ts"),
    )


def filter_audit(
    log: DataFrame,
    event_type: str | None = None,
    severity: str | None = None,
    user_id: int | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
) -> DataFrame:
    """Keep the rows that match every given value; both dates are inclusive."""
    if event_type:
        log = log.filter(F.col("event_type") == event_type)
    if severity:
        log = log.filter(F.col("severity") == severity)
    if user_id:
        log = log.filter(F.col("user_id") == user_id)
    if date_from:
        log = log.filter(F.col("created_at") >= as_timestamp(date_from))
    if date_to:
        log = log.filter(F.col("created_at") <= as_timestamp(date_to))
    return log


def audit_page(log: DataFrame, limit: int = AUDIT_LIMIT, offset: int = 0, order: str = "DESC") -> DataFrame:
    """One page by time, ties by id (top-k of limit + offset rows)."""
    by_time = F.asc("created_at") if order.upper() == "ASC" else F.desc("created_at")
    return log.orderBy(by_time, "id").offset(offset).limit(limit)


def audit_statistics(log: DataFrame, as_of: datetime) -> DataFrame:
    """Total, last 24 hours, last 7 days and one count per severity, in one aggregate."""
    day = as_timestamp(as_of) - F.expr("INTERVAL '24' HOUR")
    return log.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("created_at") >= day).alias("last_24h"),
        F.count_if(F.col("created_at") >= days_before(as_of, 7)).alias("last_7d"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_events") for s in ("info", "warning", "error", "critical")],
    )


def severity_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("severity").agg(F.count("*").alias("n"))


def top_event_types(log: DataFrame, limit: int = TOP_EVENT_TYPES) -> DataFrame:
    """Most frequent event types, name breaks ties."""
    return log.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(limit)


def retain_audit(log: DataFrame, as_of: datetime, days: int = AUDIT_KEEP_DAYS) -> DataFrame:
    """Drop rows older than `days`; if any were dropped, add one `audit_cleanup` row with their number."""
    old = F.col("created_at") < days_before(as_of, days)
    cleanup = cleanup_event(log.filter(old).agg(F.count("*").alias("deleted")), as_of)
    return log.filter(~old).unionByName(cleanup, allowMissingColumns=True)


def cleanup_event(counted: DataFrame, as_of: datetime) -> DataFrame:
    """The `audit_cleanup` row for a number of dropped rows (`deleted`), none for zero."""
    return audit_events(
        counted.filter("deleted > 0"),
        F.lit("audit_cleanup"),
        F.format_string("Cleaned up %d old audit log entries", "deleted"),
        F.lit("info"),
        None,
        as_timestamp(as_of),
    )
