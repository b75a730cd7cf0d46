"""Counts, summaries, trends and progress."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.functions.severity import site_status as status_of
from filewarden.operators.results import as_timestamp, days_before

RECENT_SCAN_DAYS = 7


def _severity_counts(severity: str, active: Column | None = None) -> list[Column]:
    def matches(level: str) -> Column:
        hit = F.col(severity) == level
        return hit if active is None else hit & active

    return [F.count_if(matches(level)).alias(f"{level}_threats") for level in ("critical", "high", "medium", "low")]


def threat_statistics(results: DataFrame, as_of: datetime) -> DataFrame:
    """Active threats in total and per severity, and scans of the last 7 days, in one aggregate."""
    active = F.col("status") == "active"
    recent = F.col("detected_at") >= days_before(as_of, RECENT_SCAN_DAYS)
    return results.agg(
        F.count_if(active).alias("total_threats"),
        *_severity_counts("threat_severity", active),
        F.count_distinct(F.when(recent, F.col("scan_id"))).alias("recent_scans"),
    )


def site_status(statistics: DataFrame) -> DataFrame:
    """One status word from the threat statistics."""
    return statistics.select("*", status_of(F.col("critical_threats"), F.col("high_threats")).alias("site_status"))


def scan_summaries(results: DataFrame) -> DataFrame:
    """Per scan: threats, severity counts, type counts and number of affected files.

    The scan id is a hot key by nature, so everything is first counted per
    (scan, file, type): a scan reaches its final group as counts only. The map
    holds one entry per rule type.
    """
    per_file = results.groupBy("scan_id", "file_path", "threat_type").agg(
        F.count("*").alias("total_threats"), *_severity_counts("threat_severity")
    )
    names = ["total_threats", "critical_threats", "high_threats", "medium_threats", "low_threats"]
    files = per_file.groupBy("scan_id", "file_path").agg(*[F.sum(n).alias(n) for n in names])
    totals = files.groupBy("scan_id").agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("affected_files"))
    types = (
        per_file.groupBy("scan_id", "threat_type")
        .agg(F.sum("total_threats").alias("n"))
        .groupBy("scan_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("threat_type", "n")))).alias("threat_types"))
    )
    return totals.join(types, "scan_id")


def scan_summary(results: DataFrame, scan_id: str) -> DataFrame:
    """Summary of one scan, over all its rows."""
    return scan_summaries(results.filter(F.col("scan_id") == scan_id))


def affected_files(results: DataFrame) -> DataFrame:
    """Distinct affected files per scan, as rows."""
    return results.select("scan_id", "file_path").distinct()


def type_counts(results: DataFrame) -> DataFrame:
    """Threats per scan and type, as rows."""
    return results.groupBy("scan_id", "threat_type").agg(F.count("*").alias("n"))


def daily_trend(results: DataFrame) -> DataFrame:
    """Threats per day and severity."""
    return results.groupBy(F.to_date("detected_at").alias("day"), "threat_severity").agg(F.count("*").alias("threats"))


def most_affected(results: DataFrame, limit: int) -> DataFrame:
    """Files with the most threats (top-k)."""
    return (
        results.groupBy("file_path")
        .agg(F.count("*").alias("threats"), F.max("confidence_score").alias("max_confidence"))
        .orderBy(F.desc("threats"), "file_path")
        .limit(limit)
    )


def type_severity_rollup(results: DataFrame) -> DataFrame:
    """Threat counts by severity and type with subtotals."""
    return results.rollup("threat_severity", "threat_type").agg(F.count("*").alias("threats"))


def progress(manifest: DataFrame, scanned: DataFrame, as_of: datetime) -> DataFrame:
    """Per scan: files, scanned files, percentage, elapsed and estimated remaining seconds.

    `manifest(scan_id, path, started_at)` lists what is to be scanned,
    `scanned(scan_id, path)` what is done.
    """
    done = scanned.select("scan_id", "path").distinct().withColumn("done", F.lit(True))
    counted = (
        manifest.join(done, ["scan_id", "path"], "left")
        .groupBy("scan_id")
        .agg(
            F.count("*").alias("total_files"),
            F.count_if(F.col("done")).alias("scanned_files"),
            F.min("started_at").alias("started_at"),
        )
    )
    total, n = F.col("total_files"), F.col("scanned_files")
    elapsed = F.unix_timestamp(as_timestamp(as_of)) - F.unix_timestamp("started_at")
    return counted.select(
        "scan_id",
        "total_files",
        "scanned_files",
        F.when(total > 0, F.round(n / total * 100, 2)).otherwise(0.0).alias("percentage"),
        elapsed.alias("elapsed_time"),
        F.when(n > 0, F.round(elapsed / n * (total - n))).otherwise(0.0).cast("bigint").alias("estimated_time"),
    )


def scan_outcome(analysed: DataFrame, scan_id: str, total_files: Column | int, status: str = "completed") -> DataFrame:
    """One row about a finished scan, from the per-file rows of an analysis."""
    total = F.lit(total_files) if isinstance(total_files, int) else total_files
    return analysed.agg(
        F.count("*").alias("scanned_files"),
        F.coalesce(F.sum(F.size("threats")), F.lit(0)).alias("threats_found"),
    ).select(
        F.lit(scan_id).alias("scan_id"),
        F.lit(status).alias("status"),
        total.cast("bigint").alias("total_files"),
        "scanned_files",
        "threats_found",
    )
