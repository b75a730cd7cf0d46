"""Quarantine, restore and clean as set operations, and the alert rows they queue.

Outcomes are data: a request that cannot be served gives a row that says why.
Content is only joined for the requested paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.functions import bytestring as bs
from filewarden.functions.text import basename
from filewarden.operators.results import as_timestamp
from filewarden.session import broadcast_if_small
from filewarden.settings import ScanSettings
from filewarden.sources.catalogue import java_regex

# Outcome codes.
OK = "ok"
THREAT_NOT_FOUND = "threat_not_found"
FILE_NOT_FOUND = "file_not_found"
FILE_NOT_READABLE = "file_not_readable"
NOT_QUARANTINED = "file_not_quarantined"
NO_CHANGES = "no_changes"


def quarantine_name(path: Column, at: Column) -> Column:
    """`yyyy-MM-dd_HH-mm-ss_<8 hex digits of the path's md5>_<file name>`."""
    return F.concat_ws(
        "_", F.date_format(at, "yyyy-MM-dd_HH-mm-ss"), F.substring(F.md5(path), 1, 8), basename(path)
    )


def placeholder(path: Column, reason: Column, at: Column, settings: ScanSettings) -> Column:
    """Harmless replacement text for a quarantined file."""
    return F.concat(
        F.lit(f"<?php\n/*\n * QUARANTINED FILE - {settings.site_name}\n *\n * Original file: "),
        path,
        F.lit("\n * Quarantined: "),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss"),
        F.lit("\n * Reason: "),
        reason,
        F.lit(
            f"\n *\n * Contact: {settings.admin_email}\n * The original can be restored from quarantine.\n */\n"
            "exit('This file is in quarantine.');\n"
        ),
    )


def resolve_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Threat ids to files: `requests(id)` with path, reason and outcome."""
    found = results.select("id", "file_path", F.col("threat_description").alias("reason"))
    outcome = F.when(F.col("file_path").isNull(), F.lit(THREAT_NOT_FOUND)).otherwise(F.lit(OK))
    return (
        requests.select("id").distinct().join(found, "id", "left").select("id", "file_path", "reason", outcome.alias("outcome"))
    )


def flagged_paths(resolved: DataFrame) -> DataFrame:
    """One row (path, reason) per file to quarantine; of several reasons the first by id counts."""
    return (
        resolved.filter(F.col("outcome") == OK)
        .groupBy(F.col("file_path").alias("path"))
        .agg(F.min_by("reason", "id").alias("reason"))
    )


def quarantine_rows(
    flagged: DataFrame, files: DataFrame, at: datetime, quarantine_dir: str = "quarantine/"
) -> DataFrame:
    """Flagged paths with their content as `quarantine` rows plus `outcome`.

    The flagged side is broadcast only after it was measured to be small; then the
    corpus is filtered in place and only flagged content is shuffled.
    """
    now = as_timestamp(at)
    found = files.select("path", "content", F.lit(True).alias("__exists")).join(
        broadcast_if_small(flagged.select("path")), "path"
    )
    hit = flagged.join(found, "path", "left")
    outcome = (
        F.when(F.col("__exists").isNull(), F.lit(FILE_NOT_FOUND))
        .when(F.col("content").isNull(), F.lit(FILE_NOT_READABLE))
        .otherwise(F.lit(OK))
    )
    return hit.select(
        F.sha2(F.concat_ws("|", "path", F.date_format(now, "yyyy-MM-dd HH:mm:ss")), 256).alias("id"),
        F.col("path").alias("file_path"),
        F.col("content").alias("original_content"),
        F.concat(F.lit(quarantine_dir), quarantine_name(F.col("path"), now)).alias("backup_path"),
        F.col("reason").alias("quarantine_reason"),
        now.alias("quarantined_at"),
        F.lit(None).cast("timestamp").alias("restored_at"),
        outcome.alias("outcome"),
    )


def replace_quarantined(
    files: DataFrame, flagged: DataFrame, at: datetime, settings: ScanSettings = ScanSettings()
) -> DataFrame:
    """The corpus with the content of flagged files replaced by the placeholder."""
    wanted = broadcast_if_small(flagged.select("path", F.col("reason").alias("__reason")))
    text = placeholder(F.col("path"), F.col("__reason"), as_timestamp(at), settings)
    replaced = F.when(F.col("__reason").isNotNull() & F.col("content").isNotNull(), bs.text_bytes(text))
    joined = files.join(wanted, "path", "left").withColumn("content", replaced.otherwise(F.col("content")))
    return joined.select(
        *[F.octet_length("content").cast("bigint").alias("size") if c == "size" else F.col(c) for c in files.columns]
    )


def open_quarantine(quarantine: DataFrame) -> DataFrame:
    """Rows not yet restored (sort with :func:`newest_first` for display)."""
    return quarantine.filter(F.col("restored_at").isNull())


def newest_first(quarantine: DataFrame) -> DataFrame:
    return quarantine.orderBy(F.desc("quarantined_at"), "id")


def quarantine_size(quarantine: DataFrame) -> DataFrame:
    """Bytes held in open quarantine rows."""
    return open_quarantine(quarantine).agg(
        F.coalesce(F.sum(F.octet_length("original_content").cast("bigint")), F.lit(0)).alias("quarantine_bytes")
    )


def restore_rows(requests: DataFrame, quarantine: DataFrame) -> DataFrame:
    """For `requests(path)`: the newest open quarantine row and an outcome.

    The newest id per path is picked from narrow columns; content is fetched by id,
    and only that of the picked rows is shuffled.
    """
    asked = requests.select("path").distinct()
    opened = open_quarantine(quarantine)
    newest = (
        opened.groupBy(F.col("file_path").alias("path"))
        .agg(F.max_by("id", F.struct("quarantined_at", "id")).alias("id"))
        .join(asked, "path", "right")
    )
    wanted = broadcast_if_small(newest.filter(F.col("id").isNotNull()).select("id"))
    content = opened.select("id", F.col("original_content").alias("content")).join(wanted, "id", "left_semi")
    outcome = F.when(F.col("id").isNull(), F.lit(NOT_QUARANTINED)).otherwise(F.lit(OK))
    return newest.join(content, "id", "left").select("path", "id", "content", outcome.alias("outcome"))


def restore_contents(files: DataFrame, restored: DataFrame, at: datetime) -> DataFrame:
    """The corpus with restored contents put back.

    Restored rows replace the rows of their paths: the corpus is only filtered by
    path (in place when the paths are few), so no content is joined or shuffled.
    """
    back = restored.filter(F.col("outcome") == OK)
    paths = broadcast_if_small(back.select("path"))
    values = {
        "path": F.col("path"),
        "content": F.col("content"),
        "size": F.octet_length("content").cast("bigint"),
        "mtime": as_timestamp(at),
    }
    rows = back.select(*[values.get(c, F.lit(None)).cast(files.schema[c].dataType).alias(c) for c in files.columns])
    return files.join(paths, "path", "left_anti").select(files.columns).unionByName(rows)


def mark_restored(quarantine: DataFrame, restored: DataFrame, at: datetime) -> DataFrame:
    """Set `restored_at` on the restored rows."""
    ids = restored.filter(F.col("outcome") == OK).select("id", F.lit(True).alias("__restored"))
    stamp = F.when(F.col("__restored"), as_timestamp(at)).otherwise(F.col("restored_at"))
    return quarantine.join(ids, "id", "left").select(
        *[stamp.alias("restored_at") if c == "restored_at" else F.col(c) for c in quarantine.columns]
    )


def clean(files: DataFrame, patterns: Sequence[str], at: datetime, quarantine_dir: str = "quarantine/") -> DataFrame:
    """Delete every match of the patterns (Perl-style, in order) from every file.

    Changed files carry the cleaned content and the name of their backup; the
    others say `no_changes`.
    """
    readable = files.select("path", "content", bs.latin1(F.col("content")).alias("__bytes"))
    cleaned = F.col("__bytes")
    for pattern in patterns:
        cleaned = F.regexp_replace(cleaned, java_regex(pattern), "")
    changed = F.col("__cleaned") != F.col("__bytes")
    outcome = (
        F.when(F.col("content").isNull(), F.lit(FILE_NOT_READABLE)).when(changed, F.lit(OK)).otherwise(F.lit(NO_CHANGES))
    )
    backup = F.concat(F.lit(f"{quarantine_dir}backup_"), quarantine_name(F.col("path"), as_timestamp(at)))
    return readable.withColumn("__cleaned", cleaned).select(
        "path",
        outcome.alias("outcome"),
        F.when(changed, bs.to_bytes(F.col("__cleaned"))).otherwise(F.col("content")).alias("content"),
        F.when(changed, F.col("content")).alias("backup_content"),
        F.when(changed, backup).alias("backup_path"),
    )


@dataclass(frozen=True)
class Remediation:
    """Tables of one quarantine run."""

    outcomes: DataFrame
    quarantine: DataFrame
    status_updates: DataFrame
    alerts: DataFrame


def _alerts(rows: DataFrame, subject: str, lines: list[Column], settings: ScanSettings) -> DataFrame:
    shown = rows if settings.alerts_enabled else rows.filter(F.lit(False))
    return shown.select(
        F.lit(settings.notification_email).alias("recipient"),
        F.lit(f"[{settings.site_name}] filewarden: {subject}").alias("subject"),
        F.concat_ws("\n", *lines, F.lit(""), F.lit(f"See {settings.dashboard_url}")).alias("body"),
    )


def _time_line(at: datetime) -> Column:
    return F.concat(F.lit("At = "), F.date_format(as_timestamp(at), "yyyy-MM-dd HH:mm:ss"))


def quarantine_alerts(quarantined: DataFrame, at: datetime, settings: ScanSettings) -> DataFrame:
    """One alert per quarantined file, if alerts are enabled."""
    lines = [
        F.lit("One file was taken out of service. Its content is stored in the quarantine table."),
        F.lit(""),
        F.concat(F.lit("Path = "), F.col("file_path")),
        F.concat(F.lit("Cause = "), F.col("quarantine_reason")),
        _time_line(at),
    ]
    return _alerts(quarantined, "file locked away", lines, settings)


def cleaning_alerts(cleaned: DataFrame, pattern_count: int, at: datetime, settings: ScanSettings) -> DataFrame:
    """One alert per cleaned file, if alerts are enabled."""
    lines = [
        F.lit("Matches of the given patterns were cut out of one file. Its former content is stored as a backup."),
        F.lit(""),
        F.concat(F.lit("Path = "), F.col("path")),
        F.lit(f"Patterns applied = {pattern_count}"),
        _time_line(at),
    ]
    return _alerts(cleaned.filter(F.col("outcome") == OK), "code cut out of a file", lines, settings)


def scan_alerts(outcomes: DataFrame, at: datetime, settings: ScanSettings) -> DataFrame:
    """One alert per scan that found threats, if alerts are enabled."""
    lines = [
        F.lit("The timed scan ended with findings."),
        F.lit(""),
        F.concat(F.lit("Files read = "), F.col("total_files").cast("string")),
        F.concat(F.lit("Findings = "), F.col("threats_found").cast("string")),
        F.concat(F.lit("Scan = "), F.col("scan_id")),
        _time_line(at),
    ]
    return _alerts(outcomes.filter("threats_found > 0"), "scan with findings", lines, settings)


def status_updates(resolved: DataFrame, quarantined: DataFrame, at: datetime) -> DataFrame:
    """`quarantined` status for every resolved threat whose file went to quarantine."""
    done = quarantined.filter(F.col("outcome") == OK).select("file_path")
    return (
        resolved.filter(F.col("outcome") == OK)
        .join(done, "file_path", "left_semi")
        .select("id", F.lit("quarantined").alias("status"), as_timestamp(at).alias("updated_at"))
    )


def cleaned_updates(results: DataFrame, cleaned: DataFrame, at: datetime) -> DataFrame:
    """`cleaned` status for the active threats of every cleaned file."""
    done = cleaned.filter(F.col("outcome") == OK).select(F.col("path").alias("file_path"))
    return (
        results.filter(F.col("status") == "active")
        .join(done, "file_path", "left_semi")
        .select("id", F.lit("cleaned").alias("status"), as_timestamp(at).alias("updated_at"))
    )


def quarantine_plan(
    requests: DataFrame,
    results: DataFrame,
    files: DataFrame,
    at: datetime,
    settings: ScanSettings = ScanSettings(),
    quarantine_dir: str = "quarantine/",
) -> Remediation:
    """Everything one quarantine run writes, from threat ids to alerts."""
    resolved = resolve_requests(requests, results)
    rows = quarantine_rows(flagged_paths(resolved), files, at, quarantine_dir)
    by_file = rows.select("file_path", F.col("outcome").alias("file_outcome"))
    outcomes = resolved.join(by_file, "file_path", "left").select(
        "id",
        "file_path",
        F.when(F.col("outcome") == OK, F.col("file_outcome")).otherwise(F.col("outcome")).alias("outcome"),
    )
    stored = rows.filter(F.col("outcome") == OK).drop("outcome")
    return Remediation(
        outcomes, stored, status_updates(resolved, rows, at), quarantine_alerts(stored, at, settings)
    )
