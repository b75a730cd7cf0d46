"""Full file analysis and its storage rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.functions.severity import stored_confidence
from filewarden.operators.detect import drop_below, explode_threats, local_threats, ranked
from filewarden.operators.results import as_timestamp
from filewarden.operators.verdicts import add_verdicts
from filewarden.settings import ScanSettings
from filewarden.sources.catalogue import Rule


def analyse(
    files: DataFrame,
    signatures: Sequence[Rule] | None = None,
    settings: ScanSettings = ScanSettings(),
    reputation: DataFrame | None = None,
    model_verdicts: DataFrame | None = None,
) -> DataFrame:
    """One row per file: columns of `files` without content, `file_hash` and ranked `threats`.

    Without verdict tables the plan is a single narrow stage. With them, only
    (path, hash, threats) rows are joined; content stays behind in the scan.
    """
    local = local_threats(files, signatures, settings)
    full = add_verdicts(local, reputation, model_verdicts, settings.gate_verdicts)
    threats = F.col("threats") if full is local else drop_below(F.col("threats"), settings.threshold)
    return full.withColumn("threats", ranked(threats))


def threats(analysed: DataFrame) -> DataFrame:
    """One row per threat, worst first within its file (column `rank`)."""
    return explode_threats(analysed)


def scan_results(analysed: DataFrame, scan_id: str | Column, detected_at: datetime | Column) -> DataFrame:
    """Rows for the `scan_results` table; ids depend only on scan, path and rule."""
    at = as_timestamp(detected_at) if isinstance(detected_at, datetime) else detected_at.cast("timestamp")
    scan = F.lit(scan_id) if isinstance(scan_id, str) else scan_id
    return explode_threats(analysed).select(
        F.sha2(F.concat_ws("|", scan, "path", F.col("rule_ord").cast("string")), 256).alias("id"),
        scan.alias("scan_id"),
        F.col("path").alias("file_path"),
        F.col("file_hash"),
        F.col("type").alias("threat_type"),
        F.col("severity").alias("threat_severity"),
        F.col("description").alias("threat_description"),
        stored_confidence(F.col("confidence")).alias("confidence_score"),
        F.lit("active").alias("status"),
        at.alias("detected_at"),
        at.alias("updated_at"),
    )
