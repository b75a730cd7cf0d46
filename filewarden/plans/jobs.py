"""End-to-end jobs over stored tables: scan, scheduled scan, quarantine, restore.

Stored tables are append-only. Status changes and restores are rows of their own
and are merged when a table is read, so no job rewrites what another one reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from filewarden.operators import audit, remediate, results
from filewarden.operators.scan import analyse, scan_results
from filewarden.settings import ScanSettings
from filewarden.sources import sinks
from filewarden.sources.catalogue import Rule

_UPDATES = "id STRING, status STRING, updated_at TIMESTAMP"
_RESTORES = "id STRING, path STRING, restored_at TIMESTAMP"


@dataclass(frozen=True)
class Store:
    """Folders of the stored tables below one root."""

    root: str

    @property
    def results(self) -> str:
        return f"{self.root}/scan_results"

    @property
    def status_updates(self) -> str:
        return f"{self.root}/status_updates"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def restores(self) -> str:
        return f"{self.root}/restores"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit_log"

    def create(self, spark: SparkSession) -> None:
        """Empty change tables, so that readers find a schema before the first change."""
        for path, schema in ((self.status_updates, _UPDATES), (self.restores, _RESTORES)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/run=none")

    def read_results(self, spark: SparkSession) -> DataFrame:
        """Threats with their current status."""
        stored = spark.read.parquet(self.results).drop("run", "scan_date")
        return results.update_status(stored, _changes(spark, _UPDATES, self.status_updates).drop("run"))

    def read_quarantine(self, spark: SparkSession, without_run: str | None = None) -> DataFrame:
        """Quarantine rows with their time of restoration; `without_run` ignores what that run restored."""
        stored = spark.read.parquet(self.quarantine).drop("run", "quarantine_date", "restored_at")
        done = _changes(spark, _RESTORES, self.restores)
        done = done if without_run is None else done.filter(F.col("run") != without_run)
        back = done.groupBy("id").agg(F.max("restored_at").alias("restored_at"))
        return stored.join(back, "id", "left")

    def read_audit(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.audit).drop("run", "event_date")


def _changes(spark: SparkSession, fields: str, path: str) -> DataFrame:
    """Rows of a change table, with the run that wrote them."""
    return spark.read.schema(f"{fields}, run STRING").parquet(path)


def register_views(spark: SparkSession, store: Store) -> None:
    """Temporary views `scan_results` and `audit_log` for SQL users."""
    store.read_results(spark).createOrReplaceTempView("scan_results")
    store.read_audit(spark).createOrReplaceTempView("audit_log")


def _of_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The stored rows of one run, without the columns of its folders."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("run") == run).drop("run", "scan_date", "quarantine_date")


def _named(run: str | None, at: datetime) -> str:
    return run or f"at-{at:%Y%m%dT%H%M%S%f}"


def _one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def run_scan(
    spark: SparkSession,
    files: DataFrame,
    scan_id: str,
    at: datetime,
    store: Store,
    settings: ScanSettings = ScanSettings(),
    signatures: Sequence[Rule] | None = None,
    reputation: DataFrame | None = None,
    model_verdicts: DataFrame | None = None,
) -> DataFrame:
    """Scan `files`, append threats and audit events, and return the outcome row.

    The counts of the outcome are observed while the threats are written; content
    is read once.
    """
    now = results.as_timestamp(at)
    sinks.append_audit(audit.scan_started(_one_row(spark, scan_id=scan_id, scan_type="full"), now), store.audit, f"{scan_id}-started")
    seen = Observation(f"scan {scan_id}")
    analysed = analyse(files, signatures, settings, reputation, model_verdicts).observe(
        seen,
        F.count("*").alias("scanned_files"),
        F.coalesce(F.sum(F.size("threats")), F.lit(0)).alias("threats_found"),
    )
    sinks.append_scan_results(scan_results(analysed, scan_id, at), store.results, scan_id)
    outcome = _one_row(
        spark,
        scan_id=scan_id,
        status="completed",
        total_files=files.count(),
        scanned_files=seen.get["scanned_files"],
        threats_found=seen.get["threats_found"],
    )
    written = _of_run(spark, store.results, scan_id)
    sinks.append_audit(audit.threat_detected(written), store.audit, f"{scan_id}-threats")
    sinks.append_audit(audit.scan_completed(outcome, now), store.audit, f"{scan_id}-completed")
    return outcome


@dataclass(frozen=True)
class ScheduledRun:
    """What a scheduled scan leaves to its caller."""

    outcome: DataFrame
    alerts: DataFrame
    retained_results: DataFrame
    retained_quarantine: DataFrame


def run_scheduled_scan(
    spark: SparkSession,
    files: DataFrame,
    scan_id: str,
    at: datetime,
    store: Store,
    settings: ScanSettings = ScanSettings(),
) -> ScheduledRun:
    """Scan, alert rows if threats were found, and the tables after retention.

    The retained tables are for :func:`filewarden.sources.sinks.write_version`.
    """
    outcome = run_scan(spark, files, scan_id, at, store, settings)
    return ScheduledRun(
        outcome,
        remediate.scan_alerts(outcome, at, settings),
        results.retain_results(store.read_results(spark), at),
        results.retain_quarantine(store.read_quarantine(spark), at),
    )


def run_quarantine(
    spark: SparkSession,
    requests: DataFrame,
    files: DataFrame,
    at: datetime,
    store: Store,
    settings: ScanSettings = ScanSettings(),
    quarantine_dir: str = "quarantine/",
    run: str | None = None,
) -> remediate.Remediation:
    """Quarantine the files of the requested threat ids. `run` names the run; the same one again replaces its rows.

    Originals are stored first; status changes and audit rows come from what was
    stored, so a run that dies in between never reports more than it saved.
    """
    resolved = remediate.resolve_requests(requests, store.read_results(spark))
    run = _named(run, at)
    rows = remediate.quarantine_rows(remediate.flagged_paths(resolved), files, at, quarantine_dir)
    good = rows.filter(F.col("outcome") == remediate.OK).drop("outcome")
    sinks.append_quarantine(good, store.quarantine, run)
    saved = _of_run(spark, store.quarantine, run)
    done = saved.select("file_path", F.lit(remediate.OK).alias("outcome"))
    updates = remediate.status_updates(resolved, done, at)
    updates.write.mode("overwrite").parquet(f"{store.status_updates}/run={run}")
    sinks.append_audit(audit.file_quarantined(saved), store.audit, f"{run}-quarantined")
    file_outcome = F.coalesce(F.col("d.outcome"), F.lit(remediate.FILE_NOT_FOUND))
    outcomes = (
        resolved.alias("r")
        .join(done.alias("d"), "file_path", "left")
        .select(
            "id",
            "file_path",
            F.when(F.col("r.outcome") == remediate.OK, file_outcome).otherwise(F.col("r.outcome")).alias("outcome"),
        )
    )
    return remediate.Remediation(outcomes, saved, updates, remediate.quarantine_alerts(saved, at, settings))


def run_restore(
    spark: SparkSession, requests: DataFrame, at: datetime, store: Store, run: str | None = None
) -> DataFrame:
    """Restore the newest open quarantine row of each requested path; returns rows with outcome and content."""
    run = _named(run, at)
    quarantine = store.read_quarantine(spark, without_run=run)
    restored = remediate.restore_rows(requests, quarantine)
    marks = restored.filter(F.col("outcome") == remediate.OK).select(
        "id", "path", results.as_timestamp(at).alias("restored_at")
    )
    marks.write.mode("overwrite").parquet(f"{store.restores}/run={run}")
    saved = _changes(spark, _RESTORES, store.restores).filter(F.col("run") == run).drop("run")
    sinks.append_audit(audit.file_restored(saved.withColumnRenamed("path", "file_path")), store.audit, f"{run}-restored")
    content = spark.read.parquet(store.quarantine).select("id", F.col("original_content").alias("content"))
    done = saved.select("path", "id").join(content, "id")
    missing = requests.select("path").distinct().join(saved.select("path"), "path", "left_anti")
    return done.select("path", "id", "content", F.lit(remediate.OK).alias("outcome")).unionByName(
        missing.select(
            "path",
            F.lit(None).cast("string").alias("id"),
            F.lit(None).cast("binary").alias("content"),
            F.lit(remediate.NOT_QUARANTINED).alias("outcome"),
        )
    )
