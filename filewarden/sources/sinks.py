"""Writers for the result tables. Tables are Parquet folders with one folder per run: runs add to a table, a
repeated run replaces its own rows only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_FORMATS = ("csv", "json", "parquet")


def run_folder(run: str) -> str:
    """The folder of a run, escaped as Spark's own writer does it, so that both write to the same place."""
    if not run or any(c in run for c in "/=\\"):
        raise ValueError(f"{run!r} cannot name a run")
    return "run=" + re.sub(r"""[\x00-\x1f\x7f"#%'*:?{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", run)


def _write_run(rows: DataFrame, path: str, run: str, day: str, at: str) -> None:
    """Writes the rows of one run to its own folder, by day; the same run again replaces them."""
    rows.withColumn(day, F.to_date(at)).write.mode("overwrite").partitionBy(day).parquet(f"{path}/{run_folder(run)}")


def append_scan_results(results: DataFrame, path: str, run: str) -> None:
    """Add the threat rows of a run, partitioned by the day of detection."""
    _write_run(results, path, run, "scan_date", "detected_at")


def append_audit(events: DataFrame, path: str, run: str) -> None:
    """Add the audit rows of one step of a run, partitioned by day."""
    _write_run(events, path, run, "event_date", "created_at")


def append_quarantine(rows: DataFrame, path: str, run: str) -> None:
    """Add the quarantine rows of a run, partitioned by day."""
    _write_run(rows, path, run, "quarantine_date", "quarantined_at")


def write_version(table: DataFrame, path: str) -> None:
    """Write a rewritten table (status change, retention) to a new folder.

    The folder must not exist: a table that is being read is never overwritten.
    """
    table.write.mode("error").parquet(path)


def export(results: DataFrame, path: str, file_format: str = "csv") -> None:
    """Export result rows as CSV (with a header), JSON lines or Parquet."""
    if file_format not in EXPORT_FORMATS:
        raise ValueError(f"unknown export format {file_format!r}")
    writer = results.write.mode("error")
    (writer.option("header", True) if file_format == "csv" else writer).format(file_format).save(path)
