"""Registered queries that write stored tables and read them back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from filewarden import schema
from filewarden.operators import partials
from filewarden.plans import corpus as cp
from filewarden.session import shared_folder, stored
from filewarden.sources import rewrite, sinks

RUNS = ("morning", "noon", "evening")


def _runs(rows, key):
    """All rows, dealt to three runs."""
    return [(run, rows.filter(F.pmod(F.xxhash64(key), F.lit(len(RUNS))) == k)) for k, run in enumerate(RUNS)]


def _read(spark, like, path):
    return spark.read.schema(like).parquet(path)


def stored_results(spark, sf):
    """Threat rows of three runs, one of them repeated, read back from their table."""
    from filewarden.plans.queries import _results

    path, rows = f"{shared_folder(spark)}/results", stored(cp.results_table(spark, sf))
    for run, part in [*_runs(rows, "id"), _runs(rows, "id")[0]]:
        sinks.append_scan_results(part, path, run)
    return _results(_read(spark, schema.SCAN_RESULTS, path))


def stored_audit(spark, sf):
    """The audit log in three runs, one of them repeated, read back from its table."""
    from filewarden.plans.queries import _audit

    path, rows = f"{shared_folder(spark)}/audit", cp.audit_table(spark, sf)
    for run, part in [*_runs(rows, "id"), _runs(rows, "id")[1]]:
        sinks.append_audit(part, path, run)
    return _audit(_read(spark, schema.AUDIT_LOG, path))


def stored_quarantine(spark, sf):
    """Quarantined files, written twice by one run and read back with their whole contents."""
    from filewarden.plans.queries import _quarantine, _when_text

    path, rows = f"{shared_folder(spark)}/quarantine", _quarantine(spark, sf).quarantine
    for _ in range(2):
        sinks.append_quarantine(rows, path, "night")
    return _read(spark, schema.QUARANTINE, path).select(
        "file_path",
        F.sha2("original_content", 256).alias("content_hash"),
        "backup_path",
        "quarantine_reason",
        _when_text("quarantined_at"),
    )


def exported_results(spark, sf):
    """Result rows exported in every format and read back."""
    from filewarden.plans.queries import _results

    work, rows, back = shared_folder(spark), stored(cp.results_table(spark, sf)), None
    for kind in sinks.EXPORT_FORMATS:
        sinks.export(rows, f"{work}/{kind}", kind)
        reader = spark.read.schema(schema.SCAN_RESULTS).option("header", True)
        part = _results(reader.format(kind).load(f"{work}/{kind}")).withColumn("format", F.lit(kind))
        back = part if back is None else back.unionByName(part)
    return back


def rewritten_status(spark, sf):
    """Status changes in a stored table, applied twice: touched folders are rewritten once."""
    from filewarden.plans.queries import _results, _status_changes

    path, rows = f"{shared_folder(spark)}/results", stored(cp.results_table(spark, sf))
    for run, part in _runs(rows, "id"):
        sinks.append_scan_results(part, path, run)
    for _ in range(2):
        rewrite.set_status(spark, path, schema.SCAN_RESULTS, _status_changes(rows))
    return _results(_read(spark, schema.SCAN_RESULTS, path))


def rewritten_results(spark, sf):
    """Retention of a stored results table, run twice."""
    from filewarden.plans.queries import _results

    path, rows = f"{shared_folder(spark)}/results", stored(cp.results_table(spark, sf))
    for run, part in _runs(rows, "id"):
        sinks.append_scan_results(part, path, run)
    for _ in range(2):
        rewrite.expire_results(spark, path, schema.SCAN_RESULTS, datetime(2024, 2, 14))
    return _results(_read(spark, schema.SCAN_RESULTS, path))


def rewritten_quarantine(spark, sf):
    """Retention of a stored quarantine table; folders without rows left are gone."""
    from filewarden.plans.queries import _quarantine_table, _when_text

    path, rows = f"{shared_folder(spark)}/quarantine", stored(_quarantine_table(spark, sf))
    for run, part in _runs(rows, "id"):
        sinks.append_quarantine(part, path, run)
    for _ in range(2):
        rewrite.expire_quarantine(spark, path, schema.QUARANTINE, datetime(2024, 4, 5))
    return _read(spark, schema.QUARANTINE, path).select("id", "file_path", _when_text("quarantined_at"))


def rewritten_audit(spark, sf):
    """Retention of a stored audit log, run twice: one row with the number of dropped rows."""
    from filewarden.plans.queries import _when_text

    path, rows = f"{shared_folder(spark)}/audit", stored(cp.audit_table(spark, sf))
    for run, part in _runs(rows, "id"):
        sinks.append_audit(part, path, run)
    for _ in range(2):
        rewrite.expire_audit(spark, path, schema.AUDIT_LOG, datetime(2024, 1, 25), days=10)
    kept = _read(spark, schema.AUDIT_LOG, path)
    return kept.select("event_type", "description", "severity", "user_id", _when_text("created_at"))


def _partials(spark, sf):
    folder = f"{shared_folder(spark)}/partials"
    runs = _runs(stored(cp.results_table(spark, sf)), "id")
    for run, part in [*runs, runs[2]]:
        partials.add_run(part, folder, run)
    return folder


def partial_stats(spark, sf):
    """Threat statistics from the partial counts of three runs."""
    from filewarden.plans.queries import AS_OF

    return partials.threat_statistics(partials.counts_of(spark, _partials(spark, sf)), AS_OF)


def partial_summary(spark, sf):
    """Scan summaries from partial counts and file bitmaps; the files of a scan are spread over the runs."""
    rows = partials.scan_summaries(spark, _partials(spark, sf))
    return rows.withColumn("threat_types", F.to_json("threat_types"))


def partial_trend(spark, sf):
    """Daily trend from partial counts."""
    trend = partials.daily_trend(partials.counts_of(spark, _partials(spark, sf)))
    return trend.withColumn("day", F.col("day").cast("string"))


def store_queries():
    return {
        "stored_results": stored_results,
        "stored_audit": stored_audit,
        "stored_quarantine": stored_quarantine,
        "exported_results": exported_results,
        "rewritten_status": rewritten_status,
        "rewritten_results": rewritten_results,
        "rewritten_quarantine": rewritten_quarantine,
        "rewritten_audit": rewritten_audit,
        "partial_stats": partial_stats,
        "partial_summary": partial_summary,
        "partial_trend": partial_trend,
    }
