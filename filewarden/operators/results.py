"""The `scan_results` table: filters, pages, status changes and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.functions.severity import confidence_percent, triage_priority
from filewarden.schema import RESULT_STATUSES

# Page sizes and retention periods.
RESULTS_LIMIT = 100
HISTORY_LIMIT = 10
RECENT_LIMIT = 5
IGNORED_DAYS = 30
RESTORED_DAYS = 90


def as_timestamp(as_of: datetime) -> Column:
    """A literal point in time; without an offset it is in the session time zone, like the tables."""
    return F.lit(str(as_of)).cast("timestamp")


def days_before(as_of: datetime, days: int) -> Column:
    return as_timestamp(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def filter_results(
    results: DataFrame,
    scan_id: str | None = None,
    severity: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Keep the rows that match every given value."""
    for column, value in (("scan_id", scan_id), ("threat_severity", severity), ("status", status)):
        if value:
            results = results.filter(F.col(column) == value)
    return results


def newest_results(results: DataFrame, scan_id: str | None = None, limit: int = RESULTS_LIMIT) -> DataFrame:
    """Newest threats first (id breaks ties); a top-k, not a full sort."""
    return filter_results(results, scan_id).orderBy(F.desc("detected_at"), "id").limit(limit)


def history(results: DataFrame) -> DataFrame:
    return newest_results(results, limit=HISTORY_LIMIT)


def recent_threats(results: DataFrame) -> DataFrame:
    return newest_results(results, limit=RECENT_LIMIT)


def triage_queue(results: DataFrame) -> DataFrame:
    """Active threats with priority and confidence in percent."""
    return results.filter(F.col("status") == "active").select(
        "*",
        triage_priority(F.col("threat_severity"), F.col("confidence_score")).alias("priority"),
        confidence_percent(F.col("confidence_score")).alias("confidence_percent"),
    )


def latest_per_key(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` values per key (partial aggregate, no window)."""
    values = [c for c in table.columns if c not in keys]
    return (
        table.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("row"))
        .select(*keys, *[F.col("row")[v].alias(v) for v in values])
        .select(table.columns)
    )


def update_status(results: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply status changes `updates(id, status, updated_at)`; unknown ids are ignored.

    Of several changes to one id the last one counts. A status outside the domain
    fails the job.
    """
    last = updates.groupBy("id").agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "status")).alias("u"))
    checked = F.when(F.col("u.status").isin(*RESULT_STATUSES), F.col("u.status")).otherwise(
        F.raise_error(F.concat(F.lit("unknown threat status: "), F.col("u.status")))
    )
    new = last.select("id", checked.alias("new_status"), F.col("u.updated_at").alias("changed_at"))
    replaced = {
        "status": F.coalesce("new_status", "status").alias("status"),
        "updated_at": F.coalesce("changed_at", "updated_at").alias("updated_at"),
    }
    return results.join(new, "id", "left").select(*[replaced.get(c, F.col(c)) for c in results.columns])


def retain_results(results: DataFrame, as_of: datetime) -> DataFrame:
    """Drop ignored threats older than 30 days (exactly 30 days old stays)."""
    return results.filter(~expired_result(as_of))


def expired_result(as_of: datetime) -> Column:
    return (F.col("detected_at") < days_before(as_of, IGNORED_DAYS)) & (F.col("status") == "ignored")


def retain_quarantine(quarantine: DataFrame, as_of: datetime) -> DataFrame:
    """Drop restored quarantine rows older than 90 days."""
    return quarantine.filter(~expired_quarantine(as_of))


def expired_quarantine(as_of: datetime) -> Column:
    return (F.col("quarantined_at") < days_before(as_of, RESTORED_DAYS)) & F.col("restored_at").isNotNull()
