"""Rolling audit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_HOURS = 24
WEEK_HOURS = 168


def hourly_counts(log: DataFrame, lateness: str | None = None) -> DataFrame:
    """Counts per hour, event type and severity, for a table or a stream.

    For a stream, `lateness` sets the watermark: rows later than that are dropped.
    """
    rows = log if lateness is None else log.withWatermark("created_at", lateness)
    return rows.groupBy(F.window("created_at", "1 hour"), "event_type", "severity").agg(F.count("*").alias("n"))


def streamed_rolling_counts(log: DataFrame, hours: int, slide: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Counts of the last `hours` hours on a stream, for append mode.

    A window is emitted once, when the watermark has passed its end, and its state goes then: state holds the windows
    of `hours` plus the lateness, never the log's whole past. Events are counted into their windows map-side first.
    """
    rows = log.withWatermark("created_at", lateness)
    window = F.window("created_at", f"{hours} hours", slide)
    return rows.groupBy(window, "event_type", "severity").agg(F.count("*").alias("n"))


def rolling_counts(hourly: DataFrame, hours: int = DAY_HOURS) -> DataFrame:
    """Counts of the last `hours` hours at every full hour, from :func:`hourly_counts`.

    Only the hourly counts are spread over the windows they belong to, never the
    events; it also chains onto the streaming form.
    """
    return hourly.groupBy(F.window(F.window_time("window"), f"{hours} hours", "1 hour"), "event_type", "severity").agg(
        F.sum("n").alias("n")
    )
