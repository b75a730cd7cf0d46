"""Registered queries that run as streams over the supplied tables."""

from __future__ import annotations

from datetime import datetime
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewarden.operators.scan import threats
from filewarden.plans import corpus as cp
from filewarden.session import shared_folder
from filewarden.streaming import admission as admission_streaming
from filewarden.streaming import audit as audit_streaming
from filewarden.streaming import scan as scan_streaming

# Bytes of content in an arrival of `stream_progress`, and bytes in one of its row groups.
ARRIVAL_BYTES = 256 * 1024 * 1024
ROW_GROUP_BYTES = 8 * 1024 * 1024


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cp.table(spark, sf_dir, "events")
    # A glob is accepted whether the table is one file or a folder of files.
    return spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque[t]")


def stream_scan(spark, sf):
    """The corpus as arriving files: written once as Parquet, read back as a stream."""
    work = shared_folder(spark)
    cp.corpus(spark, sf).select("path", "content", "size", "mtime").write.parquet(f"{work}/arrivals")
    analysed = scan_streaming.scan_stream(scan_streaming.read_arrivals(spark, f"{work}/arrivals"))
    query = (
        threats(analysed)
        .select("path", "rank", "type", "severity", "confidence", "line_number")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{work}/threats")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{work}/threats")


def _streamed_hours(spark, sf):
    work = shared_folder(spark)
    log = _events(spark, sf).select(
        F.col("ts").cast("timestamp").alias("created_at"),
        "event_type",
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "warning")
        .when(F.col("event_type") == "signup", "critical")
        .otherwise("info")
        .alias("severity"),
    )
    query = (
        audit_streaming.hourly_counts(log, "1 hour")
        .writeStream.foreachBatch(lambda counts, _: counts.write.mode("overwrite").parquet(f"{work}/hours"))
        .outputMode("complete")
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{work}/hours")


def stream_audit_hours(spark, sf):
    return _streamed_hours(spark, sf).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "severity", "n"
    )


def stream_audit_rolling(spark, sf):
    """Trailing 24 hours at every hour and 7 days at every midnight, in append mode: windows that are closed."""
    work = shared_folder(spark)
    log = _events(spark, sf).select(
        F.col("ts").cast("timestamp").alias("created_at"),
        "event_type",
        F.when(F.col("event_type") == "error", "error").otherwise("other").alias("severity"),
    )
    for name, hours, slide in (("day", audit_streaming.DAY_HOURS, "1 hour"), ("week", audit_streaming.WEEK_HOURS, "24 hours")):
        query = (
            audit_streaming.streamed_rolling_counts(log, hours, slide)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{work}/checkpoint_{name}")
            .trigger(availableNow=True)
            .start(f"{work}/{name}")
        )
        query.awaitTermination()
    read = lambda name: spark.read.parquet(f"{work}/{name}").select(
        F.lit(name).alias("span"), F.date_format("window.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "event_type", "severity", "n"
    )
    return read("day").unionByName(read("week"))


def stream_progress(spark, sf):
    """Files and threats that the progress rows of a run report, over all its batches of one arrival each."""
    work, files = shared_folder(spark), cp.corpus(spark, sf).select("path", "content", "size", "mtime")
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    arrivals = files.repartition(max(4, ceil(total / ARRIVAL_BYTES)))
    # Small row groups, so that one arrival is read by several tasks.
    arrivals.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{work}/arrivals")
    analysed = scan_streaming.scan_stream(scan_streaming.read_arrivals(spark, f"{work}/arrivals", 1))
    scan_streaming.write_scan_results(
        analysed, f"{work}/results", f"{work}/checkpoint", progress_path=f"{work}/progress"
    ).awaitTermination()
    rows = scan_streaming.read_progress(spark, f"{work}/progress")
    return rows.groupBy("run").agg(F.sum("files").alias("files"), F.sum("threats").alias("threats"))


def stream_skip_seen(spark, sf):
    """Every document arrives twice, in two batches, with modification times that go backwards; each is reported once."""
    work = shared_folder(spark)
    files = cp.corpus(spark, sf).select("path", "content", "size", F.timestamp_seconds(-F.col("file_no")).alias("mtime"))
    for part in ("first", "second"):
        files.write.mode("append").parquet(f"{work}/arrivals")
        # Hashes decide what is scanned: content that was seen is neither read again nor scanned.
        unseen = scan_streaming.skip_seen(scan_streaming.hashed(scan_streaming.read_arrivals(spark, f"{work}/arrivals")))
        scan_streaming.write_scan_results(
            unseen,
            f"{work}/results",
            f"{work}/checkpoint_{part}",
            part,
            f"{work}/seen",
            arrivals_path=f"{work}/arrivals",
            scan=scan_streaming.scan_stream,
        ).awaitTermination()
    return scan_streaming.read_results(spark, f"{work}/results").select(
        "file_path", "file_hash", "threat_type", "threat_severity"
    )


def rolling_audit_day(spark, sf):
    hourly = audit_streaming.hourly_counts(cp.audit_table(spark, sf))
    rolling = audit_streaming.rolling_counts(hourly, audit_streaming.DAY_HOURS)
    return rolling.select(
        F.date_format("window.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "event_type", "severity", "n"
    )


def stream_admission(spark, sf):
    """`events` as a stream of calls that arrives in three parts, each decided before the next."""
    from filewarden.plans.queries import ADMISSION_LIMIT, ADMISSION_WINDOW

    work = shared_folder(spark)
    calls = cp.calls_table(spark, sf)
    days = [datetime(2024, 1, d) for d in (11, 21)]
    for start, end in zip([None, *days], [*days, None]):
        part = calls if start is None else calls.filter(F.col("ts") >= F.lit(str(start)).cast("timestamp"))
        part = part if end is None else part.filter(F.col("ts") < F.lit(str(end)).cast("timestamp"))
        part.write.mode("append").parquet(f"{work}/calls")
        arriving = spark.readStream.schema(calls.schema).parquet(f"{work}/calls")
        admitted = admission_streaming.admitted_stream(arriving, {"error": 3}, ADMISSION_LIMIT, ADMISSION_WINDOW)
        admission_streaming.write_admitted(admitted, f"{work}/admitted", f"{work}/checkpoint").awaitTermination()
    accepted = spark.read.schema("call_id BIGINT, api STRING").parquet(f"{work}/admitted")
    return admission_streaming.decisions(calls, accepted).select("call_id", "api", "accepted")


def stream_queries():
    return {
        "stream_scan": stream_scan,
        "stream_audit_hours": stream_audit_hours,
        "stream_audit_rolling": stream_audit_rolling,
        "stream_skip_seen": stream_skip_seen,
        "stream_progress": stream_progress,
        "rolling_audit_day": rolling_audit_day,
        "stream_admission": stream_admission,
    }
