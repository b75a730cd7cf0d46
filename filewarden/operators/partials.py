"""Partial aggregates of stored runs: dashboards that read counts instead of threat rows, and equal the full scan.

A run leaves three folders behind: counts per (scan, day, severity, type, status) with the time of the last threat,
affected files per scan as bitmaps, and the numbers that its new paths got. Counts add up and bitmaps of one numbering
merge by `or`, so any set of runs gives exact totals, also for a file that several runs found in one scan. The numbers
of paths are dense: one partition sum over the tasks of a run, whose rows are few, and no global order.

A repeated run replaces its counts and bitmaps; its paths keep their numbers. Runs that number paths must not overlap
in time. A run whose threat rows change later (a new status) is added again under its name.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filewarden.operators.report import RECENT_SCAN_DAYS
from filewarden.operators.results import days_before
from filewarden.session import stored

LEVELS = ("critical", "high", "medium", "low")
NUMBERS = "file_path STRING, number BIGINT"
COUNTS = "scan_id STRING, day DATE, threat_severity STRING, threat_type STRING, status STRING, n BIGINT, last_at TIMESTAMP"
FILES = "scan_id STRING, bucket BIGINT, bits BINARY"


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The table at `path`, empty before its first run."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def number_paths(paths: DataFrame, folder: str) -> DataFrame:
    """(file_path, number) of everything numbered in `folder`, after new `paths` got the next numbers."""
    spark = paths.sparkSession
    known = _read(spark, NUMBERS, folder)
    base = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    new = paths.select("file_path").distinct().join(known, "file_path", "left_anti")
    new = stored(new.withColumn("place", F.monotonically_increasing_id()))
    task, at = F.shiftright("place", 33).alias("task"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = new.groupBy(task).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("task")) - F.col("n") + base
    numbered = new.withColumn("task", task).join(F.broadcast(sizes.select("task", before.alias("before"))), "task")
    numbered.select("file_path", (F.col("before") + at).alias("number")).write.mode("append").parquet(folder)
    return spark.read.schema(NUMBERS).parquet(folder)


def add_run(results: DataFrame, folder: str, run: str) -> None:
    """Adds the partial aggregates of the threat rows of one run; the same run again replaces them."""
    if not run or any(c in run for c in "/=\\"):
        raise ValueError(f"{run!r} cannot name a run")
    counts = results.groupBy("scan_id", F.to_date("detected_at").alias("day"), "threat_severity", "threat_type", "status").agg(
        F.count("*").alias("n"), F.max("detected_at").alias("last_at")
    )
    counts.write.mode("overwrite").parquet(f"{folder}/counts/run={run}")
    affected = results.select("scan_id", "file_path").distinct()
    number = F.col("number")
    bitmaps = (
        affected.join(number_paths(affected, f"{folder}/paths"), "file_path")
        .groupBy("scan_id", F.bitmap_bucket_number(number).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    )
    bitmaps.write.mode("overwrite").parquet(f"{folder}/files/run={run}")


def counts_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{COUNTS}, run STRING").parquet(f"{folder}/counts").drop("run")


def threat_statistics(counts: DataFrame, as_of: datetime) -> DataFrame:
    """As :func:`filewarden.operators.report.threat_statistics`, from partial counts.

    A scan is recent if its last threat is, so the time of that one decides, at any second of the day.
    """
    active = F.col("status") == "active"
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    recent = F.col("last_at") >= days_before(as_of, RECENT_SCAN_DAYS)
    return counts.agg(
        total(active).alias("total_threats"),
        *[total(active & (F.col("threat_severity") == level)).alias(f"{level}_threats") for level in LEVELS],
        F.count_distinct(F.when(recent, F.col("scan_id"))).alias("recent_scans"),
    )


def affected_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Different affected files per scan, over all runs."""
    bitmaps = spark.read.schema(f"{FILES}, run STRING").parquet(f"{folder}/files")
    merged = bitmaps.groupBy("scan_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("scan_id").agg(F.sum(F.bitmap_count("bits")).alias("affected_files"))


def scan_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`filewarden.operators.report.scan_summaries`, from partial counts and bitmaps."""
    counts = counts_of(spark, folder)
    level = lambda name: F.sum(F.when(F.col("threat_severity") == name, F.col("n")).otherwise(0))
    per_type = counts.groupBy("scan_id", "threat_type").agg(
        F.sum("n").alias("n"), *[level(name).alias(f"{name}_threats") for name in LEVELS]
    )
    totals = per_type.groupBy("scan_id").agg(
        F.sum("n").alias("total_threats"),
        *[F.sum(f"{name}_threats").alias(f"{name}_threats") for name in LEVELS],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("threat_type", "n")))).alias("threat_types"),
    )
    return totals.join(affected_counts(spark, folder), "scan_id")


def daily_trend(counts: DataFrame) -> DataFrame:
    """Threats per day and severity, from partial counts."""
    return counts.groupBy("day", "threat_severity").agg(F.sum("n").alias("threats"))
