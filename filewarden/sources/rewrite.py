"""Changes to stored tables that rewrite only the folders they touch.

Tables are Parquet folders as :mod:`filewarden.sources.sinks` writes them: run, then day. A change first finds the
folders that hold rows it alters, from the columns it needs; only those folders are read whole, and their new rows go to
a table in the shared folder before anything is replaced. Every other file of the table stays as it is.

A change states a goal ("these ids have this status", "no row older than this"), so the same change again finds nothing
left to do. One that was stopped half way is finished by running it again: the rows of a folder are replaced in one
commit, and folders without rows left are deleted last. Only one change may run on a table at a time.

The names of touched folders come to the driver, which lists all folders of the table anyway; rows never do.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from filewarden.operators import audit, results
from filewarden.session import broadcast_if_small, stored
from filewarden.sources import sinks

NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def read_folders(spark: SparkSession, path: str, like: StructType, day: str) -> DataFrame:
    """A stored table with the columns of its folders, `run` and `day`."""
    folders = [StructField("run", StringType()), StructField(day, DateType())]
    return spark.read.schema(StructType([*like.fields, *folders])).parquet(path)


def _name(day: str) -> Column:
    """A folder's name; a function of partition columns only, so a filter on it decides which files are read."""
    return F.concat_ws("/", "run", F.coalesce(F.col(day).cast("string"), F.lit(NO_DAY)))


def rewrite(spark: SparkSession, path: str, like: StructType, day: str, altered: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Replace the folders that hold `altered` rows of the table by their rows after `change`; returns their names.

    `altered` and `change` get the table with `run` and `day` and must keep both columns.
    """
    table = read_folders(spark, path, like, day)
    touched = sorted(r[0] for r in altered(table).select(_name(day)).distinct().collect())
    if not touched:
        return []
    new = stored(change(table.filter(_name(day).isin(touched))))
    # Few files a folder, but a large folder is dealt to several tasks.
    writer = new.hint("rebalance", F.col("run"), F.col(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run", day).parquet(path)
    left = {r[0] for r in new.select(_name(day)).distinct().collect()}
    for name in touched:
        if name not in left:
            run, _, date = name.partition("/")
            _delete(spark, f"{path}/{sinks.run_folder(run)}/{day}={date}")
    return touched


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of a table whose rows are all gone, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def set_status(spark: SparkSession, path: str, like: StructType, updates: DataFrame) -> list[str]:
    """Apply status changes `updates(id, status, updated_at)` to a stored results table.

    Folders without a row of a changed id, or with rows that have the wanted status and time already, are not read whole.
    """
    updates = stored(updates)
    wanted = updates.groupBy("id").agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "status")).alias("u"))
    goal = broadcast_if_small(wanted.select("id", F.col("u.status").alias("__status"), F.col("u.updated_at").alias("__at")))
    differs = ~(F.col("status").eqNullSafe(F.col("__status")) & F.col("updated_at").eqNullSafe(F.coalesce("__at", "updated_at")))

    def altered(table: DataFrame) -> DataFrame:
        return table.select("id", "status", "updated_at", "run", "scan_date").join(goal, "id").filter(differs)

    return rewrite(spark, path, like, "scan_date", altered, lambda rows: results.update_status(rows, updates))


def _expire(spark: SparkSession, path: str, like: StructType, day: str, expired: Column) -> list[str]:
    """Drop rows from a stored table; the search for them reads only the columns of the condition."""
    gone = ~F.coalesce(~expired, F.lit(False))
    return rewrite(spark, path, like, day, lambda rows: rows.filter(gone), lambda rows: rows.filter(~gone))


def expire_results(spark: SparkSession, path: str, like: StructType, as_of: datetime) -> list[str]:
    """Drop ignored threats that are too old from a stored results table."""
    return _expire(spark, path, like, "scan_date", results.expired_result(as_of))


def expire_quarantine(spark: SparkSession, path: str, like: StructType, as_of: datetime) -> list[str]:
    """Drop restored quarantine rows that are too old; contents of untouched folders are not read."""
    return _expire(spark, path, like, "quarantine_date", results.expired_quarantine(as_of))


def expire_audit(spark: SparkSession, path: str, like: StructType, as_of: datetime, days: int = audit.AUDIT_KEEP_DAYS) -> list[str]:
    """Drop audit rows older than `days`; the row with their number is written first, by a run named after the time.

    Run again after a stop, it does not count anew: the row of that run is there.
    """
    run = f"cleanup-{as_of:%Y%m%dT%H%M%S%f}"
    table = read_folders(spark, path, like, "event_date")
    old = F.col("created_at") < results.days_before(as_of, days)
    if table.filter(F.col("run") == run).isEmpty():
        noted = audit.cleanup_event(table.filter(old).agg(F.count("*").alias("deleted")), as_of)
        sinks.append_audit(stored(noted.select(*like.fieldNames())), path, run)
    return _expire(spark, path, like, "event_date", old)
