"""Continuous scanning of arriving content."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType

from filewarden.operators.scan import analyse, scan_results
from filewarden.schema import THREAT
from filewarden.session import broadcast_if_small, stored
from filewarden.settings import ScanSettings
from filewarden.sources.catalogue import Rule

ARRIVALS = "path STRING, content BINARY, size BIGINT, mtime TIMESTAMP"


def read_arrivals(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming `files` table over a folder of Parquet files with columns path, content, size, mtime.

    `max_files_per_trigger` bounds the work of one micro-batch: a time budget ends
    between batches, and what is left stays for the next run.
    """
    reader = spark.readStream.schema(ARRIVALS)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def scan_stream(
    arrivals: DataFrame,
    signatures: Sequence[Rule] | None = None,
    settings: ScanSettings = ScanSettings(),
) -> DataFrame:
    """Per-file analysis of a stream: stateless and without a shuffle."""
    return analyse(arrivals, signatures, settings)


def hashed(arrivals: DataFrame) -> DataFrame:
    """(path, file_hash) of each readable arrival and its place, a row of an arrived Parquet file, not yet scanned."""
    place = [F.col("_metadata.file_path").alias("arrival"), F.col("_metadata.row_index").alias("row")]
    return arrivals.filter(F.col("content").isNotNull()).select("path", F.sha2("content", 256).alias("file_hash"), *place)


def place_bitmaps(places: DataFrame) -> DataFrame:
    """The rows of each arrived Parquet file as bitmaps (`arrival`, `bucket`, `bits`): one bit for a place of :func:`hashed`."""
    number = F.col("row") + 1  # buckets begin with 1
    bucket = F.bitmap_bucket_number(number).alias("bucket")
    return places.groupBy("arrival", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def arrivals_at(bitmaps: DataFrame, path: str) -> DataFrame:
    """`files` rows with content at the places of `bitmaps`, from the folder of :func:`read_arrivals`.

    Other Parquet files are not opened. The names of those needed come to the driver, which lists the folder anyway.
    Bitmaps measured to be small are broadcast, so content stays out of the shuffle.
    """
    names = [r[0] for r in bitmaps.select("arrival").distinct().collect()]
    number = F.col("_metadata.row_index") + 1
    files = bitmaps.sparkSession.read.schema(ARRIVALS).parquet(path).filter(F.col("_metadata.file_path").isin(names))
    at = {"arrival": F.col("_metadata.file_path"), "bucket": F.bitmap_bucket_number(number), "__bit": F.bitmap_bit_position(number)}
    numbered = files.select("*", *[column.alias(name) for name, column in at.items()])
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1
    return numbered.join(broadcast_if_small(bitmaps), ["arrival", "bucket"]).filter(marked).select(*files.columns)


def skip_seen(analysed: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Keep the first arrival of each (path, hash) within the horizon.

    Event time is the time of arrival, the same for a whole micro-batch: no file is late, whatever its modification
    time says. Runs on analysed or :func:`hashed` rows: content has been dropped, so state and shuffle hold only narrow
    rows, and the watermark bounds the state. What was seen longer ago is left to the stored table of
    :func:`write_scan_results`.
    """
    arrived = analysed.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", horizon)
    return arrived.dropDuplicatesWithinWatermark(["path", "file_hash"]).drop("__arrived")


SEEN = "path STRING, file_hash STRING"
PROGRESS = "run STRING, batch BIGINT, files BIGINT, threats BIGINT, seconds DOUBLE"
OUT_OF_TIME = "the time budget of the run is used up"


def hash_prefix() -> Column:
    """The folder of a hash in the table of seen files: its first two digits, so 256 folders at most."""
    return F.coalesce(F.substring("file_hash", 1, 2), F.lit(""))


def seen_before(batch: DataFrame, seen_path: str) -> DataFrame:
    """Rows of the table of seen files that can meet a batch: only folders of its hash prefixes are read.

    The prefixes, 256 at most, are the only values that come to the driver.
    """
    spark = batch.sparkSession
    needed = [r[0] for r in batch.select(hash_prefix()).distinct().collect()]
    prefix = F.coalesce("prefix", F.lit(""))
    return spark.read.schema(f"{SEEN}, run STRING, batch BIGINT, prefix STRING").parquet(seen_path).filter(prefix.isin(needed))


class Budget:
    """Seconds that a run may take; asked between batches only."""

    def __init__(self, seconds: float):
        self.end = time.monotonic() + seconds

    def check(self) -> None:
        if time.monotonic() >= self.end:
            raise TimeoutError(OUT_OF_TIME)


def write_scan_results(
    analysed: DataFrame,
    results_path: str,
    checkpoint: str,
    run: str = "stream",
    seen_path: str | None = None,
    progress_path: str | None = None,
    budget: Budget | None = None,
    arrivals_path: str | None = None,
    scan: Callable[[DataFrame], DataFrame] = scan_stream,
) -> StreamingQuery:
    """Write threat rows batch by batch and stop when everything that had arrived is scanned.

    Each batch owns a folder below `run`, so a batch replayed after a failure replaces its own rows. A new checkpoint
    needs a new `run` name. Rows are dated with the time at which their batch began. With `seen_path`, files whose
    (path, hash) an earlier batch stored there are skipped by an anti join, and a batch adds its own, in folders by hash
    prefix: a batch reads only the folders of its own prefixes.

    With `arrivals_path`, the folder of :func:`read_arrivals`, the rows are those of :func:`hashed`: only what is left of
    a batch is read again there and scanned by `scan`; a batch of which nothing is left is not scanned at all. A file
    that is gone by then is an error, and its batch is not noted as seen.

    With `progress_path`, every finished batch leaves one row there, counted while its rows pass by. With a `budget`, a
    batch that would begin too late does not begin: the query ends there, and the next run with this checkpoint starts
    with that batch, whole.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"run={run}/batch={batch_id}"
        if budget is not None:
            budget.check()
        at, began = time.monotonic(), F.lit(datetime.now(UTC)).cast("timestamp")
        if seen_path is not None:
            batch = batch.persist()
            batch.limit(0).select("path", "file_hash").write.mode("append").parquet(seen_path)
            other = (F.col("run") != run) | (F.col("batch") != batch_id)
            earlier = seen_before(batch, seen_path).filter(other).select("path", "file_hash")
            fresh = batch.join(earlier, ["path", "file_hash"], "left_anti").select(*batch.columns)
        else:
            fresh = batch
        if arrivals_path is not None:
            places = stored(place_bitmaps(fresh))
            left = places.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]
            nothing = batch.limit(0).select("path", "file_hash", F.lit(None).cast(ArrayType(THREAT)).alias("threats"))
            fresh = scan(arrivals_at(places, arrivals_path)) if left else nothing
        counted = Observation()
        fresh = fresh.observe(
            counted, F.count("*").alias("files"), F.coalesce(F.sum(F.size("threats")), F.lit(0)).cast("bigint").alias("threats")
        )
        scan_results(fresh, f"{run}_{batch_id}", began).write.mode("overwrite").parquet(f"{results_path}/{own}")
        if arrivals_path is not None and counted.get["files"] < left:
            raise FileNotFoundError(f"{left} arrivals to scan, {counted.get['files']} found in {arrivals_path}")
        if seen_path is not None:
            keys = batch.select("path", "file_hash", hash_prefix().alias("prefix")).repartition("prefix")
            keys.write.mode("overwrite").partitionBy("prefix").parquet(f"{seen_path}/{own}")
            batch.unpersist()
        if progress_path is not None:
            done = counted.get
            row = (run, batch_id, done["files"], done["threats"], time.monotonic() - at)
            spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{progress_path}/{own}")

    return (
        analysed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_results(spark: SparkSession, results_path: str) -> DataFrame:
    """Threat rows of all runs."""
    return spark.read.parquet(results_path).drop("run", "batch")


def stream_progress(query: StreamingQuery) -> list[dict]:
    """Rows and rates of the recent micro-batches, as reported by Spark."""
    return [
        {
            "batch_id": p["batchId"],
            "input_rows": p["numInputRows"],
            "rows_per_second": p["processedRowsPerSecond"],
            "timestamp": p["timestamp"],
        }
        for p in query.recentProgress
    ]


def read_progress(spark: SparkSession, progress_path: str) -> DataFrame:
    """One row per finished batch of all runs."""
    return spark.read.schema(PROGRESS).parquet(progress_path)


def run_within(query: StreamingQuery) -> str:
    """Wait for a run; `completed`, or `partial` if its budget ended it between two batches."""
    try:
        query.awaitTermination()
    except StreamingQueryException as stopped:
        if OUT_OF_TIME not in str(stopped):
            raise
        return "partial"
    return "completed"
