"""Session helpers: recommended settings and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is only broadcast after it was measured to stay under both bounds.
BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 16 * 1024 * 1024


def builder(app_name: str = "filewarden") -> SparkSession.Builder:
    """A session builder with the settings the jobs are written for."""
    return (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, if any."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables, in the folder that the cluster names in `spark.checkpoint.dir`.

    Only a session in local mode, where every task runs on this machine, may leave it unset; a cluster without
    it is an error, because its executors cannot see each other's local files.
    """
    shared = checkpoint_dir(spark)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"/tmp/filewarden-{spark.sparkContext.applicationId}"
    return f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back; cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast when `df` is measured to be small; else leave the join to Spark.

    The measurement reads at most ``BROADCAST_MAX_ROWS + 1`` rows of `df`, so it
    stays cheap when the answer is no. Nothing is dropped either way.
    """
    width = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)).cast("long")
    size = (
        df.limit(BROADCAST_MAX_ROWS + 1)
        .select(width.alias("width"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("width"), F.lit(0)).alias("bytes"))
        .first()
    )
    small = size["n"] <= BROADCAST_MAX_ROWS and size["bytes"] <= BROADCAST_MAX_BYTES
    return F.broadcast(df) if small else df
