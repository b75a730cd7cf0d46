"""Integrity checks between content snapshots, and repeated content."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewarden.functions.text import dirname
from filewarden.operators.results import as_timestamp
from filewarden.sources.files import content_hashes


def snapshot(files: DataFrame, as_of: datetime) -> DataFrame:
    """A `baseline` table of the current contents."""
    return content_hashes(files).withColumn("snapshot_at", as_timestamp(as_of))


def latest_baseline(baseline: DataFrame) -> DataFrame:
    """Newest expected hash per path."""
    return baseline.groupBy("path").agg(F.max_by("sha256", F.struct("snapshot_at", "sha256")).alias("sha256"))


def verify(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Expected against current hash for every baseline path; a missing file fails."""
    now = current.select("path", F.col("sha256").alias("current_sha256"))
    return (
        baseline.select("path", F.col("sha256").alias("expected_sha256"))
        .join(now, "path", "left")
        .select(
            "path",
            "expected_sha256",
            "current_sha256",
            F.coalesce(F.col("current_sha256") == F.col("expected_sha256"), F.lit(False)).alias("intact"),
        )
    )


def diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """added / removed / modified / unchanged for every path of either snapshot."""
    old = baseline.select("path", F.col("sha256").alias("old_sha256"))
    new = current.select("path", F.col("sha256").alias("new_sha256"))
    change = (
        F.when(F.col("old_sha256").isNull(), "added")
        .when(F.col("new_sha256").isNull(), "removed")
        .when(F.col("old_sha256") != F.col("new_sha256"), "modified")
        .otherwise("unchanged")
    )
    return old.join(new, "path", "full_outer").select("path", "old_sha256", "new_sha256", change.alias("change"))


def delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Current rows whose (path, hash) is not in the baseline: new or changed content."""
    return current.join(baseline.select("path", "sha256"), ["path", "sha256"], "left_anti")


def repeated_contents(hashes: DataFrame) -> DataFrame:
    """Contents that occur at more than one path.

    Counts and the first path are partial aggregates, so a content with very
    many copies shrinks to one row per task before the shuffle.
    """
    return (
        hashes.groupBy("sha256")
        .agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))
        .filter("copies > 1")
    )


def repeated_across_folders(hashes: DataFrame) -> DataFrame:
    """Number of distinct folders per repeated content (two-level count, no set is collected)."""
    per_folder = hashes.groupBy("sha256", dirname(F.col("path")).alias("folder")).agg(F.count("*").alias("n"))
    return (
        per_folder.groupBy("sha256")
        .agg(F.sum("n").alias("copies"), F.count("*").alias("folders"))
        .filter("copies > 1")
    )


def copies(hashes: DataFrame) -> DataFrame:
    """Every path of a repeated content, with the number of copies.

    The counted side is keyed by (prefix, hash) so that the join exchanges it again;
    adaptive execution can then split a hot hash on the path side.
    """
    counted = (
        hashes.groupBy(F.substring("sha256", 1, 2).alias("prefix"), "sha256")
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("sha256", "copies")
    )
    return hashes.select("path", "sha256").join(counted, "sha256").select("path", "sha256", "copies")
