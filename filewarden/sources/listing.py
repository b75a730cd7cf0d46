"""File trees by their listing: what changed is decided before any file is opened.

A listing has a path, a size and a modification time per file and comes from the file system alone. It is joined with the
listing of an earlier scan; only files that are new or differ are opened, by the tasks that scan them, and each file
gives a row whether or not it could be read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import ceil

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewarden.settings import ScanSettings
from filewarden.sources.files import tree_scans

TASK_BYTES = 128 << 20
BATCH_BYTES = 32 << 20
WHOLE_BYTES = 1 << 30
READ = "path string, content binary, size bigint, mtime timestamp, problem string"


def list_tree(spark: SparkSession, settings: ScanSettings) -> DataFrame:
    """(path, size, mtime) of the files a scan would read. No content is asked for, so no file is opened."""
    return reduce(DataFrame.unionByName, tree_scans(spark, settings)).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )


def changes(listing: DataFrame, baseline: DataFrame) -> DataFrame:
    """(path, size, mtime, change): added / removed / modified / unchanged, by size and time, for every path of either.

    `size` and `mtime` are those of `listing`, or of `baseline` for removed files. An unknown size or time equals an
    unknown one only.
    """
    now, old = listing.select("path", "size", "mtime").alias("now"), baseline.select("path", "size", "mtime").alias("old")
    same = F.col("now.size").eqNullSafe(F.col("old.size")) & F.col("now.mtime").eqNullSafe(F.col("old.mtime"))
    change = (
        F.when(F.col("old.path").isNull(), "added")
        .when(F.col("now.path").isNull(), "removed")
        .when(same, "unchanged")
        .otherwise("modified")
    )
    which = lambda name: F.when(F.col("now.path").isNull(), F.col(f"old.{name}")).otherwise(F.col(f"now.{name}")).alias(name)
    return now.join(old, F.col("now.path") == F.col("old.path"), "full_outer").select(
        F.coalesce("now.path", "old.path").alias("path"), which("size"), which("mtime"), change.alias("change")
    )


def to_read(listing: DataFrame, baseline: DataFrame) -> DataFrame:
    """The rows of `listing` that are new or differ: an anti join of narrow rows."""
    known = baseline.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    same = (
        (listing["path"] == known["path"])
        & listing["size"].eqNullSafe(known["old_size"])
        & listing["mtime"].eqNullSafe(known["old_mtime"])
    )
    return listing.join(known, same, "left_anti").select("path", "size", "mtime")


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a listed path, and the path on it."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/]*))?(/.*)", path)
    if not found or found[1] == "file":
        return fs.LocalFileSystem(), found[3] if found else path
    system, _ = fs.FileSystem.from_uri(f"{found[1]}://{found[2] or ''}/")
    return system, found[3] if found[1] in ("hdfs", "viewfs") else f"{found[2]}{found[3]}"


def read_listed(listing: DataFrame, whole_bytes: int = WHOLE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """A `files` table of the listed files, with a `problem` where the content is null.

    Files are dealt to tasks of about `task_bytes` each. A file above `whole_bytes`, which no row can hold, is a row
    with the problem `too_large`; one that vanished or cannot be opened is `unreadable`. Nothing is left out silently.
    """
    total = listing.agg(F.sum("size")).first()[0] or 0
    dealt = listing.select("path", "size", "mtime").repartition(max(1, ceil(total / task_bytes)), "path")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            start, contents, problems, held = 0, [], [], 0
            paths, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (path, size) in enumerate(zip(paths, sizes)):
                content, problem = _content(path, size, whole_bytes)
                contents.append(content)
                problems.append(problem)
                held += len(content or b"")
                if held >= BATCH_BYTES or i + 1 == len(paths):
                    own = batch.slice(start, len(contents))
                    columns = [own.column(0), pa.array(contents, pa.binary()), own.column(1), own.column(2), pa.array(problems, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "content", "size", "mtime", "problem"])
                    start, contents, problems, held = i + 1, [], [], 0

    return dealt.mapInArrow(run, READ)


def _content(path: str, size: int | None, whole_bytes: int) -> tuple[bytes | None, str | None]:
    if size is not None and size > whole_bytes:
        return None, "too_large"
    try:
        system, at = _file_system(path)
        with system.open_input_file(at) as file:
            return (None, "too_large") if file.size() > whole_bytes else (file.read(), None)
    except (OSError, pa.ArrowException):
        return None, "unreadable"
