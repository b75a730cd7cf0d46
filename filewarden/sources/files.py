"""Content sources: directory trees and tables with a text or binary column."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewarden.functions import bytestring as bs
from filewarden.functions.text import dirname, extension, uri_path
from filewarden.settings import ScanSettings

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?")


def _root_path(root: str) -> str:
    return _SCHEME.sub("", root).rstrip("/")


def not_excluded(path: Column, excluded_dirs: Sequence[str]) -> Column:
    """No excluded text occurs in the directory part (a file of that name is not excluded)."""
    directory = dirname(path)
    return reduce(lambda a, b: a & b, [~F.contains(directory, F.lit(x)) for x in excluded_dirs], F.lit(True))


def allowed_extension(path: Column, extensions: Sequence[str]) -> Column:
    return F.lower(extension(path)).isin(*[e for e in extensions])


def path_depth(path: Column) -> Column:
    """Number of slashes of the path without scheme and authority."""
    return F.size(F.split(uri_path(path), "/")) - 1


def selected(path: Column, size: Column, settings: ScanSettings) -> Column:
    """Path and size predicate of a scan (everything except the depth limit)."""
    wanted = not_excluded(uri_path(path), settings.excluded_dirs) & allowed_extension(path, settings.file_extensions)
    return wanted if settings.max_file_size is None else wanted & (size <= settings.max_file_size)


def select_files(files: DataFrame, settings: ScanSettings = ScanSettings(), root: str = "/") -> DataFrame:
    """Rows of a `files` table that a scan from `root` would read."""
    wanted = selected(F.col("path"), F.col("size"), settings)
    return files.filter(wanted & (path_depth(F.col("path")) <= _deepest(root, settings.max_depth)))


def skipped_files(files: DataFrame, settings: ScanSettings = ScanSettings(), root: str = "/") -> DataFrame:
    """(path, size, reason) of the rows that a scan from `root` leaves out: the complement of :func:`select_files`."""
    path = F.col("path")
    reason = (
        F.when(F.col("content").isNull(), "unreadable")
        .when(~not_excluded(uri_path(path), settings.excluded_dirs), "excluded_folder")
        .when(~allowed_extension(path, settings.file_extensions), "extension")
        .when(F.lit(settings.max_file_size is not None) & (F.col("size") > F.lit(settings.max_file_size)), "too_large")
        .when(path_depth(path) > _deepest(root, settings.max_depth), "too_deep")
    )
    return files.select("path", "size", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _deepest(root: str, max_depth: int | None) -> int:
    """Most slashes of a path below a root; practically none without a limit."""
    return 2**31 - 1 if max_depth is None else _root_path(root).count("/") + max_depth + 1


def _depth_windows(roots: Iterable[str], max_depth: int | None) -> list[tuple[str, int, int]]:
    """(root, more slashes than, at most slashes) per root, disjoint for nested roots.

    A root inside another root only has to add what lies too deep for the outer one.
    """
    windows: list[tuple[str, int, int]] = []
    for root in sorted(dict.fromkeys(r.rstrip("/") or "/" for r in roots), key=lambda r: _root_path(r).count("/")):
        path = _root_path(root)
        deepest = _deepest(root, max_depth)
        covered = [high for other, _, high in windows if (path + "/").startswith(_root_path(other) + "/")]
        windows.append((root, max(covered, default=-1), deepest))
    return windows


def tree_scans(spark: SparkSession, settings: ScanSettings) -> list[DataFrame]:
    """One scan per root over disjoint files.

    The predicates are on the file metadata columns, so files that fail them are
    dropped from the listing and never opened. Paths are unique by construction
    (no de-duplication shuffle).
    """
    if not settings.scan_paths:
        raise ValueError("no scan paths")
    path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    return [
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
        .load(root)
        .filter(
            selected(path, size, settings) & (path_depth(path) > above) & (path_depth(path) <= deepest)
        )
        for root, above, deepest in _depth_windows(settings.scan_paths, settings.max_depth)
    ]


def read_tree(spark: SparkSession, settings: ScanSettings) -> DataFrame:
    """Files below the scan paths as a `files` table, each path once.

    Files that vanish or cannot be read are skipped; `listing.read_listed` reports them, and files that no row can
    hold, as rows.
    """
    return reduce(DataFrame.unionByName, tree_scans(spark, settings)).select(
        "path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )


def files_from_text(table: DataFrame, path: Column, text: Column, mtime: Column | None = None) -> DataFrame:
    """A `files` table from a table with a text column (bytes are its UTF-8 encoding)."""
    return _as_files(table, path, bs.text_bytes(text), mtime)


def files_from_binary(table: DataFrame, path: Column, content: Column, mtime: Column | None = None) -> DataFrame:
    return _as_files(table, path, content, mtime)


def _as_files(table: DataFrame, path: Column, content: Column, mtime: Column | None) -> DataFrame:
    at = F.lit(None) if mtime is None else mtime
    return table.select(
        path.alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("bigint").alias("size"),
        at.cast("timestamp").alias("mtime"),
    )


def content_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of every readable file."""
    return files.filter(F.col("content").isNotNull()).select("path", F.sha2("content", 256).alias("sha256"))
