"""Changes of stored tables rewrite only the folders they touch."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from filewarden import schema
from filewarden.sources import rewrite, sinks
from filewarden.streaming import scan as stream_scan


def rows(spark, values):
    """Result rows from (id, day of January, status)."""
    table = spark.createDataFrame(values, "id string, day int, status string")
    at = F.make_timestamp(F.lit(2024), F.lit(1), F.col("day"), F.lit(8), F.lit(0), F.lit(0))
    given = {"id": F.col("id"), "status": F.col("status"), "detected_at": at, "updated_at": at}
    return table.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.SCAN_RESULTS.fields])


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def got(spark, path):
    table = rewrite.read_folders(spark, path, schema.SCAN_RESULTS, "scan_date")
    return sorted((r["run"], r["scan_date"].day if r["scan_date"] else 0, r["id"], r["status"]) for r in table.collect())


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "results")
    sinks.append_scan_results(rows(spark, [("a", 1, "active"), ("b", 1, "ignored"), ("c", 2, "active"), ("d", 3, "ignored")]), path, "one")
    sinks.append_scan_results(rows(spark, [("e", 1, "active"), ("f", 9, "ignored"), ("g", None, "active")]), path, "at 08:00 [x]")
    return path


def changes(spark, values):
    return spark.createDataFrame(values, "id string, status string, updated_at timestamp")


def test_status_changes_touch_their_folders_only(spark, table):
    before, all_rows = files(table), got(spark, table)
    late = datetime(2024, 2, 1)
    wanted = changes(spark, [("a", "ignored", late), ("g", "cleaned", late), ("nowhere", "ignored", late)])
    touched = rewrite.set_status(spark, table, schema.SCAN_RESULTS, wanted)
    assert touched == [f"at 08:00 [x]/{rewrite.NO_DAY}", "one/2024-01-01"]
    after = files(table)
    kept = {f for f in before if "one/scan_date=2024-01-01" not in f and rewrite.NO_DAY not in f}
    assert {f: before[f] for f in kept} == {f: after[f] for f in kept}
    status = {"a": "ignored", "g": "cleaned"}
    assert got(spark, table) == sorted((run, day, i, status.get(i, s)) for run, day, i, s in all_rows)
    assert rewrite.set_status(spark, table, schema.SCAN_RESULTS, wanted) == []
    assert files(table) == after


def test_unknown_status_changes_nothing(spark, table):
    before = files(table)
    with pytest.raises(Exception, match="unknown threat status"):
        rewrite.set_status(spark, table, schema.SCAN_RESULTS, changes(spark, [("a", "odd", None)]))
    assert files(table) == before


def test_expired_rows_go_and_empty_folders_too(spark, table):
    before = files(table)
    assert rewrite.expire_results(spark, table, schema.SCAN_RESULTS, datetime(2024, 2, 4)) == ["one/2024-01-01", "one/2024-01-03"]
    assert {r[2] for r in got(spark, table)} == set("aecfg")
    assert not os.path.exists(f"{table}/run=one/scan_date=2024-01-03")
    assert {f for f in before if "08" in f} <= set(files(table))
    assert rewrite.expire_results(spark, table, schema.SCAN_RESULTS, datetime(2024, 2, 4)) == []


def test_audit_cleanup_is_noted_once(spark, tmp_path):
    path = str(tmp_path / "audit")
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int))")
    log = spark.range(6).select(at.alias("created_at"), F.col("id").cast("string").alias("id"))
    given = {f.name: F.col(f.name) if f.name in log.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.AUDIT_LOG.fields}
    sinks.append_audit(log.select(*given.values()), path, "log")
    for _ in range(2):
        rewrite.expire_audit(spark, path, schema.AUDIT_LOG, datetime(2024, 1, 6), days=3)
    left = rewrite.read_folders(spark, path, schema.AUDIT_LOG, "event_date").collect()
    assert sorted(r["id"] for r in left if r["run"] == "log") == ["2", "3", "4", "5"]
    assert [r["description"] for r in left if r["run"] != "log"] == ["Cleaned up 2 old audit log entries"]


def test_a_batch_reads_the_seen_folders_of_its_prefixes(spark, tmp_path):
    seen = str(tmp_path / "seen")
    keys = spark.range(64).select(F.col("id").cast("string").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("file_hash"))
    own = f"{seen}/run=r/batch=0"
    keys.withColumn("prefix", stream_scan.hash_prefix()).repartition("prefix").write.partitionBy("prefix").parquet(own)
    wanted = keys.filter("path in ('3', '5')")
    found = stream_scan.seen_before(wanted, seen)
    prefixes = {r[0] for r in wanted.select(stream_scan.hash_prefix()).collect()}
    assert {r["prefix"] for r in found.collect()} == prefixes
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [coalesce(prefix" in plan


def test_a_large_folder_is_rewritten_by_several_tasks(spark, table, tmp_path):
    path, limits = str(tmp_path / "large"), {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    many = rows(spark, [(f"{i:05}" * 40, 1, "ignored" if i % 2 else "active") for i in range(4000)]).repartition(4)
    sinks.append_scan_results(many, path, "one")
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        assert rewrite.expire_results(spark, path, schema.SCAN_RESULTS, datetime(2024, 3, 1)) == ["one/2024-01-01"]
    finally:
        for name in limits:
            spark.conf.unset(name)
    assert len(files(path)) > 1
    assert {row[3] for row in got(spark, path)} == {"active"} and len(got(spark, path)) == 2000
