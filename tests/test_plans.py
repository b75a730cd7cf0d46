"""Plan shapes, skew handling, and the registered queries against SQL."""

import inspect
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from filewarden.operators import integrity, report, scan
from filewarden.plans.oracles import oracle_queries
from filewarden.plans.queries import all_queries
from filewarden.session import broadcast_if_small

SF = "/root/testdata/sf0.001"


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_skew_limits(spark):
    limits = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_hashes(spark):
    """20 000 paths that do not compress, a third of them copies of one content."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    noise = [F.sha2((F.col("id") * 10 + k).cast("string"), 256) for k in range(4)]
    path = F.concat(F.lit("/p/"), F.col("id").cast("string"), F.lit("/"), *noise)
    return spark.range(0, 20000, 1, 8).select(path.alias("path"), F.sha2(hot, 256).alias("sha256"))


def test_hot_content_is_split_in_the_copies_join(spark, small_skew_limits):
    df = integrity.copies(hot_hashes(spark))
    plan = executed_plan(df.select("path", "copies"))
    assert "skew=true" in plan
    assert {r["copies"] for r in df.select("copies").distinct().collect()} == {6667} and df.count() == 6667


def test_hot_content_is_split_in_the_verdict_join(spark, small_skew_limits):
    from filewarden import schema
    from filewarden.operators.verdicts import add_verdicts

    hashes = hot_hashes(spark)
    empty = F.from_json(F.lit("[]"), "ARRAY<STRUCT<rule_ord INT, layer STRING, type STRING, severity STRING, description STRING, confidence DOUBLE, evidence STRING, line_number INT, source STRING>>")
    analysed = hashes.select("path", F.col("sha256").alias("file_hash"), empty.alias("threats"))
    stats = F.struct(*[F.lit(n).alias(f.name) for n, f in zip((9, 1, 1, 1), schema.REPUTATION["stats"].dataType.fields)])
    table = hashes.select("sha256").distinct().select("sha256", stats.alias("stats"))
    out = add_verdicts(analysed, table, gate=False)
    assert "skew=true" in executed_plan(out.select("path", "threats"))
    assert out.filter(F.size("threats") == 1).count() == 20000


def test_hot_scan_is_counted_before_its_group(spark):
    plan = report.scan_summaries(
        spark.range(10).select(
            F.lit("s").alias("scan_id"), F.col("id").cast("string").alias("file_path"), F.lit("t").alias("threat_type"), F.lit("low").alias("threat_severity")
        )
    )
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text and "collect_set" not in text
    assert plan.first()["affected_files"] == 10


def test_broadcast_needs_a_measured_bound(spark, monkeypatch):
    import filewarden.session as session

    monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", 5)
    small, large = spark.range(5), spark.range(6)

    def is_hinted(df):
        return "isBroadcast" in df._jdf.queryExecution().logical().toString() or "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert is_hinted(broadcast_if_small(small)) and not is_hinted(broadcast_if_small(large))


def test_quarantine_does_not_shuffle_the_corpus(spark, make_files):
    from datetime import datetime

    from filewarden.operators import remediate

    files = make_files({f"/{i}": "x" for i in range(50)})
    flagged = spark.createDataFrame([("/1", "r"), ("/gone", "r")], "path STRING, reason STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = remediate.quarantine_rows(flagged, files, datetime(2024, 1, 1))
        assert {(r["file_path"], r["outcome"]) for r in rows.collect()} == {("/1", "ok"), ("/gone", "file_not_found")}
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [path" in plan and "Inner, BuildRight" in plan


def test_filters_do_not_repeat_the_scan_work(spark, make_files):
    df = scan.threats(scan.analyse(make_files({"a": "eval($x)"}))).filter("type = 'suspicious_function'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("decode(content") <= 2 and "Exchange" not in plan


def test_every_query_has_sql():
    """All queries of the library itself; those of the optional subpackage may be tested by brute force instead."""
    assert set(all_queries()) == set(oracle_queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_every_query_takes_a_session_and_a_folder():
    for query in entry_point.queries().values():
        inspect.signature(query).bind(None, SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_runs(spark):
    rows = entry_point.entry(spark).collect()
    assert {r["severity"] for r in rows} == {"critical", "high", "medium", "low"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(
    "name", ["flagged_severities", "scan_threats_low_threshold", "obfuscation_scores", "full_scan_gated", "clean_files", "audit_retention", "posture_rules"]
)
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "events", "customer", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry_point.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(entry_point.oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == expected
