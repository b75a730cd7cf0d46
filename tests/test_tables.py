"""Verdicts, integrity, results, reports, config, audit, posture, protection, remediation."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from filewarden import schema
from filewarden.functions.severity import confidence_percent, entropy_band, obfuscation_band, stored_confidence, triage_priority
from filewarden.functions.text import client_ip, sanitize_text, split_list, version_key
from filewarden.operators import audit, config, integrity, posture, protect, remediate, report, results, scan, verdicts
from filewarden.settings import ScanSettings

NOW = datetime(2024, 5, 1, 12)
KEY = b"k" * 32


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def results_df(spark, rows):
    """rows: (id, scan, path, type, severity, confidence, status, detected_at)."""
    full = [(i, s, p, "h", t, sev, "d", None, st, at, at) for i, s, p, t, sev, _, st, at in rows]
    conf = {r[0]: r[5] for r in rows}
    df = spark.createDataFrame(full, schema.SCAN_RESULTS)
    lookup = F.create_map(*[F.lit(x) for kv in conf.items() for x in kv])
    return df.withColumn("confidence_score", lookup[F.col("id")].cast("decimal(3,2)"))


def test_bands_and_priorities(spark):
    assert [one(spark, entropy_band(F.lit(x))) for x in (3.9, 4.0, 6.5, 7.2, 7.6)] == [
        "structured", "normal", "monitor", "warning", "alert"]
    assert [one(spark, obfuscation_band(F.lit(x))) for x in (0.1, 0.3, 0.6, 0.8)] == ["none", "low", "medium", "alert"]
    cases = [("critical", 0.9, 1), ("critical", 0.8, 2), ("high", 0.9, 3), ("high", 0.5, 4), ("medium", 0.8, 5), ("medium", 0.7, 6), ("low", 1.0, 7)]
    for severity, confidence, priority in cases:
        assert one(spark, triage_priority(F.lit(severity), F.lit(confidence))) == priority
    assert str(one(spark, stored_confidence(F.lit(0.125)))) == "0.13"
    assert [one(spark, confidence_percent(F.lit(x))) for x in (0.9, 0.95, 0.8)] == [90, 95, 80]


def test_reputation(spark, make_files):
    stats = {"a": (15, 50, 3, 2), "b": (40, 20, 5, 5), "c": (0, 70, 0, 0), "d": (3, 3, 0, 0), "e": (2, 1, 0, 0)}
    files = make_files({p: p for p in stats})
    hashes = {r["path"]: r["h"] for r in files.select("path", F.sha2("content", 256).alias("h")).collect()}
    table = spark.createDataFrame([(hashes[p], s) for p, s in stats.items()], schema.REPUTATION)
    twice = table.unionByName(table)
    ungated = ScanSettings(gate_verdicts=False)
    got = scan.threats(scan.analyse(files, settings=ungated, reputation=twice)).collect()
    assert {(r["path"], r["severity"], round(r["confidence"], 3), r["source"]) for r in got} == {
        ("b", "critical", 0.857, "VirusTotal"), ("d", "high", 0.75, "VirusTotal"), ("e", "medium", 1.0, "VirusTotal")}
    assert scan.threats(scan.analyse(files, reputation=table)).count() == 0
    queue = verdicts.submission_queue(make_files({"a": "a", "new": "new", "big": "x" * 650000}), table)
    assert sorted(r["path"] for r in queue.collect()) == ["big", "new"]
    limited = verdicts.submission_queue(make_files({"new": "new", "big": "x" * 650000}), table, below=650_000)
    assert [r["path"] for r in limited.collect()] == ["new"]


def test_model_verdicts(spark, make_files):
    answers = {
        "high": '{"analysis":{"is_malicious":true,"risk_level":"HIGH","confidence":95,"description":"d","evidence":"e","threat_types":["x"]}}',
        "unknown": '{"analysis":{"is_malicious":true,"risk_level":"odd"}}',
        "absent": '{"analysis":{"is_malicious":true}}',
        "clean": '{"analysis":{"is_malicious":false,"confidence":99}}',
        "broken": "{oops",
    }
    files = make_files({p: p for p in answers})
    hashes = {r["path"]: r["h"] for r in files.select("path", F.sha2("content", 256).alias("h")).collect()}
    table = spark.createDataFrame([(hashes[p], a) for p, a in answers.items()], schema.MODEL_VERDICTS)
    got = scan.threats(scan.analyse(files, settings=ScanSettings(gate_verdicts=False), model_verdicts=table)).collect()
    assert {(r["path"], r["severity"], r["confidence"]) for r in got} == {
        ("high", "high", 0.95), ("unknown", "low", 0.7), ("absent", "medium", 0.7)}


def test_requests_send_every_byte(make_files):
    content = bytes(range(256)) * 40
    sizes = {"/empty.php": 0, "/one.php": 1, "/full.php": 4000, "/over.php": 4001, "/long.php": 10_000}
    files = make_files({p: content[:n] for p, n in sizes.items()})
    sent = {}
    for r in verdicts.inference_requests(files).orderBy("path", "chunk").collect():
        sent.setdefault(r["path"], []).append((r["chunk"], r["sample_bytes"]))
        assert " php file" in r["prompt"]
    assert sent == {
        "/empty.php": [(0, 0)], "/one.php": [(0, 1)], "/full.php": [(0, 4000)], "/over.php": [(0, 4000), (1, 201)],
        "/long.php": [(0, 4000), (1, 4000), (2, 2400)]}


def test_chunk_verdicts_fold_to_the_gravest(spark):
    answer = lambda bad, level, sure: f'{{"analysis":{{"is_malicious":{bad},"risk_level":"{level}","confidence":{sure}}}}}'
    said = [("a", 0, answer("false", "critical", 99)), ("a", 1, answer("true", "low", 5)), ("a", 2, answer("true", "high", 5)),
            ("a", 3, "no json"), ("b", 0, "no json"), ("b", 1, None)]
    folded = verdicts.fold_verdicts(spark.createDataFrame(said, "sha256 STRING, chunk INT, response STRING"))
    got = {r["sha256"]: r["response"] for r in folded.collect()}
    assert got["a"] == said[2][2] and got["b"] == "no json"


def test_integrity(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path STRING, sha256 STRING")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path STRING, sha256 STRING")
    assert {(r["path"], r["intact"]) for r in integrity.verify(old, new).collect()} == {("a", True), ("b", False), ("c", False)}
    assert {(r["path"], r["change"]) for r in integrity.diff(old, new).collect()} == {
        ("a", "unchanged"), ("b", "modified"), ("c", "removed"), ("d", "added")}
    assert {r["path"] for r in integrity.delta(old, new).collect()} == {"b", "d"}
    base = old.withColumn("snapshot_at", F.lit("2024-01-01").cast("timestamp"))
    later = base.select("path", F.lit("z").alias("sha256"), F.lit("2024-01-02").cast("timestamp").alias("snapshot_at"))
    assert {r["sha256"] for r in integrity.latest_baseline(base.unionByName(later)).collect()} == {"z"}


def test_summary_and_statistics(spark):
    at = NOW - timedelta(days=1)
    rows = [
        ("1", "s", "/file1.php", "malware", "critical", 0.9, "active", at),
        ("2", "s", "/file2.php", "suspicious", "high", 0.8, "active", at),
        ("3", "s", "/file3.php", "malware", "medium", 0.7, "active", at),
        ("4", "s", "/file1.php", "backdoor", "critical", 0.95, "ignored", at),
        ("5", "old", "/file9.php", "malware", "low", 0.6, "active", NOW - timedelta(days=8)),
    ]
    df = results_df(spark, rows)
    s = report.scan_summary(df, "s").first()
    assert (s["total_threats"], s["critical_threats"], s["high_threats"], s["medium_threats"], s["low_threats"]) == (4, 2, 1, 1, 0)
    assert s["threat_types"] == {"malware": 2, "suspicious": 1, "backdoor": 1} and s["affected_files"] == 3
    st = report.threat_statistics(df, NOW).first()
    assert (st["total_threats"], st["critical_threats"], st["low_threats"], st["recent_scans"]) == (4, 1, 1, 1)
    assert report.site_status(report.threat_statistics(df, NOW)).first()["site_status"] == "critical"
    assert [r["id"] for r in results.recent_threats(df).collect()] == ["1", "2", "3", "4", "5"]
    assert [r["id"] for r in results.filter_results(df, status="ignored").collect()] == ["4"]


def test_status_and_retention(spark):
    rows = [
        ("1", "s", "/a", "t", "high", 0.9, "active", NOW),
        ("2", "s", "/b", "t", "high", 0.9, "ignored", NOW - timedelta(days=30)),
        ("3", "s", "/c", "t", "high", 0.9, "ignored", NOW - timedelta(days=30, seconds=1)),
        ("4", "s", "/d", "t", "high", 0.9, "active", NOW - timedelta(days=99)),
    ]
    df = results_df(spark, rows)
    assert {r["id"] for r in results.retain_results(df, NOW).collect()} == {"1", "2", "4"}
    changes = spark.createDataFrame(
        [("1", "ignored", NOW), ("1", "quarantined", NOW + timedelta(1)), ("9", "cleaned", NOW)],
        "id STRING, status STRING, updated_at TIMESTAMP",
    )
    after = {r["id"]: r["status"] for r in results.update_status(df, changes).collect()}
    assert after == {"1": "quarantined", "2": "ignored", "3": "ignored", "4": "active"}
    bad = spark.createDataFrame([("1", "gone", NOW)], "id STRING, status STRING, updated_at TIMESTAMP")
    with pytest.raises(Exception, match="unknown threat status"):
        results.update_status(df, bad).collect()


def test_progress(spark):
    manifest = spark.createDataFrame([("s", str(i), NOW - timedelta(seconds=30)) for i in range(3)], schema.MANIFEST)
    scanned = spark.createDataFrame([("s", "0"), ("s", "0")], "scan_id STRING, path STRING")
    r = report.progress(manifest, scanned, NOW).first()
    assert (r["total_files"], r["scanned_files"], r["percentage"], r["elapsed_time"], r["estimated_time"]) == (3, 1, 33.33, 30, 60)


def test_config(spark):
    old = config.config_rows(spark, {"a": {"x": [1, 2]}, "b": 1}, NOW)
    merged = config.save_config(old, config.config_rows(spark, {"b": 2, "c": None}, NOW))
    assert config.get_value(merged, "a") == {"x": [1, 2]} and config.get_value(merged, "b") == 2
    assert config.get_value(merged, "zzz", 7) == 7 and merged.count() == 3
    wanted = spark.createDataFrame([("b", "0"), ("q", "5")], "config_key STRING, default_value STRING")
    assert {tuple(r) for r in config.get_config(merged, wanted).collect()} == {("b", "2"), ("q", "5")}
    assert config.signature_update_row(spark, NOW).first()["config_key"] == "last_signature_update"


def audit_df(spark, rows):
    return spark.createDataFrame([(i, t, "d", s, u, None, None, at) for i, t, s, u, at in rows], schema.AUDIT_LOG)


def test_audit_pages_statistics_and_retention(spark):
    times = [NOW, NOW, NOW - timedelta(hours=24), NOW - timedelta(days=7), NOW - timedelta(days=90), NOW - timedelta(days=91)]
    log = audit_df(spark, [(str(i), "e" if i % 2 else "f", "info", i, at) for i, at in enumerate(times)])
    assert [r["id"] for r in audit.audit_page(log, 2, 1).collect()] == ["1", "2"]
    assert [r["id"] for r in audit.audit_page(log, 2, 0, "asc").collect()] == ["5", "4"]
    assert audit.audit_page(log, 10, 99).count() == 0
    s = audit.audit_statistics(log, NOW).first()
    assert (s["total_events"], s["last_24h"], s["last_7d"], s["info_events"]) == (6, 3, 4, 6)
    assert audit.filter_audit(log, date_from=times[3], date_to=times[2]).count() == 2
    assert audit.filter_audit(log, event_type="e", user_id=3).count() == 1
    kept = audit.retain_audit(log, NOW).collect()
    assert len(kept) == 6 and [r["description"] for r in kept if r["event_type"] == "audit_cleanup"] == ["Cleaned up 1 old audit log entries"]
    assert audit.retain_audit(log.filter("id < '5'"), NOW).count() == 5
    assert [r["event_type"] for r in audit.top_event_types(log).collect()] == ["e", "f"]


def test_audit_builders(spark):
    at = F.lit(str(NOW)).cast("timestamp")
    scans = spark.createDataFrame([("s1", "full", 3, 0), ("s2", "full", 3, 2)], "scan_id STRING, scan_type STRING, scanned_files INT, threats_found INT")
    done = {r["description"]: (r["severity"], r["metadata"]) for r in audit.scan_completed(scans, at).collect()}
    assert done["Security scan completed (ID: s1)"] == ("info", '{"scan_id":"s1","files_scanned":3,"threats_found":0}')
    assert done["Security scan completed (ID: s2)"][0] == "warning"
    assert audit.scan_started(scans, at).first()["event_type"] == "scan_started"
    keys = spark.createDataFrame([("x", True), ("y", False)], "api_name STRING, was_added BOOLEAN")
    assert {r["description"] for r in audit.api_key_changed(keys, at).collect()} == {"x API key configured", "y API key removed"}
    changed = spark.range(1).select(F.create_map(F.lit("k"), F.lit("secret")).alias("settings"))
    assert audit.settings_changed(changed, at).first()["metadata"] == '{"changed_fields":["k"]}'


@pytest.mark.parametrize(
    "client, forwarded, remote, expected",
    [
        ("1.2.3.4", None, None, "1.2.3.4"),
        ("", " 2001:db8::1 , 1.2.3.4", "5.6.7.8", "2001:db8::1"),
        (None, "bad, 1.2.3.4", "5.6.7.8", "unknown"),
        (None, None, "::ffff:1.2.3.4", "::ffff:1.2.3.4"),
        ("256.1.1.1", None, "5.6.7.8", "unknown"),
        ("01.1.1.1", None, None, "unknown"),
        (None, None, None, "unknown"),
        ("::", None, None, "::"),
        ("1:2:3:4:5:6:7::", None, None, "1:2:3:4:5:6:7::"),
        ("1:2:3:4:5:6:7:8:9", None, None, "unknown"),
    ],
)
def test_client_ip(spark, client, forwarded, remote, expected):
    args = [F.lit(x).cast("string") for x in (client, forwarded, remote)]
    assert one(spark, client_ip(*args)) == expected


def test_text_helpers(spark):
    assert one(spark, split_list(F.lit(" a, b ,,c"), ",")) == ["a", "b", "c"]
    assert one(spark, sanitize_text(F.lit(" <b>x</b>\n\t y "))) == "x y"


@pytest.mark.parametrize(
    "older, newer",
    [("6.9", "6.10"), ("6.4", "6.4.0"), ("6.5-beta1", "6.5"), ("6.5-alpha", "6.5-beta"), ("6.5-RC1", "6.5"), ("6.5", "6.5-pl1"), ("5.9.9", "6.0"), ("6.5-beta2", "6.5-beta10")],
)
def test_version_order(spark, older, newer):
    assert one(spark, version_key(F.lit(older)) < version_key(F.lit(newer))) is True
    assert one(spark, version_key(F.lit(newer)) < version_key(F.lit(older))) is False


def test_posture(spark):
    sites = spark.createDataFrame([("ok", True, False, "6.10"), ("bad", None, None, "6.9"), ("dbg", True, True, "6.10")], schema.SITES)
    got = {(r["site"], r["title"]) for r in posture.recommendations(sites, F.lit("6.10")).collect()}
    assert got == {("bad", "Built-in file editor is on"), ("bad", "Debug output is on"), ("bad", "Core is behind"), ("dbg", "Debug output is on")}


def test_hidden_key_stays_out_of_plans(spark):
    secret = bytes(range(100, 132))
    key = protect.hidden_key(spark, secret)
    sealed = spark.range(3).select(protect.encrypt(F.col("id").cast("string"), key).alias("s"))
    opened = sealed.select(protect.decrypt(F.col("s"), key).alias("v"))
    assert sorted(r["v"] for r in opened.collect()) == ["0", "1", "2"]
    text = opened._jdf.queryExecution().toString() + opened._jdf.queryExecution().executedPlan().toString()
    assert secret.hex() not in text.lower() and "100, 101, 102" not in text


def test_protection(spark):
    df = spark.createDataFrame([("secret é",), ("",), ("0",), (None,)], "v STRING")
    sealed = df.select("v", protect.encrypt(F.col("v"), KEY).alias("s")).cache()
    back = sealed.select("v", "s", protect.decrypt(F.col("s"), KEY).alias("b"), protect.is_encrypted(F.col("s")).alias("e")).collect()
    assert all(r["b"] == r["v"] for r in back)
    assert [r["e"] for r in back] == [True, False, False, False]
    assert sealed.filter("v = 'secret é'").select(protect.decrypt(F.col("s"), b"x" * 32).alias("w")).first()["w"] != "secret é"
    assert one(spark, protect.decrypt(F.lit("plain"), KEY)) == "plain"
    assert one(spark, protect.decrypt(F.lit("enc:%%%"), KEY)) is None
    a, b = (one(spark, protect.encrypt(F.lit("x"), KEY)) for _ in range(2))
    assert a != b


def test_clean(make_files):
    files = make_files({"a": b"keep\neval($x);\n\xff keep", "b": "nothing"})
    got = {r["path"]: r for r in remediate.clean(files, [r"/eval\s*\([^)]*\);?/"], NOW).collect()}
    assert bytes(got["a"]["content"]) == b"keep\n\n\xff keep" and got["a"]["outcome"] == "ok"
    assert bytes(got["a"]["backup_content"]) == b"keep\neval($x);\n\xff keep"
    assert got["a"]["backup_path"].startswith("quarantine/backup_2024-05-01_12-00-00_0cc175b9_a")
    assert got["b"]["outcome"] == "no_changes" and got["b"]["backup_path"] is None


def test_quarantine_and_restore_are_inverse(spark, make_files):
    files = make_files({"/a.php": b"\xffevil", "/b.php": "fine"})
    res = results_df(spark, [("1", "s", "/a.php", "t", "high", 0.9, "active", NOW), ("2", "s", "/gone.php", "t", "high", 0.9, "active", NOW)])
    requests = spark.createDataFrame([("1",), ("2",), ("77",)], "id STRING")
    plan = remediate.quarantine_plan(requests, res, files, NOW, ScanSettings(email_notifications=True, notification_email="o@x"))
    assert {(r["id"], r["outcome"]) for r in plan.outcomes.collect()} == {("1", "ok"), ("2", "file_not_found"), ("77", "threat_not_found")}
    assert [(r["id"], r["status"]) for r in plan.status_updates.collect()] == [("1", "quarantined")]
    assert plan.alerts.count() == 1
    assert remediate.quarantine_size(plan.quarantine).first()["quarantine_bytes"] == 5
    flagged = remediate.flagged_paths(remediate.resolve_requests(requests, res))
    after = remediate.replace_quarantined(files, flagged, NOW)
    body = bytes(after.filter("path = '/a.php'").first()["content"]).decode()
    assert "QUARANTINED FILE" in body and "/a.php" in body
    asked = spark.createDataFrame([("/a.php",), ("/nope",)], "path STRING")
    restored = remediate.restore_rows(asked, plan.quarantine)
    assert {(r["path"], r["outcome"]) for r in restored.collect()} == {("/a.php", "ok"), ("/nope", "file_not_quarantined")}
    back = {r["path"]: bytes(r["content"]) for r in remediate.restore_contents(after, restored, NOW).collect()}
    assert back == {"/a.php": b"\xffevil", "/b.php": b"fine"}
    marked = remediate.mark_restored(plan.quarantine, restored, NOW)
    assert remediate.open_quarantine(marked).count() == 0


def test_restore_takes_the_newest_open_row(spark):
    rows = [(str(i), "/a", bytearray(str(i).encode()), "b", "r", NOW + timedelta(days=i), NOW if i == 3 else None) for i in range(4)]
    restored = remediate.restore_rows(spark.createDataFrame([("/a",)], "path STRING"), spark.createDataFrame(rows, schema.QUARANTINE))
    assert bytes(restored.first()["content"]) == b"2"


def test_quarantine_retention(spark):
    rows = [
        ("1", "/a", None, "b", "r", NOW - timedelta(days=91), NOW),
        ("2", "/a", None, "b", "r", NOW - timedelta(days=90), NOW),
        ("3", "/a", None, "b", "r", NOW - timedelta(days=91), None),
    ]
    kept = results.retain_quarantine(spark.createDataFrame(rows, schema.QUARANTINE), NOW)
    assert {r["id"] for r in kept.collect()} == {"2", "3"}
