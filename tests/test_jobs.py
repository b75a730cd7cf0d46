"""The end-to-end jobs over a store."""

from datetime import datetime, timedelta


from filewarden.plans.jobs import Store, register_views, run_quarantine, run_restore, run_scan, run_scheduled_scan
from filewarden.settings import ScanSettings

NOW = datetime(2024, 5, 1, 12)
CONTENTS = {"/a.php": "<?php include($_GET['x']); ?>", "/b.php": "fine", "/c.php": "coinhive"}
ALERTS = ScanSettings(email_notifications=True, notification_email="o@x")


def test_scan_quarantine_restore(spark, make_files, tmp_path):
    store, files = Store(str(tmp_path)), make_files(CONTENTS)
    store.create(spark)
    outcome = run_scan(spark, files, "s1", NOW, store).first()
    assert (outcome["total_files"], outcome["scanned_files"], outcome["threats_found"]) == (3, 3, 4)
    register_views(spark, store)
    assert spark.sql("SELECT count(*) AS n FROM scan_results WHERE status = 'active'").first()["n"] == 4
    events = {r["event_type"]: r["n"] for r in spark.sql("SELECT event_type, count(*) AS n FROM audit_log GROUP BY 1").collect()}
    assert events == {"scan_started": 1, "scan_completed": 1, "threat_detected": 4}

    requests = store.read_results(spark).filter("threat_severity = 'critical'").select("id")
    asked = spark.createDataFrame([*requests.collect(), ("nope",)], "id STRING")
    done = run_quarantine(spark, asked, files, NOW + timedelta(hours=1), store, ALERTS)
    assert sorted(r["outcome"] for r in done.outcomes.collect()) == ["ok", "threat_not_found"]
    assert done.alerts.count() == 1
    assert store.read_results(spark).filter("status = 'quarantined'").count() == 1
    assert store.read_quarantine(spark).filter("restored_at IS NULL").count() == 1

    before = [t.count() for t in (store.read_results(spark), store.read_quarantine(spark), store.read_audit(spark))]
    run_scan(spark, files, "s1", NOW, store)
    again = run_quarantine(spark, asked, files, NOW + timedelta(hours=1), store, ALERTS)
    assert sorted(r["outcome"] for r in again.outcomes.collect()) == ["ok", "threat_not_found"]
    assert before == [t.count() for t in (store.read_results(spark), store.read_quarantine(spark), store.read_audit(spark))]

    back = run_restore(spark, spark.createDataFrame([("/a.php",), ("/zzz",)], "path STRING"), NOW + timedelta(hours=2), store)
    assert {(r["path"], r["outcome"], r["content"] and bytes(r["content"]).decode()) for r in back.collect()} == {
        ("/a.php", "ok", CONTENTS["/a.php"]), ("/zzz", "file_not_quarantined", None)}
    assert store.read_quarantine(spark).filter("restored_at IS NULL").count() == 0
    run_restore(spark, spark.createDataFrame([("/a.php",)], "path STRING"), NOW + timedelta(hours=2), store)
    assert store.read_audit(spark).filter("event_type = 'file_restored'").count() == 1
    kinds = {r["event_type"] for r in store.read_audit(spark).select("event_type").distinct().collect()}
    assert {"file_quarantined", "file_restored"} <= kinds

    run = run_scheduled_scan(spark, files, "s2", NOW + timedelta(days=40), store, ALERTS)
    assert run.alerts.count() == 1 and run.retained_results.filter("scan_id = 's1'").count() == 4
    assert run.retained_quarantine.count() == 1
