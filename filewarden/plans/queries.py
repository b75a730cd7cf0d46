"""Registered queries: every operator over the whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewarden import schema
from filewarden.functions.text import client_ip
from filewarden.operators import (
    admission,
    audit,
    config,
    detect,
    integrity,
    posture,
    protect,
    remediate,
    report,
    results,
    rulebook,
    scan,
    verdicts,
)
from filewarden.plans.corpus import (
    audit_table,
    binary_files,
    calls_table,
    corpus,
    pick,
    plain_files,
    results_table,
    table,
)
from filewarden.session import stored
from filewarden.settings import ScanSettings
from filewarden.sources import catalogue, listing
from filewarden.sources.files import content_hashes, files_from_text, select_files, skipped_files

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime(2024, 1, 31)
ACTION_TIME = datetime(2024, 2, 1, 12, 30)
ADMISSION_WINDOW = 3600
ADMISSION_LIMIT = 2
RATE_WINDOW = 900
PROTECT_KEY = bytes(range(32))
LATEST_VERSION = "6.10.2"
CLEAN_PATTERNS = (r"/eval\s*\([^)]*\)+;?/", r"/<\?php|\?>/", r"/COINHIVE/i")
ALERTS = ScanSettings(
    email_notifications=True,
    notification_email="ops@example.org",
    site_name="demo",
    admin_email="admin@example.org",
    dashboard_url="https://example.org/scans",
)
UNGATED = ScanSettings(gate_verdicts=False)
LOW_THRESHOLD = ScanSettings(confidence_threshold=0.1)
RISK_LEVELS = ("low", "medium", "HIGH", "critical", "weird")


def _when_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("path", "type", "severity", "description", "confidence", "evidence", "line_number")


def _results(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "scan_id",
        "file_path",
        "file_hash",
        "threat_type",
        "threat_severity",
        "threat_description",
        F.col("confidence_score").cast("double").alias("confidence_score"),
        "status",
        _when_text("detected_at"),
        _when_text("updated_at"),
    )


def _threats(df: DataFrame) -> DataFrame:
    return df.select(
        "path", "file_hash", "rank", "type", "severity", "confidence", "evidence", "line_number", "source"
    )


# --- selection and hashes ---------------------------------------------------


def skipped(spark, sf):
    """What a scan with a size and a depth limit leaves out, with the reason."""
    settings = ScanSettings(max_file_size=3000, max_depth=3)
    return skipped_files(corpus(spark, sf), settings).select("path", "size", "reason")


def corpus_select(spark, sf):
    return select_files(corpus(spark, sf)).select("path", "size")


def _listings(spark, sf):
    """Two listings of the corpus: files were added, removed, grown or touched since the first."""
    n, files = F.col("file_no"), corpus(spark, sf).filter("content IS NOT NULL")
    at = F.timestamp_seconds(F.lit(1704067200) + n)
    renamed = lambda every, prefix: F.when(n % every == 0, F.concat(F.lit(prefix), "path")).otherwise(F.col("path")).alias("path")
    baseline = files.select(renamed(17, "/old"), "size", at.alias("mtime"))
    later = F.when(n % 5 == 0, at + F.expr("INTERVAL 1 SECOND")).otherwise(at)
    current = files.select(renamed(13, "/new"), (F.col("size") + F.when(n % 7 == 0, 1).otherwise(0)).alias("size"), later.alias("mtime"))
    return current, baseline


def listing_changes(spark, sf):
    """What a scan decides from two listings, before any content is read."""
    return listing.changes(*_listings(spark, sf)).select("path", "size", _when_text("mtime"), "change")


def listing_to_read(spark, sf):
    return listing.to_read(*_listings(spark, sf)).select("path", "size", _when_text("mtime"))


def content_hash_dups(spark, sf):
    return integrity.repeated_contents(content_hashes(plain_files(spark, sf)))


def content_copies(spark, sf):
    return integrity.copies(content_hashes(plain_files(spark, sf)))


def content_folders(spark, sf):
    documents = table(spark, sf, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "doc_id")
    return integrity.repeated_across_folders(content_hashes(files_from_text(documents, path, F.col("text"))))


# --- detectors --------------------------------------------------------------


def signature_hits(spark, sf):
    return _hits(detect.signature_hits(corpus(spark, sf)))


def function_hits(spark, sf):
    return _hits(detect.function_hits(corpus(spark, sf)))


def heuristic_hits(spark, sf):
    return _hits(detect.heuristic_hits(corpus(spark, sf)))


def pattern_hits(spark, sf):
    return _hits(detect.pattern_hits(corpus(spark, sf)))


def obfuscation_scores(spark, sf):
    return detect.obfuscation_scores(corpus(spark, sf)).select(
        "path",
        *[F.col(c).cast("bigint").alias(c) for c in ("long_runs", "hex_escapes", "decoder_names", "words")],
        "obfuscation_score",
        "obfuscation_band",
        "is_obfuscated",
    )


def behaviour_scores(spark, sf):
    return detect.behaviour_scores(corpus(spark, sf)).select("path", "behaviour_score", "is_malicious")


def byte_entropy(spark, sf):
    scores = detect.entropy_scores(plain_files(spark, sf))
    return scores.select("path", F.round("entropy", 6).alias("entropy"), "entropy_band")


def binary_entropy(spark, sf):
    scores = detect.entropy_scores(binary_files(spark, sf))
    return scores.select(
        "path", F.round("entropy", 6).alias("entropy"), "entropy_band", F.round("alert_confidence", 4).alias("alert_confidence")
    )


def binary_threats(spark, sf):
    """Alerts of the entropy layer in a scan at a threshold that they can reach."""
    found = scan.threats(scan.analyse(binary_files(spark, sf), settings=LOW_THRESHOLD)).filter("type = 'high_entropy'")
    return found.select("path", "file_hash", "severity", F.round("confidence", 4).alias("confidence"), "line_number")


def histogram_entropy(spark, sf):
    scores = detect.histogram_entropy(plain_files(spark, sf))
    return scores.select("path", F.round("entropy", 6).alias("entropy"))


def byte_histogram(spark, sf):
    histogram = detect.byte_histogram(plain_files(spark, sf))
    return histogram.select("path", F.col("byte_value").cast("bigint").alias("byte_value"), "n")


def scan_threats(spark, sf):
    return _threats(scan.threats(scan.analyse(corpus(spark, sf))))


def scan_threats_low_threshold(spark, sf):
    return _threats(scan.threats(scan.analyse(corpus(spark, sf), settings=LOW_THRESHOLD)))


def top_threat(spark, sf):
    top = detect.top_threat(scan.analyse(corpus(spark, sf)))
    return top.select("path", "type", "severity", "confidence", "line_number")


def flagged_severities(spark, sf):
    """Flagship: scan of the selected corpus files, threats and files per severity."""
    found = scan.threats(scan.analyse(select_files(corpus(spark, sf))))
    per_file = found.groupBy("severity", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("severity").agg(F.sum("n").alias("threats"), F.count("*").alias("files"))


# --- verdicts ---------------------------------------------------------------


def reputation_table(spark, sf):
    """Engine counts per content hash, from the labels of the documents."""
    number = F.col("file_no")
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "file_no")
    hashes = (
        corpus(spark, sf)
        .filter(F.col("path").startswith("/site/"))
        .select("file_no", F.sha2("content", 256).alias("sha256"))
    )

    def most(value: Column, name: str) -> Column:
        return F.max(value).cast("int").alias(name)

    return (
        hashes.join(labels, "file_no")
        .groupBy("sha256")
        .agg(
            most(F.col("toxic") * (number % 10), "malicious"),
            most(number % 6, "clean"),
            most(number % 3, "suspicious"),
            most(number % 4, "undetected"),
        )
        .select("sha256", F.struct("malicious", "clean", "suspicious", "undetected").alias("stats"))
    )


def model_table(spark, sf):
    """Model responses per content hash, from the labels of the documents."""
    number = F.col("file_no")
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "file_no")
    hashes = (
        corpus(spark, sf)
        .filter(F.col("path").startswith("/site/"))
        .select("file_no", F.sha2("content", 256).alias("sha256"))
    )
    first = hashes.join(labels, "file_no").groupBy("sha256").agg(
        F.min("file_no").alias("file_no"), F.min_by("quality", "file_no").alias("quality")
    )
    analysis = F.struct(
        (F.col("quality") == 0).alias("is_malicious"),
        F.when(number % 7 != 0, pick(RISK_LEVELS, number)).alias("risk_level"),
        F.when(number % 4 != 0, (50 + number % 50).cast("double")).alias("confidence"),
        F.when(number % 3 != 0, F.concat(F.lit("case "), number)).alias("description"),
    )
    return first.select("sha256", F.to_json(F.struct(analysis.alias("analysis"))).alias("response"))


def reputation_join(spark, sf):
    found = scan.analyse(corpus(spark, sf), settings=UNGATED, reputation=reputation_table(spark, sf))
    return _threats(scan.threats(found)).filter("source IS NOT NULL")


def verdict_join(spark, sf):
    found = scan.analyse(corpus(spark, sf), settings=UNGATED, model_verdicts=model_table(spark, sf))
    threats = scan.threats(found).filter("source IS NOT NULL")
    return threats.select("path", "rank", "type", "severity", "description", "confidence", "evidence", "source")


def full_scan_gated(spark, sf):
    found = scan.analyse(
        corpus(spark, sf), reputation=reputation_table(spark, sf), model_verdicts=model_table(spark, sf)
    )
    return _threats(scan.threats(found))


def request_chunks(spark, sf):
    return verdicts.inference_requests(corpus(spark, sf)).select(
        "path",
        "sha256",
        "file_type",
        F.col("chunk").cast("bigint").alias("chunk"),
        F.col("sample_bytes").cast("bigint").alias("sample_bytes"),
        "sample_md5",
    )


def request_table(spark, sf):
    """Requests per file, with the bytes that they send."""
    return request_chunks(spark, sf).groupBy("path", "sha256", "file_type").agg(
        F.count("*").alias("chunks"), F.sum("sample_bytes").alias("sent_bytes")
    )


def folded_verdicts(spark, sf):
    """Answers to every chunk, by the digest of its bytes, folded to one per content."""
    asked = verdicts.inference_requests(corpus(spark, sf)).select("sha256", "chunk", "sample_md5").distinct()
    number = F.conv(F.substring("sample_md5", 1, 4), 16, 10).cast("int")
    answer = F.format_string(
        '{"analysis":{"is_malicious":%s,"risk_level":"%s","confidence":%d}}',
        F.when(number % 3 == 0, "true").otherwise("false"),
        pick(("low", "medium", "high", "critical"), number),
        number % 100,
    )
    return verdicts.fold_verdicts(asked.withColumn("response", answer))


def submit_queue(spark, sf):
    return verdicts.submission_queue(corpus(spark, sf), reputation_table(spark, sf)).select(
        "path", "sha256", F.col("bytes").cast("bigint").alias("bytes")
    )


# --- integrity --------------------------------------------------------------


def _snapshots(spark, sf):
    """Hashes of all documents and pages before and after: every 13th moves away, every 17th comes, every 7th changes."""
    files = plain_files(spark, sf)
    number = F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint")
    moved = lambda by, folder: F.when(number % by == 0, F.concat(F.lit(folder), "path")).otherwise(F.col("path"))
    edited = F.when(number % 7 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content"))
    before = files.select(moved(17, "/old").alias("path"), "content", "size", "mtime")
    after = files.select(moved(13, "/new").alias("path"), edited.alias("content"), "size", "mtime")
    return integrity.snapshot(before, AS_OF), content_hashes(after)


def integrity_verify(spark, sf):
    baseline, current = _snapshots(spark, sf)
    return integrity.verify(integrity.latest_baseline(baseline), current)


def integrity_diff(spark, sf):
    return integrity.diff(*_snapshots(spark, sf))


def delta_scan(spark, sf):
    return integrity.delta(*_snapshots(spark, sf))


# --- results ----------------------------------------------------------------


def scan_results(spark, sf):
    return _results(results_table(spark, sf))


def triage_queue(spark, sf):
    return results.triage_queue(results_table(spark, sf)).select(
        "id", F.col("priority").cast("bigint").alias("priority"), F.col("confidence_percent").cast("bigint").alias("confidence_percent")
    )


def results_filtered(spark, sf):
    return _results(results.filter_results(results_table(spark, sf), "scan_3", "high", "active"))


def recent_results(spark, sf):
    return _results(results.newest_results(results_table(spark, sf)))


def scan_history(spark, sf):
    return _results(results.history(results_table(spark, sf)))


def recent_threats(spark, sf):
    return _results(results.recent_threats(results_table(spark, sf)))


def threat_stats(spark, sf):
    return report.threat_statistics(results_table(spark, sf), AS_OF)


def site_status(spark, sf):
    return report.site_status(report.threat_statistics(results_table(spark, sf), AS_OF)).select("site_status")


def scan_summary(spark, sf):
    rows = report.scan_summaries(results_table(spark, sf))
    return rows.withColumn("threat_types", F.to_json("threat_types"))


def affected_files(spark, sf):
    return report.affected_files(results_table(spark, sf))


def type_counts(spark, sf):
    return report.type_counts(results_table(spark, sf))


def daily_trend(spark, sf):
    trend = report.daily_trend(results_table(spark, sf))
    return trend.withColumn("day", F.col("day").cast("string"))


def most_affected(spark, sf):
    top = report.most_affected(results_table(spark, sf), 20)
    return top.withColumn("max_confidence", F.col("max_confidence").cast("double"))


def type_severity_rollup(spark, sf):
    return report.type_severity_rollup(results_table(spark, sf))


def _status_changes(table_):
    """Status changes of a third of the ids, and as many of ids that do not exist."""
    number = F.conv(F.substring("id", 1, 2), 16, 10).cast("int")
    changes = table_.select(
        "id",
        F.when(number % 2 == 0, "ignored").otherwise("quarantined").alias("status"),
        results.as_timestamp(ACTION_TIME).alias("updated_at"),
    ).filter(number % 3 == 0)
    unknown = changes.select(F.concat("id", F.lit("x")).alias("id"), "status", "updated_at")
    return changes.unionByName(unknown)


def status_update(spark, sf):
    table_ = stored(results_table(spark, sf))
    return _results(results.update_status(table_, _status_changes(table_)))


def retention_results(spark, sf):
    return _results(results.retain_results(results_table(spark, sf), datetime(2024, 2, 14)))


def scan_progress(spark, sf):
    files = corpus(spark, sf)
    manifest = files.select(
        F.concat(F.lit("scan_"), F.col("file_no") % 5).alias("scan_id"),
        "path",
        results.as_timestamp(datetime(2024, 1, 30, 23, 0)).alias("started_at"),
    )
    done = files.filter(F.col("file_no") % 3 != 0).select(
        F.concat(F.lit("scan_"), F.col("file_no") % 5).alias("scan_id"), "path"
    )
    return report.progress(manifest, done, AS_OF)


def scan_outcome(spark, sf):
    selected = select_files(corpus(spark, sf))
    total = selected.agg(F.count("*")).scalar()
    return report.scan_outcome(scan.analyse(selected), "scan_all", total)


# --- configuration and rules ------------------------------------------------


def _config_table(spark, sf, modulus: int, day: str):
    """All customers as configuration entries; every `modulus`-th has a key of its own day."""
    at = F.to_timestamp(F.lit(day))
    prefix = F.when(F.col("c_custkey") % modulus == 0, "key_").otherwise(f"day{modulus}_")
    return table(spark, sf, "customer").select(
        F.concat(prefix, "c_custkey").alias("config_key"),
        F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit(day).alias("day"))).alias(
            "config_value"
        ),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def config_upsert(spark, sf):
    merged = config.save_config(_config_table(spark, sf, 2, "2024-01-01"), _config_table(spark, sf, 3, "2024-01-02"))
    return merged.select("config_key", "config_value", _when_text("updated_at"))


def config_get(spark, sf):
    wanted = table(spark, sf, "customer").select(
        F.concat(F.lit("key_"), "c_custkey").alias("config_key"), F.lit("{}").alias("default_value")
    )
    return config.get_config(_config_table(spark, sf, 2, "2024-01-01"), wanted)


def latest_per_key(spark, sf):
    newest = results.latest_per_key(audit_table(spark, sf), ["user_id"], ["created_at", "id"])
    return newest.select("user_id", "id", "event_type", _when_text("created_at"))


def _part_rules(spark, sf):
    """Parts as catalogue updates; the first ones replace default signatures."""
    names = [name for name, *_ in catalogue.SIGNATURES]
    key = F.col("p_partkey")
    known = F.element_at(F.array(*[F.lit(n) for n in names]), (key + 1).cast("int"))
    return table(spark, sf, "part").select(
        key.cast("int").alias("rule_ord"),
        F.lit("signature").alias("layer"),
        F.when(key.between(0, len(names) - 1), known).otherwise(F.concat(F.lit("part_"), key)).alias("name"),
        F.concat(F.lit("/"), "p_brand", F.lit("/i")).alias("pattern"),
        F.lit("low").alias("severity"),
        F.col("p_name").alias("description"),
        F.lit(0.9).alias("confidence"),
    )


def rule_merge(spark, sf):
    return catalogue.merge_catalogue(catalogue.default_catalogue(spark), _part_rules(spark, sf)).select(
        F.col("rule_ord").cast("bigint").alias("rule_ord"), "name", "pattern", "severity", "description"
    )


def rule_count(spark, sf):
    return catalogue.rule_count(catalogue.merge_catalogue(catalogue.default_catalogue(spark), _part_rules(spark, sf)))


def _order_files(spark, sf):
    """Orders as files that name their parts."""
    names = F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("Item "), "l_partkey", F.lit(";")))), "\n")
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(names.alias("text"))
    return lists.select(
        F.concat(F.lit("/orders/"), "l_orderkey", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )


def _merged_rules(spark, sf):
    """Default signatures and a rule for every part."""
    updates = _part_rules(spark, sf).withColumn("name", F.concat(F.lit("part_"), "rule_ord"))
    updates = updates.withColumn("pattern", F.concat(F.lit("/item\\s+"), "rule_ord", F.lit(";/i")))
    return catalogue.merge_catalogue(catalogue.default_catalogue(spark), updates)


def merged_rule_scan(spark, sf):
    """All orders and the corpus, scanned with user-made rules; the matches are read again by their place."""
    files = stored(_order_files(spark, sf).unionByName(corpus(spark, sf).select("path", "content")))
    found = rulebook.matched_bytes(files, rulebook.rule_matches(files, _merged_rules(spark, sf)))
    return found.select("path", "name", "severity", "match_length", F.sha2("evidence", 256).alias("evidence_hash"))


def merged_rule_update(spark, sf):
    """The configuration row of the moment at which the merged rules were taken over, and how many they are."""
    rows = config.signature_update_row(spark, datetime(2024, 2, 1))
    counted = catalogue.rule_count(_merged_rules(spark, sf))
    counted = counted.withColumn("config_key", F.lit("last_signature_update"))
    return rows.join(counted, "config_key").select("config_key", "config_value", "rule_count")


# --- audit log --------------------------------------------------------------


def _audit(df: DataFrame) -> DataFrame:
    return df.select("id", "event_type", "description", "severity", "user_id", "metadata", _when_text("created_at"))


def audit_page(spark, sf):
    log = audit.filter_audit(audit_table(spark, sf), event_type="error", date_from=datetime(2024, 1, 5))
    return _audit(audit.audit_page(log, limit=50, offset=25))


def audit_filter(spark, sf):
    log = audit.filter_audit(
        audit_table(spark, sf),
        severity="warning",
        date_from=datetime(2024, 1, 5),
        date_to=datetime(2024, 1, 20, 12),
    )
    return _audit(log)


def audit_stats(spark, sf):
    return audit.audit_statistics(audit_table(spark, sf), AS_OF)


def audit_severities(spark, sf):
    return audit.severity_counts(audit_table(spark, sf))


def top_events(spark, sf):
    return audit.top_event_types(audit_table(spark, sf))


def audit_retention(spark, sf):
    kept = audit.retain_audit(audit_table(spark, sf), datetime(2024, 1, 25), days=10)
    return kept.select("event_type", "description", "severity", "user_id", _when_text("created_at"))


def threat_audit_events(spark, sf):
    events = audit.threat_detected(results_table(spark, sf))
    return events.select("event_type", "description", "severity", "metadata", _when_text("created_at"))


def scan_audit_events(spark, sf):
    outcomes = report.scan_summaries(results_table(spark, sf)).select(
        "scan_id", F.col("affected_files").alias("scanned_files"), F.col("total_threats").alias("threats_found")
    )
    at = results.as_timestamp(ACTION_TIME)
    started = audit.scan_started(outcomes.select("scan_id", F.lit("full").alias("scan_type")), at)
    events = started.unionByName(audit.scan_completed(outcomes, at))
    return events.select("event_type", "description", "severity", "metadata", _when_text("created_at"))


def change_audit_events(spark, sf):
    """Customers as settings and key changes."""
    customers = table(spark, sf, "customer")
    at = results.as_timestamp(ACTION_TIME)
    settings = audit.settings_changed(
        customers.select(
            F.map_from_arrays(
                F.array(F.col("c_name"), F.concat(F.lit("segment_"), "c_mktsegment")), F.array(F.lit("a"), F.lit("b"))
            ).alias("settings")
        ),
        at,
    )
    keys = audit.api_key_changed(
        customers.select(F.col("c_name").alias("api_name"), (F.col("c_acctbal") > 0).alias("was_added")), at
    )
    events = settings.unionByName(keys)
    return events.select("event_type", "description", "severity", "metadata", _when_text("created_at"))


def client_addresses(spark, sf):
    user, event = F.col("user_id"), F.col("event_id")
    address = F.concat_ws(".", F.lit("10"), user % 300, event % 256, F.lit("7"))
    v6 = F.concat(F.lit("2001:db8::"), F.lower(F.hex(event % 65536)))
    client = F.when(event % 5 == 0, address).when(event % 5 == 1, "").when(event % 5 == 2, "bad")
    forwarded = F.when(event % 3 == 0, F.concat(F.lit(" "), v6, F.lit(" , 1.2.3.4"))).when(event % 3 == 1, "bad, 1.2.3.4")
    remote = F.when(event % 2 == 0, v6).otherwise(F.lit("192.168.01.1"))
    return table(spark, sf, "events").select("event_id", client_ip(client, forwarded, remote).alias("user_ip"))


# --- rate limits ------------------------------------------------------------


def rate_window(spark, sf):
    calls = admission.with_trailing_calls(calls_table(spark, sf), RATE_WINDOW)
    return calls.select("call_id", "api", "calls_in_window")


def remaining_calls(spark, sf):
    return admission.remaining_calls(calls_table(spark, sf), datetime(2024, 1, 30, 23, 30), window=7200)


def admission_control(spark, sf):
    decided = admission.admit(
        calls_table(spark, sf), limits={"error": 3}, default=ADMISSION_LIMIT, window=ADMISSION_WINDOW
    )
    return decided.select("call_id", "api", "accepted")


def admission_audit(spark, sf):
    decided = admission.admit(
        calls_table(spark, sf), limits={"error": 3}, default=ADMISSION_LIMIT, window=ADMISSION_WINDOW
    )
    events = audit.rate_limit_exceeded(decided.filter(~F.col("accepted")))
    return events.groupBy("event_type", "description", "severity").agg(F.count("*").alias("n"))


# --- remediation ------------------------------------------------------------


def _flagged(spark, sf):
    """Critical threats as quarantine requests, plus one unknown id per request.

    Requests refer to a stored results table, so the scan is written once.
    """
    found = stored(results_table(spark, sf))
    ids = found.filter("threat_severity = 'critical'").select("id")
    return found, ids.unionByName(ids.select(F.concat("id", F.lit("x")).alias("id")))


def quarantine_outcomes(spark, sf):
    found, requests = _flagged(spark, sf)
    return remediate.quarantine_plan(requests, found, corpus(spark, sf), ACTION_TIME, ALERTS).outcomes


def _quarantine(spark, sf):
    found, requests = _flagged(spark, sf)
    return remediate.quarantine_plan(requests, found, corpus(spark, sf), ACTION_TIME, ALERTS)


def quarantine_rows(spark, sf):
    return _quarantine(spark, sf).quarantine.select(
        "file_path",
        F.sha2("original_content", 256).alias("content_hash"),
        "backup_path",
        "quarantine_reason",
        _when_text("quarantined_at"),
    )


def quarantine_audit(spark, sf):
    events = audit.file_quarantined(_quarantine(spark, sf).quarantine)
    return events.select("event_type", "description", "severity", "metadata", _when_text("created_at"))


def quarantine_status(spark, sf):
    return _quarantine(spark, sf).status_updates.select("id", "status", _when_text("updated_at"))


def quarantine_alerts(spark, sf):
    return _quarantine(spark, sf).alerts


def quarantine_overlay(spark, sf):
    found, requests = _flagged(spark, sf)
    flagged = remediate.flagged_paths(remediate.resolve_requests(requests, found))
    after = remediate.replace_quarantined(corpus(spark, sf), flagged, ACTION_TIME, ALERTS)
    return after.select("path", "size", F.sha2("content", 256).alias("content_hash"))


def quarantine_size(spark, sf):
    return remediate.quarantine_size(_quarantine(spark, sf).quarantine)


def _quarantine_table(spark, sf):
    """Every corpus file quarantined twice, a third of them already restored."""
    files = corpus(spark, sf)

    def rows(copy: int, day: int) -> DataFrame:
        at = results.as_timestamp(datetime(2024, 1, day))
        return files.select(
            F.concat("path", F.lit(f"#{copy}")).alias("id"),
            F.col("path").alias("file_path"),
            F.concat("content", F.encode(F.lit(f"copy {copy}"), "UTF-8")).alias("original_content"),
            F.lit("backup").alias("backup_path"),
            F.lit("test").alias("quarantine_reason"),
            at.alias("quarantined_at"),
            F.when((F.col("file_no") + copy) % 3 == 0, at).alias("restored_at"),
        )

    return rows(1, 3).unionByName(rows(2, 9))


def restore(spark, sf):
    requests = corpus(spark, sf).filter("file_no % 2 = 0").select("path")
    unknown = requests.select(F.concat("path", F.lit(".bak")).alias("path"))
    restored = remediate.restore_rows(requests.unionByName(unknown), _quarantine_table(spark, sf))
    return restored.select("path", "id", F.sha2("content", 256).alias("content_hash"), "outcome")


def restore_marks(spark, sf):
    quarantine = _quarantine_table(spark, sf)
    restored = remediate.restore_rows(corpus(spark, sf).filter("file_no % 2 = 0").select("path"), quarantine)
    marked = remediate.mark_restored(quarantine, restored, ACTION_TIME)
    return marked.select("id", "file_path", _when_text("quarantined_at"), _when_text("restored_at"))


def restore_overlay(spark, sf):
    files = corpus(spark, sf)
    restored = remediate.restore_rows(files.filter("file_no % 2 = 0").select("path"), _quarantine_table(spark, sf))
    after = remediate.restore_contents(files, restored, ACTION_TIME)
    return after.select("path", "size", F.sha2("content", 256).alias("content_hash"))


def restore_audit(spark, sf):
    restored = remediate.restore_rows(corpus(spark, sf).select("path"), _quarantine_table(spark, sf))
    events = audit.file_restored(
        restored.filter("outcome = 'ok'").select(
            F.col("path").alias("file_path"), results.as_timestamp(ACTION_TIME).alias("restored_at")
        )
    )
    return events.select("event_type", "description", "severity", "metadata", _when_text("created_at"))


def open_quarantine(spark, sf):
    opened = remediate.newest_first(remediate.open_quarantine(_quarantine_table(spark, sf)))
    return opened.select("id", "file_path", _when_text("quarantined_at"))


def retention_quarantine(spark, sf):
    kept = results.retain_quarantine(_quarantine_table(spark, sf), datetime(2024, 4, 5))
    return kept.select("id", "file_path", _when_text("quarantined_at"))


def clean_files(spark, sf):
    cleaned = remediate.clean(corpus(spark, sf), CLEAN_PATTERNS, ACTION_TIME)
    return cleaned.select(
        "path",
        "outcome",
        F.sha2("content", 256).alias("content_hash"),
        F.sha2("backup_content", 256).alias("backup_hash"),
        "backup_path",
    )


def clean_status(spark, sf):
    cleaned = remediate.clean(corpus(spark, sf), CLEAN_PATTERNS, ACTION_TIME)
    updates = remediate.cleaned_updates(results_table(spark, sf), cleaned, ACTION_TIME)
    return updates.select("id", "status", _when_text("updated_at"))


def clean_alerts(spark, sf):
    cleaned = remediate.clean(corpus(spark, sf), CLEAN_PATTERNS, ACTION_TIME)
    return remediate.cleaning_alerts(cleaned, len(CLEAN_PATTERNS), ACTION_TIME, ALERTS)


def scan_alerts(spark, sf):
    outcomes = report.scan_summaries(results_table(spark, sf)).select(
        "scan_id", F.col("affected_files").alias("total_files"), F.col("total_threats").alias("threats_found")
    )
    return remediate.scan_alerts(outcomes, ACTION_TIME, ALERTS)


# --- posture and protection -------------------------------------------------


def posture_rules(spark, sf):
    key = F.col("c_custkey")
    sites = table(spark, sf, "customer").select(
        F.col("c_name").alias("site"),
        F.when(key % 3 != 0, key % 3 == 1).alias("disallow_file_edit"),
        F.when(key % 5 != 0, key % 5 == 1).alias("debug"),
        F.concat_ws(".", key % 3 + 5, key % 12, F.when(key % 4 != 0, key % 4)).alias("version"),
    )
    assert set(sites.columns) == set(schema.SITES.fieldNames())
    return posture.recommendations(sites, F.lit(LATEST_VERSION))


def protect_roundtrip(spark, sf):
    key = protect.hidden_key(spark, PROTECT_KEY)
    sealed = table(spark, sf, "documents").select("doc_id", "text", protect.encrypt(F.col("text"), key).alias("sealed"))
    return sealed.select(
        "doc_id",
        protect.is_encrypted(F.col("sealed")).alias("is_encrypted"),
        F.md5(protect.decrypt(F.col("sealed"), key)).alias("text_md5"),
        F.md5(protect.decrypt(F.col("text"), key)).alias("plain_md5"),
    )


def all_queries() -> dict[str, Query]:
    """Every public query function of this module by name."""
    not_queries = {"reputation_table", "model_table"}
    found = {
        name: value
        for name, value in globals().items()
        if callable(value)
        and getattr(value, "__module__", None) == __name__
        and not name.startswith("_")
        and name not in not_queries
        and name != "all_queries"
    }
    from filewarden.plans.stores import store_queries
    from filewarden.plans.streams import stream_queries

    return {**found, **stream_queries(), **store_queries()}
