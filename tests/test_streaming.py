"""Streams give what the batch operators give."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from filewarden.operators import admission, scan
from filewarden.plans import streams
from filewarden.streaming import admission as stream_admission
from filewarden.streaming import audit as stream_audit
from filewarden.streaming import scan as stream_scan

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
CONTENTS = {"/a.php": "<?php eval($_POST['x']); ?>", "/b.php": "fine", "/c.php": "$c99"}


def arrivals(make_files, path, contents, minutes=0):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.lit(minutes))
    make_files(contents).withColumn("mtime", at).coalesce(1).write.mode("append").parquet(path)


def test_scan_stream_equals_batch_and_resumes(spark, make_files, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    arrivals(make_files, src, CONTENTS)
    analysed = stream_scan.scan_stream(stream_scan.read_arrivals(spark, src))
    query = stream_scan.write_scan_results(analysed, out, ck)
    assert stream_scan.run_within(query) == "completed"
    assert stream_scan.stream_progress(query)[0]["input_rows"] == 3
    batch = scan.threats(scan.analyse(make_files(CONTENTS))).select("path", "type").collect()
    got = stream_scan.read_results(spark, out).select("file_path", "threat_type").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))

    arrivals(make_files, src, {"/new.php": "coinhive"})
    again = stream_scan.scan_stream(stream_scan.read_arrivals(spark, src))
    stream_scan.write_scan_results(again, out, ck).awaitTermination()
    assert stream_scan.read_results(spark, out).count() == len(batch) + 1


def test_seen_content_is_skipped(spark, make_files, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    arrivals(make_files, src, CONTENTS)
    arrivals(make_files, src, {**CONTENTS, "/a.php": "changed"}, minutes=5)
    unique = stream_scan.skip_seen(stream_scan.scan_stream(stream_scan.read_arrivals(spark, src, 1)))
    query = (
        unique.select("path", "file_hash").writeStream.format("memory").queryName("unique_files")
        .option("checkpointLocation", ck).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("unique_files").groupBy("path").count().orderBy("path").collect() == [("/a.php", 2), ("/b.php", 1), ("/c.php", 1)]


def test_backdated_file_in_a_late_batch_is_reported(spark, make_files, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    days = [152, 153, 154, -1500]
    for i, day in enumerate(days):
        arrivals(make_files, src, {f"/{i}.php": "coinhive"}, minutes=day * 24 * 60)
        analysed = stream_scan.skip_seen(stream_scan.scan_stream(stream_scan.read_arrivals(spark, src, 1)))
        stream_scan.write_scan_results(analysed, out, str(tmp_path / "ck"), seen_path=str(tmp_path / "seen")).awaitTermination()
    found = stream_scan.read_results(spark, out).collect()
    assert sorted(r["file_path"] for r in found) == [f"/{i}.php" for i in range(4)]
    assert all(datetime.now() - r["detected_at"] < timedelta(days=1) for r in found)
    again = stream_scan.skip_seen(stream_scan.scan_stream(stream_scan.read_arrivals(spark, src)))
    stream_scan.write_scan_results(again, out, str(tmp_path / "ck2"), "later", str(tmp_path / "seen")).awaitTermination()
    assert stream_scan.read_results(spark, out).count() == 4


def test_seen_content_is_not_scanned(spark, tmp_path, monkeypatch):
    """Both arrivals of the query's files are hashed; each file is scanned once, and none twice."""
    texts = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("eval($x); "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    pages = texts.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.when(F.col("doc_id") > 4, F.col("text")).alias("html"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    scanned, original = spark.sparkContext.accumulator(0), stream_scan.scan_stream
    counted = F.udf(lambda _: scanned.add(1) or True, "boolean").asNondeterministic()
    monkeypatch.setattr(stream_scan, "scan_stream", lambda files: original(files.filter(counted("path"))))
    rows = streams.stream_skip_seen(spark, str(tmp_path)).collect()
    files = streams.cp.corpus(spark, str(tmp_path)).drop("file_no")
    batch = scan.scan_results(scan.analyse(files), "s", datetime.now()).select("file_path", "file_hash", "threat_type", "threat_severity").collect()
    assert rows and sorted(rows) == sorted(batch)
    assert scanned.value == files.filter("content IS NOT NULL").count() == 55


def test_places_of_all_buckets_are_read(spark, make_files, tmp_path):
    src, wanted = str(tmp_path / "a folder of 100%25"), [0, 1, 2, 32766, 32767, 32768, 65535, 65536, 65537, 69999]
    rows = spark.range(70000).coalesce(1).select(F.concat(F.lit("/"), "id").alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    rows.select("*", F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime")).write.parquet(src)
    arrivals(make_files, src, CONTENTS)
    query = (
        stream_scan.hashed(stream_scan.read_arrivals(spark, src)).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "places"))
    )
    query.awaitTermination()
    places = spark.read.parquet(str(tmp_path / "places"))
    assert places.count() == 70003
    some = places.filter(F.col("path").isin("/a.php", *[f"/{i}" for i in wanted]))
    read = stream_scan.arrivals_at(stream_scan.place_bitmaps(some), src)
    assert {r["path"]: bytes(r["content"]).decode() for r in read.collect()} == {f"/{i}": str(i) for i in wanted} | {"/a.php": CONTENTS["/a.php"]}
    assert read.count() == len(wanted) + 1


def test_hashed_batches_scan_what_is_left(spark, make_files, tmp_path):
    src, out, ck, seen, progress = (str(tmp_path / n) for n in ("src", "out", "ck", "seen", "progress"))
    lost = []

    def run():
        hashed = stream_scan.skip_seen(stream_scan.hashed(stream_scan.read_arrivals(spark, src)))

        def scanned(files):
            return stream_scan.scan_stream(files.filter("path != '/lost.php'") if lost else files)

        stream_scan.write_scan_results(hashed, out, ck, "r", seen, progress, None, src, scanned).awaitTermination()

    arrivals(make_files, src, CONTENTS)
    run()
    arrivals(make_files, src, {**CONTENTS, "/a.php": "coinhive", "/lost.php": "coinhive", "/c.php": "$c99 again"})
    lost.append(True)
    with pytest.raises(StreamingQueryException, match="arrivals to scan"):
        run()
    lost.clear()
    run()
    files = [(r["path"], r["file_hash"]) for r in spark.read.parquet(seen).filter("path IN ('/a.php', '/lost.php')").collect()]
    assert len(set(files)) == 3
    found = [r["file_path"] for r in stream_scan.read_results(spark, out).filter("file_path = '/lost.php'").collect()]
    assert found == ["/lost.php"]
    assert sum(r["files"] for r in stream_scan.read_progress(spark, progress).collect()) == 6


def test_rolling_counts_stream_equals_batch(spark, tmp_path):
    rows = [(START + timedelta(minutes=37 * i), "e" if i % 3 else "f", "info") for i in range(200)]
    log = spark.createDataFrame(rows, "created_at TIMESTAMP, event_type STRING, severity STRING")
    src = str(tmp_path / "log")
    log.coalesce(1).write.parquet(src)
    hourly = stream_audit.hourly_counts(spark.readStream.schema(log.schema).parquet(src), "10 minutes")
    rolling = stream_audit.rolling_counts(hourly)
    query = (
        rolling.writeStream.format("memory").queryName("rolling").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    streamed = {tuple(r) for r in spark.table("rolling").collect()}
    batch = {tuple(r) for r in stream_audit.rolling_counts(stream_audit.hourly_counts(log)).collect()}
    assert streamed and streamed <= batch
    at = START.replace(tzinfo=None) + timedelta(hours=30)
    expected = sum(1 for t, e, _ in rows if e == "e" and at - timedelta(hours=24) <= t.replace(tzinfo=None) < at)
    assert {r[3] for r in batch if r[0]["end"] == at and r[1] == "e"} == {expected}


def test_admission_stream_equals_batch(spark, tmp_path):
    data = [(i, "hot" if i % 4 else "b", START + timedelta(seconds=i * 7 % 5 + i * 4)) for i in range(300)]
    calls = spark.createDataFrame(data, "call_id BIGINT, api STRING, ts TIMESTAMP").orderBy("ts").cache()
    src = str(tmp_path / "calls")
    cuts = [START, START + timedelta(seconds=400), START + timedelta(seconds=800), START + timedelta(days=1)]
    for low, high in zip(cuts, cuts[1:]):
        calls.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).coalesce(1).write.mode("append").parquet(src)
    out, ck = str(tmp_path / "admitted"), str(tmp_path / "ck")
    arriving = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(src)
    admitted = stream_admission.admitted_stream(arriving, {"hot": 6}, 2)
    stream_admission.write_admitted(admitted, out, ck).awaitTermination()
    batch = {r["call_id"]: r["accepted"] for r in admission.admit(calls, limits={"hot": 6}, default=2).collect()}
    read = lambda: {r["call_id"]: r["accepted"] for r in stream_admission.decisions(calls, spark.read.parquet(out)).collect()}
    assert read() == batch and len(set(batch.values())) == 2
    # the last batch is lost after its state was written, and runs again
    commits = sorted(int(f) for f in os.listdir(f"{ck}/commits") if f.isdigit())
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        os.remove(f"{ck}/commits/{name}")
    stream_admission.write_admitted(stream_admission.admitted_stream(arriving, {"hot": 6}, 2), out, ck).awaitTermination()
    assert read() == batch


def test_state_of_an_api_holds_one_window():
    live = stream_admission._Window(60, 3)
    assert [live.admit(s, 1) for s in (0, 10, 20, 30, 59, 60, 61, 70)] == [1, 1, 1, 0, 0, 1, 0, 1]
    assert live.admit(1000, 9) == 3 and live.live == {1000: 3}


def test_a_budget_ends_between_batches(spark, make_files, tmp_path):
    src, out, ck, progress = (str(tmp_path / n) for n in ("src", "out", "ck", "progress"))
    for k in range(3):
        arrivals(make_files, src, {f"/{k}.php": "coinhive"}, minutes=k)

    class Two(stream_scan.Budget):
        batches = 0

        def check(self):
            self.batches += 1
            if self.batches > 2:
                self.end = 0
            super().check()

    def start(budget):
        analysed = stream_scan.scan_stream(stream_scan.read_arrivals(spark, src, 1))
        return stream_scan.write_scan_results(analysed, out, ck, progress_path=progress, budget=budget)

    assert stream_scan.run_within(start(Two(600))) == "partial"
    assert stream_scan.read_progress(spark, progress).count() == 2
    assert stream_scan.read_results(spark, out).select("file_path").distinct().count() == 2
    assert stream_scan.run_within(start(stream_scan.Budget(600))) == "completed"
    rows = stream_scan.read_progress(spark, progress).collect()
    assert sorted((r["batch"], r["files"]) for r in rows) == [(0, 1), (1, 1), (2, 1)]
    assert stream_scan.read_results(spark, out).select("file_path").distinct().count() == 3
