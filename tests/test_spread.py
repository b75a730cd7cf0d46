"""Small tables are dealt to all cores; tables of many files are read as they are."""

from pyspark.sql import functions as F

from filewarden.plans import corpus, streams


def test_many_files_are_not_shuffled(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for name, files in (("one", 1), ("many", 2 * cores)):
        spark.range(1000).repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))
    plan = lambda name: corpus.spread(corpus.table(spark, str(tmp_path), name))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan("one") and "Exchange" not in plan("many")
    assert corpus.spread(corpus.table(spark, str(tmp_path), "many")).count() == 1000


def test_arrivals_are_bounded(spark, tmp_path, monkeypatch):
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("eval($x); "), 100).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    texts.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    work = str(tmp_path / "work")
    monkeypatch.setattr(streams, "shared_folder", lambda _: work)
    monkeypatch.setattr(streams, "ARRIVAL_BYTES", 10_000)
    rows = streams.stream_progress(spark, str(tmp_path)).collect()
    batches = spark.read.parquet(f"{work}/progress").count()
    assert [r["files"] for r in rows] == [80] and batches > 4
