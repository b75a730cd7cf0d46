"""Partial aggregates against the full tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from filewarden.operators import partials, report

AS_OF = datetime(2024, 1, 10, 12)


@pytest.fixture
def rows(spark):
    n = F.col("id")
    return spark.range(3000).select(
        F.concat(F.lit("s"), n % 7).alias("scan_id"),
        F.concat(F.lit("/f/"), n % 400).alias("file_path"),
        F.concat(F.lit("t"), n % 5).alias("threat_type"),
        F.element_at(F.array(*map(F.lit, partials.LEVELS)), (n % 4 + 1).cast("int")).alias("threat_severity"),
        F.when(n % 3 == 0, "ignored").otherwise("active").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + n % 7 * 43200 + n).alias("detected_at"),
        (n % 3).alias("part"),
    )


def as_rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_runs_merge_to_the_full_scan(spark, rows, tmp_path):
    folder = str(tmp_path / "p")
    for part in (0, 1, 2, 1):  # one run is repeated
        partials.add_run(rows.filter(F.col("part") == part).repartition(5), folder, f"r{part}")
    counts = partials.counts_of(spark, folder)
    assert as_rows(partials.threat_statistics(counts, AS_OF)) == as_rows(report.threat_statistics(rows, AS_OF))
    assert as_rows(partials.scan_summaries(spark, folder)) == as_rows(report.scan_summaries(rows))
    assert as_rows(partials.daily_trend(counts)) == as_rows(report.daily_trend(rows))


def test_numbers_of_paths_are_dense_and_stay(spark, rows, tmp_path):
    folder = str(tmp_path / "n")
    first = {tuple(r) for r in partials.number_paths(rows.filter("part = 0"), folder).collect()}
    every = partials.number_paths(rows, folder).collect()
    assert first <= {tuple(r) for r in every}
    assert sorted(r["number"] for r in every) == list(range(400))


def test_empty_run_and_a_bad_name(spark, rows, tmp_path):
    folder = str(tmp_path / "e")
    partials.add_run(rows.limit(0), folder, "none")
    got = partials.threat_statistics(partials.counts_of(spark, folder), AS_OF).first()
    assert tuple(got) == (0, 0, 0, 0, 0, 0)
    assert partials.scan_summaries(spark, folder).count() == 0
    with pytest.raises(ValueError):
        partials.add_run(rows, folder, "a/b")
