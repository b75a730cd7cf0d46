"""Scans decided by listings: unchanged files stay closed, problems are rows."""

from datetime import datetime

from filewarden.settings import ScanSettings
from filewarden.sources import listing

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
COLUMNS = "path string, size bigint, mtime timestamp"


def test_unchanged_files_are_never_opened(spark, tmp_path):
    for name in ("same.php", "grown.php", "new é.php", "gone.php"):
        (tmp_path / name).write_text(name)
    settings = ScanSettings(scan_paths=(str(tmp_path),))
    baseline = spark.createDataFrame([tuple(r) for r in listing.list_tree(spark, settings).collect()], COLUMNS)
    baseline = baseline.filter("path NOT LIKE '%new%'")
    (tmp_path / "grown.php").write_text("grown more")
    current = spark.createDataFrame([tuple(r) for r in listing.list_tree(spark, settings).collect()], COLUMNS)
    (tmp_path / "same.php").unlink()  # were it opened, it would be unreadable
    (tmp_path / "gone.php").unlink()
    got = listing.read_listed(listing.to_read(current, baseline)).collect()
    assert {(r["path"].split("/")[-1], bytes(r["content"]).decode()) for r in got} == {("grown.php", "grown more"), ("new é.php", "new é.php")}
    assert {r["problem"] for r in got} == {None}


def test_problems_are_rows(spark, tmp_path):
    (tmp_path / "a.php").write_bytes(b"x" * 500)
    (tmp_path / "b.php").write_bytes(b"")
    rows = [(f"file:{tmp_path}/a.php", 500, T1), (f"{tmp_path}/b.php", 0, None), (f"file://{tmp_path}/c.php", 7, T1), (f"{tmp_path}/a.php", None, T1)]
    got = listing.read_listed(spark.createDataFrame(rows, COLUMNS), whole_bytes=499, task_bytes=1).collect()
    found = sorted((r["path"][-5:], r["problem"], r["content"] and len(r["content"])) for r in got if r["problem"])
    assert found == [("a.php", "too_large", None), ("a.php", "too_large", None), ("c.php", "unreadable", None)]
    assert [bytes(r["content"]) for r in got if not r["problem"]] == [b""]
    assert listing.read_listed(spark.createDataFrame([], COLUMNS)).count() == 0


def test_changes(spark):
    old = spark.createDataFrame([("a", 1, T1), ("b", 1, T1), ("c", 1, T1), ("d", 1, T1), ("e", 1, None)], COLUMNS)
    new = spark.createDataFrame([("a", 1, T1), ("b", 2, T1), ("c", 1, T2), ("e", 1, None), ("f", None, None)], COLUMNS)
    got = {r["path"]: r["change"] for r in listing.changes(new, old).collect()}
    assert got == {"a": "unchanged", "b": "modified", "c": "modified", "d": "removed", "e": "unchanged", "f": "added"}
    assert {r["path"] for r in listing.to_read(new, old).collect()} == {"b", "c", "f"}
