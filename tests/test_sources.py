"""File trees, selection rules and the rule catalogue."""

import pytest
from pyspark.sql import functions as F

from filewarden import schema
from filewarden.operators import detect
from filewarden.settings import ScanSettings, split_setting
from filewarden.sources import catalogue as cat
from filewarden.sources import sinks
from filewarden.sources.files import _depth_windows, read_tree, select_files, skipped_files


def write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def names(df, root):
    return sorted(r["path"].split(str(root) + "/")[1] for r in df.select("path").collect())


def opened_files(df):
    """Files the scans of an executed query read."""
    df.collect()

    def walk(plan):
        metrics, children = plan.metrics(), plan.children()
        own = metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_tree_selection(spark, tmp_path):
    deep10, deep11 = "/".join("d" * 10), "/".join("d" * 11)
    write(
        tmp_path,
        {
            "a.php": "x",
            "b.JS": "x",
            "c.txt": "x",
            "noext": "x",
            "big.php": "x" * 2000,
            "limit.php": "x" * 1000,
            "vendor/x.php": "x",
            "myvendor/x.php": "x",
            ".github/x.php": "x",
            "wp-content/cache/x.php": "x",
            "sub/vendor.php": "x",
            f"{deep10}/ok.php": "x",
            f"{deep11}/no.php": "x",
            "sp ace/é.php": "x",
        },
    )
    files = read_tree(spark, ScanSettings(scan_paths=(str(tmp_path),), max_file_size=1000, max_depth=10))
    everything = read_tree(spark, ScanSettings(scan_paths=(str(tmp_path),)))
    assert {"big.php", f"{deep11}/no.php"} <= set(names(everything, tmp_path))
    wanted = ["a.php", "b.JS", "limit.php", "sub/vendor.php", f"{deep10}/ok.php", "sp ace/é.php"]
    assert names(files, tmp_path) == sorted(wanted)
    assert opened_files(files) == len(wanted)
    assert files.columns == schema.FILES.fieldNames()


def test_nested_roots_give_each_path_once(spark, tmp_path):
    deep = "/".join("d" * 11)
    write(tmp_path, {"a.php": "x", "d/b.php": "x", f"{deep}/c.php": "x"})
    both = read_tree(spark, ScanSettings(scan_paths=(str(tmp_path), str(tmp_path / "d"), str(tmp_path) + "/")))
    assert names(both, tmp_path) == sorted(["a.php", "d/b.php", f"{deep}/c.php"])
    assert len(_depth_windows(["/x", "/x/", "/x/y"], 10)) == 2


def test_select_files_on_a_table(spark, make_files):
    files = make_files({"/r/a.php": "x", "/r/a.txt": "x", "/r/.git/a.php": "x", "/r/B.PHP": "x"})
    assert sorted(r["path"] for r in select_files(files).collect()) == ["/r/B.PHP", "/r/a.php"]


def test_split_setting():
    assert split_setting(" php, js ,,css", ",") == ("php", "js", "css")


@pytest.mark.parametrize(
    "pattern, text, hit",
    [
        ("/abc/i", "xABC", True),
        ("#a/b#", "a/b", True),
        (r"/\beval/", "éeval", True),
        (r"/\beval/", "_eval", False),
        ("/a.b/", "a\rb", True),
        ("/a.b/", "a\nb", False),
        ("/a.b/s", "a\nb", True),
        ("{a+}", "aa", True),
    ],
)
def test_java_regex(spark, pattern, text, hit):
    assert spark.range(1).select(F.lit(text).rlike(cat.java_regex(pattern)).alias("x")).first()["x"] is hit


def test_java_regex_rejects_bad_patterns():
    for bad in ("abc", "/abc/q"):
        with pytest.raises(ValueError):
            cat.java_regex(bad)


def test_catalogue_merge_replaces_in_place_and_appends(spark, make_files):
    current = cat.default_catalogue(spark)
    updates = spark.createDataFrame(
        [
            (5, "signature", "zeta", "/zeta/", "low", "new", 0.9),
            (2, "signature", "shell_exec", "/shell/", "low", "changed", 0.9),
            (3, "signature", "alpha", "/al'pha\\d/", "low", "it's \\ new", 0.9),
        ],
        schema.RULES,
    )
    merged = cat.merge_catalogue(current, updates)
    got = [r["name"] for r in merged.orderBy("rule_ord").collect()]
    assert got == [n for n, *_ in cat.SIGNATURES] + ["alpha", "zeta"]
    assert cat.rule_count(merged).first()["rule_count"] == 10
    hits = detect.signature_hits(make_files({"a": "al'pha7 shell"}), cat.collect_catalogue(merged)).collect()
    assert {(h["type"], h["description"]) for h in hits} == {("shell_exec", "changed"), ("alpha", "it's \\ new")}


def test_export_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n INT, t STRING")
    for fmt in sinks.EXPORT_FORMATS:
        sinks.export(df, str(tmp_path / fmt), fmt)
        assert spark.read.option("header", True).format(fmt).load(str(tmp_path / fmt)).count() == 1
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "x"), "xml")
    sinks.write_version(df, str(tmp_path / "v1"))
    with pytest.raises(Exception):
        sinks.write_version(df, str(tmp_path / "v1"))


def test_skipped_files_complement_the_selection(spark, make_files):
    paths = ["/a/x.php", "/a/x.exe", "/a/.git/x.php", "/a/b/c/d/x.php", "/a/big.php", "/a/gone.php"]
    files = make_files({p: "y" * (50 if "big" in p else 5) for p in paths})
    files = files.withColumn("content", F.when(F.col("path") != "/a/gone.php", F.col("content")))
    limits = ScanSettings(max_file_size=20, max_depth=2)
    reasons = {r["path"]: r["reason"] for r in skipped_files(files, limits).collect()}
    assert reasons == {"/a/x.exe": "extension", "/a/.git/x.php": "excluded_folder", "/a/b/c/d/x.php": "too_deep",
                       "/a/big.php": "too_large", "/a/gone.php": "unreadable"}
    assert {r["path"] for r in select_files(files).collect()} >= {"/a/b/c/d/x.php", "/a/big.php"}


def test_repeated_update_names_stay_one_rule(spark):
    fields = "rule_ord INT, layer STRING, name STRING, pattern STRING, severity STRING, description STRING, confidence DOUBLE"
    current = spark.createDataFrame([(1, "s", "a", "/x/", "high", "d", 0.9)], fields)
    updates = spark.createDataFrame([(i, "s", n, f"/{i}/", "low", "d", 0.9) for i, n in enumerate(["a", "b", "a", "b"])], fields)
    merged = {r["name"]: r["pattern"] for r in cat.merge_catalogue(current, updates).collect()}
    assert merged == {"a": "/2/", "b": "/3/"} and cat.merge_catalogue(current, updates).count() == 2
