"""Archives hold a bounded number of bytes, whatever the sizes of their pages."""

import glob
import gzip
import hashlib

from pyspark.sql import functions as F

from filewarden.llm import warc


def test_large_pages_get_files_of_their_own_size_class(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 16)
    monkeypatch.setattr(warc, "FILE_BYTES", 64_000)
    sizes = [0, 1, 900, 4000, 4001, 16_000, 16_001, 70_000, 300_000]
    pages = spark.range(9 * 40).coalesce(1).select(
        F.col("id").alias("page_id"),
        F.lit("http://x.example/").alias("url"),
        # Texts of a size are equal in pairs.
        F.expr(f"repeat(char(97 + id div 18 % 20), array({', '.join(map(str, sizes))})[id % 9])").alias("html"),
    )
    given = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r for r in warc.archive(pages, str(tmp_path / "a")).collect()}
    assert set(got) == set(given)
    best: dict = {}
    for page, html in given.items():
        best[html] = max(page, best.get(html, page))
    for page, html in given.items():
        revisit = len(html) >= 1000 and best[html] != page
        row = got[page]
        assert (row["kind"], row["refers_to"]) == (("revisit", best[html]) if revisit else ("response", None))
        assert (row["payload_bytes"], row["payload_digest"]) == (len(html), hashlib.sha1(html.encode()).hexdigest())
    files = glob.glob(f"{tmp_path}/a/*/class=*/part-*.gz")
    assert {f.split("class=")[1][0] for f in files} == {"0", "1", "2", "3", "4"}
    for name in files:
        found = [payload for _, _, payload in warc.parse_records(open(name, "rb").read())]
        assert len(found) == 1 or sum(map(len, found)) <= 64_000
        assert gzip.open(name).read(8) == b"WARC/1.1"
