"""Web archives: writing, reading, and resolving records of equal payloads to revisits.

Writing. Spark's text writer ends every record with the two line ends of the format, so an archive is a gzip file of
records, written and committed like any other table, on any file system. Pages of one size class share files: a file
holds at most `RECORDS` records of the smallest class, a quarter as many of each next one with four times the size, and
so never more than about `FILE_BYTES` of payload, or a single record.

Resolving. Archives are read back as whole files of bounded size; headers alone (place, page, digest, length) are
shuffled by digest. Among records of one digest and at least `LEAST` bytes, the one with the largest page id (then
file and place) is the response. The largest is found by a pre-aggregating group-by and joined back to the headers, a
join whose hot digests Spark can split. Decisions return to their file, and the deduplicated archives are written from
the files with fresh headers: a revisit has no payload and names the record it refers to.

Null html: an empty payload. A null page id is the smallest; a null url is empty, and characters that a header cannot
hold are percent-encoded. Repeated rows are records of their own. Columns other than the three are not read. Empty
input writes archives without records and gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewarden.session import stored

RECORDS = 2000
FILE_BYTES = 64 << 20
CLASSES = 9  # the last one holds the longest text there is
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
# Lines of the format.
LINE = "\r\n"
END = LINE * 2
HTTP = "HTTP/1.1 200 OK" + LINE + "Content-Type: text/html; charset=utf-8" + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = r"[^\x21-\x7E]"
HEADERS = (
    "path string, start bigint, kind string, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "refers_to bigint"
)


def header_lines(kind: str, page: Column, url: Column, digest: Column, more: Column, length: Column) -> Column:
    """The header of a record and the empty line behind it."""
    number = F.coalesce(page.cast("string"), F.lit("none"))
    return F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: {kind}{LINE}WARC-Record-ID: <urn:page:"),
        number,
        F.lit(f">{LINE}WARC-Date: {DATE}{LINE}WARC-Target-URI: "),
        url,
        F.lit(f"{LINE}WARC-Payload-Digest: sha1:"),
        digest,
        more,
        F.lit(f"{LINE}Content-Type: application/http; msgtype=response{LINE}Content-Length: "),
        length,
        F.lit(END),
    )


def size_class(payload: Column) -> Column:
    """How many times the largest payload of class 0 has to be multiplied by four to hold this one."""
    size = F.octet_length(payload)
    return sum(((size > (FILE_BYTES // RECORDS) * 4**k).cast("int") for k in range(CLASSES - 1)), F.lit(0))


def write_archives(records: DataFrame, folder: str, kind: int = 0) -> None:
    """Writes `records` (record: a header and its block) of one size class as gzip archives."""
    (
        records.select("record")
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, RECORDS >> (2 * kind)))
        .text(f"{folder}/class={kind}")
    )


def page_records(pages: DataFrame) -> DataFrame:
    """One response record per row of `pages` (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    url = F.coalesce("url", F.lit(""))
    safe = F.when(url.rlike(UNSAFE), F.regexp_replace(F.url_encode(url), r"%2F", "/")).otherwise(url)
    length = (F.octet_length(payload) + len(HTTP)).cast("string")
    head = header_lines("response", F.col("page_id"), safe, F.sha1(payload), F.lit(""), length)
    return pages.select(F.concat(head, F.lit(HTTP), payload).alias("record"))


def _inflated(content: bytes) -> bytes:
    """The bytes of all members of a gzip file."""
    found = []
    while content:
        member = zlib.decompressobj(31)
        found.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(found)


def parse_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, payload) of the records of an archive; blocks are cut by their length, whatever they hold."""
    data, at = memoryview(_inflated(content)), 0
    whole = data.obj
    while at < len(data):
        stop = whole.index(b"\r\n\r\n", at)
        first, *lines = bytes(data[at:stop]).decode().split(LINE)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        body = stop + 4
        length = int(headers["Content-Length"])
        block = data[body : body + length]
        inner = whole.find(b"\r\n\r\n", body, body + length)
        yield at, headers, bytes(block[inner + 4 - body :]) if inner >= 0 else b""
        at = body + length + len(END)


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives; length and digest of the payload are computed from its bytes."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for at, head, payload in parse_records(content.as_py()):
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head["X-Payload-Length"]) if revisit else len(payload)
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"digest of the record at {path}:{at} does not match")
                    refers = _page(head.get("WARC-Refers-To"))
                    rows.append((path.as_py(), at, head["WARC-Type"], _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, refers))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = [c.split()[0] for c in HEADERS.split(", ")]
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.mapInArrow(run, HEADERS)


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """(path, start, refers_to, refers_url) of the records that become revisits."""
    large = headers.filter(F.col("payload_bytes") >= least).select("path", "start", "page_id", "url", "payload_digest")
    key = F.struct("page_id", "path", "start")
    originals = large.groupBy("payload_digest").agg(
        F.max(key).alias("original"), F.max_by("url", key).alias("refers_url"), F.count("*").alias("records")
    )
    originals = originals.filter("records > 1").drop("records")
    joined = large.alias("r").join(originals.alias("o"), "payload_digest")
    return joined.filter("r.path != o.original.path OR r.start != o.original.start").select(
        "r.path", "r.start", F.col("o.original.page_id").alias("refers_to"), "o.refers_url"
    )


def deduplicated(spark: SparkSession, folder: str, revisits: DataFrame) -> DataFrame:
    """The records of the archives in `folder`, revisits without their payload, all with fresh headers."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    decided = revisits.groupBy("path").agg(F.collect_list(F.struct("start", "refers_to", "refers_url")).alias("decided"))
    both = files.join(decided, "path", "left").select("path", "content", "decided")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content, decided in zip(batch.column(1), batch.column(2)):
                chosen = {d["start"]: d for d in decided.as_py() or ()}
                rows, held = [], 0
                for at, head, payload in parse_records(content.as_py()):
                    rows.append(_fresh(head, payload, chosen.get(at)))
                    held += len(rows[-1])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["record"])
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["record"])

    return both.mapInArrow(run, "record string")


def _fresh(head: dict[str, str], payload: bytes, revisit: dict | None) -> str:
    block = HTTP.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {head['WARC-Record-ID']}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {head['WARC-Target-URI']}",
        f"WARC-Payload-Digest: {head['WARC-Payload-Digest']}",
    ]
    if revisit:
        number = "none" if revisit["refers_to"] is None else revisit["refers_to"]
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: <urn:page:{number}>",
            f"WARC-Refers-To-Target-URI: {quote(revisit['refers_url'] or '', safe=':/?&=#%')}",
            f"X-Payload-Length: {len(payload)}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return LINE.join(lines) + END + block.decode()


def archive(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes `pages` to `folder`/full and the deduplicated archives to `folder`/dedup; the headers of the latter."""
    spark = pages.sparkSession
    kind = size_class(F.coalesce("html", F.lit("")))
    kinds = sorted(r[0] for r in pages.select(kind).distinct().collect()) or [0]
    for k in kinds:
        write_archives(page_records(pages if len(kinds) == 1 else pages.filter(kind == k)), f"{folder}/full", k)
    revisits = resolve(read_headers(spark, f"{folder}/full"), least)
    if len(kinds) > 1:
        revisits = stored(revisits)
    for k in kinds:
        write_archives(deduplicated(spark, f"{folder}/full/class={k}", revisits), f"{folder}/dedup", k)
    return read_headers(spark, f"{folder}/dedup")
