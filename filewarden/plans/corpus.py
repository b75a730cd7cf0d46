"""A scannable corpus over the `documents` and `pages` tables.

The tables hold prose, so each document gets one short code line before or after
it, with remarks around the code, all by document number. All text is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewarden.operators import scan
from filewarden.settings import ScanSettings
from filewarden.sources.files import files_from_binary, files_from_text

# Own samples: one code line per document, chosen by its number; together they fire every rule that a text can fire.
SNIPPETS = (
    "",
    "$run = eval(base64_decode($blob));",
    "include($_POST['page']);",
    "echo shell_exec($_GET['q']);",
    "// r57 was here",
    "$k = base64_decode('" + "B" * 130 + "');",
    "connect('stratum+tcp', 'MONERO');",
    "if ($a) { eval($a); } exec($a);",
    "print $_REQUEST['n'];",
    "include($part);",
    "".join("$v = base64_decode('" + "C" * 110 + "'); " for _ in range(6)),
    "$q = 'union select x from information_schema.columns';",
    "$q = 'wp_options siteurl update'; $r = file_get_contents('https://host.example/feed');",
    "$q = 'wp_users password md5'; $p = 'y'; $s = str_replace('y', 'z', $p);",
    "$t = $u . $w;",
    "for ($n = 0; $n < 5; $n++) { $t .= chr($n); }",
    "include($_SERVER['p']); include_once($part);",
    "EVAL(base64_decode($z)); try_eval($z);",
    "<?php $o->system($_POST['c']); $h = $_SERVER['HTTP_USER_AGENT']; mail('x@y.z'); curl_exec('post'); admin_user_add(); ?>",
    "$x = '" + "\\x42" * 16 + "'; /* COINHIVE */",
)
# What stands before and behind the line, so that a call's surroundings differ; plain ASCII, at least 100 bytes.
AROUND = (
    " " * 110,
    "$_GET['page'] is read here. " * 5,
    "gzinflate and str_rot13 are only words in this remark. " * 3,
    "eval, exec and system are only words in this remark too. " * 2,
    "nothing of interest; " * 9,
)
FOLDERS = {0: "wp-content/cache", 1: ".github", 2: "myvendor"}
EXTENSIONS = ("php", "js", "html", "htm", "css", "txt", "PHP")
DIGESTS = (1, 2, 4, 8, 32)
STATUSES = ("active", "active", "active", "quarantined", "ignored", "cleaned", "active")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table_: DataFrame) -> DataFrame:
    """The small supplied tables come in one file each: deal them to all cores.

    A table of as many files as there are cores is read in parallel as it is, and its texts are not shuffled. Other
    tables get a task for each piece that their scan is read in, if those are more than the cores.
    """
    cores = table_.sparkSession.sparkContext.defaultParallelism
    if len(table_.inputFiles()) >= cores:
        return table_
    return table_.repartition(max(cores, table_.rdd.getNumPartitions()))


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`files` rows plus `file_no`: every document and every page, whole."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    number = F.col("doc_id")
    folder = F.col("lang")
    for remainder, name in FOLDERS.items():
        folder = F.when(number % 11 == remainder, name).otherwise(folder)
    doc_path = F.concat(F.lit("/site/"), "source", F.lit("/"), folder, F.lit("/"), number, F.lit("."), pick(EXTENSIONS, number))
    around = lambda shift: pick(AROUND, F.floor(number / len(SNIPPETS)) + shift)
    line = F.concat(around(0), pick(SNIPPETS, number), around(2))
    text = F.when(number % 3 == 0, F.concat(line, F.lit("\n"), "text")).otherwise(F.concat("text", F.lit("\n"), line))
    docs = files_from_text(documents, doc_path, text)
    host = F.regexp_extract("url", "://([^/]+)", 1)
    page_path = F.concat(F.lit("/web/"), host, F.lit("/"), "page_id", F.lit(".html"))
    pages = files_from_text(spread(table(spark, sf_dir, "pages")), page_path, F.col("html"))
    return docs.unionByName(pages).withColumn("file_no", F.regexp_extract("path", r"/([0-9]+)\.[^/]*$", 1).cast("bigint"))


def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as they are."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    docs = files_from_text(documents, F.concat(F.lit("/doc/"), "doc_id"), F.col("text"))
    pages = files_from_text(spread(table(spark, sf_dir, "pages")), F.concat(F.lit("/page/"), "page_id"), F.col("html"))
    return docs.unionByName(pages)


def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary file per document: 1, 2, 4, 8 or 32 digests of its text, so near random and mostly no UTF-8."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    many = F.element_at(F.array(*[F.lit(n) for n in DIGESTS]), (F.col("doc_id") % len(DIGESTS) + 1).cast("int"))
    digest = lambda i: F.sha2(F.concat(i.cast("string"), F.lit(":"), "text"), 256)
    content = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), many), digest), ""))
    return files_from_binary(documents, F.concat(F.lit("/bin/"), "doc_id", F.lit(".php")), content)


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scan_results` of the whole corpus, spread over five scans, thirty days and all statuses."""
    analysed = scan.analyse(corpus(spark, sf_dir), settings=ScanSettings())
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("file_no") % 30 * 86400)
    rows = scan.scan_results(
        analysed.withColumn("at", at), F.concat(F.lit("scan_"), F.col("file_no") % 5), F.col("at")
    )
    number = F.regexp_extract("file_path", r"/([0-9]+)\.[^/]*$", 1).cast("bigint")
    return rows.withColumn("status", pick(STATUSES, number))


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as an audit log."""
    severity = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "warning")
        .when(F.col("event_type") == "signup", "critical")
        .otherwise("info")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        "event_type",
        F.concat(F.lit("event "), "event_id").alias("description"),
        severity.alias("severity"),
        "user_id",
        F.lit(None).cast("string").alias("user_ip"),
        F.col("props").alias("metadata"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def calls_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as calls of one api per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), F.col("event_type").alias("api"), F.col("ts").cast("timestamp").alias("ts")
    )
