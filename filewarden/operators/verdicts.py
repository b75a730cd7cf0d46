"""Reputation and model verdicts, looked up by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.functions import bytestring as bs
from filewarden.functions.text import extension
from filewarden.operators.detect import threat_struct
from filewarden.schema import MODEL_RESPONSE
from filewarden.sources import catalogue as cat

# Limits, defaults and texts of the verdict layers.
REPUTATION_TYPE, REPUTATION_SOURCE = "virustotal_detection", "VirusTotal"
REPUTATION_TEXT = "VirusTotal detected malware: %d/%d engines flagged this file"
REPUTATION_EVIDENCE = "File hash: "
MODEL_TYPE, MODEL_SOURCE = "openai_detection", "OpenAI"
MODEL_TEXT, MODEL_EVIDENCE = "OpenAI detected potential malware", "AI analysis"
REQUEST_BYTES = 4000
REQUEST_OVERLAP = 200
DEFAULT_MODEL_CONFIDENCE = 70
CRITICAL_ABOVE_ENGINES = 5
HIGH_ABOVE_ENGINES = 2


def one_per_hash(table: DataFrame, value: str) -> DataFrame:
    """One row per content hash (the largest value if there are several), safe as a join side.

    Grouping by (prefix, hash) instead of the hash alone makes the following
    join exchange this side again. Both join inputs are then plain shuffles,
    which is what adaptive execution needs to split a hot hash on the file side.
    """
    return (
        table.groupBy(F.substring("sha256", 1, 2).alias("prefix"), "sha256")
        .agg(F.max(value).alias(value))
        .select("sha256", value)
    )


def _lookup(analysed: DataFrame, table: DataFrame, value: str, as_name: str, gate: bool) -> DataFrame:
    """Attach a verdict value by hash; with `gate`, only files with a local threat ask for it.

    A file that does not ask gets a key of its own that matches nothing, so these
    rows spread evenly instead of meeting in one partition.
    """
    side = one_per_hash(table, value).select(F.col("sha256").alias("__sha256"), F.col(value).alias(as_name))
    asks = F.size("threats") > 0 if gate else F.lit(True)
    key = F.when(asks, F.col("file_hash")).otherwise(F.concat(F.lit("-"), F.col("path")))
    return (
        analysed.withColumn("__key", key)
        .join(side, F.col("__key") == F.col("__sha256"), "left")
        .drop("__key", "__sha256")
    )


def reputation_threat(stats: Column, file_hash: Column) -> Column:
    """Threat struct from engine counts; NULL unless some engine flagged the content."""
    malicious = F.coalesce(stats["malicious"], F.lit(0))
    total = malicious
    for other in ("clean", "suspicious", "undetected"):
        total = total + F.coalesce(stats[other], F.lit(0))
    confidence = F.least(malicious / F.greatest(total, F.lit(1)) * F.lit(1.5), F.lit(1.0))
    severity = (
        F.when(malicious > CRITICAL_ABOVE_ENGINES, "critical")
        .when(malicious > HIGH_ABOVE_ENGINES, "high")
        .otherwise("medium")
    )
    threat = threat_struct(
        cat.REPUTATION_ORD,
        "reputation",
        REPUTATION_TYPE,
        severity,
        F.format_string(REPUTATION_TEXT, malicious, total),
        confidence,
        F.concat(F.lit(REPUTATION_EVIDENCE), file_hash),
        F.lit(0),
        F.lit(REPUTATION_SOURCE),
    )
    return F.when(malicious > 0, threat)


def model_severity(risk_level: Column) -> Column:
    """Risk level to severity, case-insensitive; absent means medium, unknown means low."""
    level = F.lower(F.coalesce(risk_level, F.lit("medium")))
    return F.when(level.isin("critical", "high", "medium"), level).otherwise("low")


def model_threat(response: Column) -> Column:
    """Threat struct from a model response (JSON); NULL unless it says malicious."""
    analysis = F.from_json(response, MODEL_RESPONSE)["analysis"]
    threat = threat_struct(
        cat.MODEL_ORD,
        "model",
        MODEL_TYPE,
        model_severity(analysis["risk_level"]),
        F.coalesce(analysis["description"], F.lit(MODEL_TEXT)),
        F.coalesce(analysis["confidence"], F.lit(float(DEFAULT_MODEL_CONFIDENCE))) / 100,
        F.coalesce(analysis["evidence"], F.lit(MODEL_EVIDENCE)),
        F.lit(0),
        F.lit(MODEL_SOURCE),
    )
    return F.when(F.coalesce(analysis["is_malicious"], F.lit(False)), threat)


def add_verdicts(
    analysed: DataFrame,
    reputation: DataFrame | None = None,
    model_verdicts: DataFrame | None = None,
    gate: bool = True,
) -> DataFrame:
    """Append verdict threats to each file's `threats` (narrow rows: content is already gone).

    The gate looks at local threats only, for both tables.
    """
    out, extra = analysed, []
    if model_verdicts is not None:
        out = _lookup(out, model_verdicts, "response", "__response", gate)
        extra.append(model_threat(F.col("__response")))
    if reputation is not None:
        out = _lookup(out, reputation, "stats", "__stats", gate)
        extra.append(reputation_threat(F.col("__stats"), F.col("file_hash")))
    if not extra:
        return analysed
    threats = F.concat(F.col("threats"), F.array_compact(F.array(*extra)))
    return out.select(*[threats.alias("threats") if c == "threats" else F.col(c) for c in analysed.columns])


def inference_requests(files: DataFrame, chunk_bytes: int = REQUEST_BYTES, overlap: int = REQUEST_OVERLAP) -> DataFrame:
    """Request table for a batch inference job: one request per chunk, so that every byte of a file is in one.

    Chunks of `chunk_bytes` start `chunk_bytes - overlap` apart; code across a border is whole in one of two chunks if
    it is no longer than the overlap. :func:`fold_verdicts` turns the answers into one per content.
    """
    step = chunk_bytes - overlap
    chunks = F.greatest(F.ceil((F.octet_length("content") - overlap) / step), F.lit(1)).cast("int")
    files = files.filter(F.col("content").isNotNull()).select(
        "path",
        "content",
        F.sha2("content", 256).alias("sha256"),
        F.posexplode(F.transform(F.sequence(F.lit(0), chunks - 1), lambda i: i * step + 1)).alias("chunk", "start"),
    )
    part = F.expr(f"substring(content, start, {chunk_bytes})")
    sample = bs.display(bs.latin1(part))
    file_type = extension(F.col("path"))
    prompt = F.concat(
        F.lit("Assess the following "),
        file_type,
        F.lit(" file for malicious code.\n\n```\n"),
        sample,
        F.lit(
            "\n```\n\nAnswer with one JSON object of the form\n"
            '{"analysis": {"is_malicious": boolean, "risk_level": "low|medium|high|critical", '
            '"confidence": number from 0 to 100, "description": string, "evidence": string, '
            '"threat_types": [string]}}\n\n'
            "Look for obfuscation, dangerous calls (eval, exec, shell_exec, system), encoded payloads, "
            "file inclusion, SQL injection, backdoors, mining code and phishing."
        ),
    )
    return files.select(
        "path",
        "sha256",
        "chunk",
        file_type.alias("file_type"),
        F.octet_length(part).alias("sample_bytes"),
        F.md5(part).alias("sample_md5"),
        prompt.alias("prompt"),
    )


def fold_verdicts(responses: DataFrame) -> DataFrame:
    """(sha256, response): the gravest of the responses (sha256, chunk, response) to the chunks of a content.

    Malicious before not, then severity, then confidence, then the first chunk; responses that are no JSON come last.
    """
    analysis = F.from_json("response", MODEL_RESPONSE)["analysis"]
    weight = F.struct(
        F.coalesce(analysis["is_malicious"], F.lit(False)),
        -F.array_position(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low")]), model_severity(analysis["risk_level"])),
        F.coalesce(analysis["confidence"].cast("double"), F.lit(float(DEFAULT_MODEL_CONFIDENCE))),
        -F.col("chunk"),
    )
    return responses.groupBy("sha256").agg(F.max_by("response", weight).alias("response"))


def submission_queue(files: DataFrame, reputation: DataFrame, below: int | None = None) -> DataFrame:
    """Files with an unknown content hash, to submit for analysis; only those below a size if `below` is given."""
    small = files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes")
    )
    small = small if below is None else small.filter(F.col("bytes") < below)
    known = reputation.filter(F.col("stats").isNotNull()).select("sha256")
    return small.join(known, "sha256", "left_anti").select("path", "sha256", "bytes")
