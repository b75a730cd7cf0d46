"""Table schemas shared by the jobs."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Enum domains.
RESULT_STATUSES = ("active", "quarantined", "cleaned", "ignored")

TEXT, INT, LONG, REAL, FLAG, TIME = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType(), TimestampType()

def _table(**columns: DataType) -> StructType:
    return StructType([StructField(name, data_type) for name, data_type in columns.items()])

FILES = _table(path=TEXT, content=BinaryType(), size=LONG, mtime=TIME)

RULES = _table(
    rule_ord=INT, layer=TEXT, name=TEXT, pattern=TEXT, severity=TEXT, description=TEXT, confidence=REAL
)

THREAT = _table(
    rule_ord=INT,
    layer=TEXT,
    type=TEXT,
    severity=TEXT,
    description=TEXT,
    confidence=REAL,
    evidence=TEXT,
    line_number=INT,
    source=TEXT,
)

SCAN_RESULTS = _table(
    id=TEXT,
    scan_id=TEXT,
    file_path=TEXT,
    file_hash=TEXT,
    threat_type=TEXT,
    threat_severity=TEXT,
    threat_description=TEXT,
    confidence_score=DecimalType(3, 2),
    status=TEXT,
    detected_at=TIME,
    updated_at=TIME,
)

CONFIG = _table(config_key=TEXT, config_value=TEXT, created_at=TIME, updated_at=TIME)

QUARANTINE = _table(
    id=TEXT,
    file_path=TEXT,
    original_content=BinaryType(),
    backup_path=TEXT,
    quarantine_reason=TEXT,
    quarantined_at=TIME,
    restored_at=TIME,
)

AUDIT_LOG = _table(
    id=TEXT,
    event_type=TEXT,
    description=TEXT,
    severity=TEXT,
    user_id=LONG,
    user_ip=TEXT,
    metadata=TEXT,
    created_at=TIME,
)

REPUTATION = _table(
    sha256=TEXT, stats=_table(malicious=INT, clean=INT, suspicious=INT, undetected=INT)
)

MODEL_VERDICTS = _table(sha256=TEXT, response=TEXT)

MODEL_RESPONSE = _table(
    analysis=_table(
        is_malicious=FLAG,
        risk_level=TEXT,
        confidence=REAL,
        description=TEXT,
        evidence=TEXT,
        threat_types=ArrayType(TEXT),
    )
)

MANIFEST = _table(scan_id=TEXT, path=TEXT, started_at=TIME)

SITES = _table(site=TEXT, disallow_file_edit=FLAG, debug=FLAG, version=TEXT)
