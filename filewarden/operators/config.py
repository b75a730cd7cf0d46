"""The key/value `config` table."""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewarden import schema
from filewarden.operators.results import as_timestamp


def config_rows(spark: SparkSession, values: dict[str, Any], at: datetime) -> DataFrame:
    """New `config` rows for nested values (stored as JSON)."""
    rows = [(key, json.dumps(value, sort_keys=True), at, at) for key, value in values.items()]
    return spark.createDataFrame(rows, schema.CONFIG)


def save_config(config: DataFrame, new: DataFrame) -> DataFrame:
    """Replace or add keys. A key in `new` wins over `config` even at the same time.

    Only `new` needs the newest row per key, so a key that was written very often
    is reduced by a partial aggregate before any shuffle.
    """
    both = config.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    values = [c for c in config.columns if c != "config_key"]
    return (
        both.groupBy("config_key")
        .agg(F.max_by(F.struct(*values), F.struct("__new", "updated_at", "config_value")).alias("row"))
        .select("config_key", *[F.col("row")[v].alias(v) for v in values])
        .select(config.columns)
    )


def get_config(config: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values for `wanted(config_key, default_value)`; the default stands in for a missing key."""
    stored = config.select("config_key", "config_value")
    return wanted.join(stored, "config_key", "left").select(
        "config_key", F.coalesce("config_value", "default_value").alias("config_value")
    )


def get_value(config: DataFrame, key: str, default: Any = None) -> Any:
    """One stored value on the driver."""
    row = config.filter(F.col("config_key") == key).select("config_value").first()
    return default if row is None else json.loads(row["config_value"])


def signature_update_row(spark: SparkSession, at: datetime) -> DataFrame:
    """Config row that records when the rule catalogue last changed (epoch seconds)."""
    return spark.range(1).select(
        F.lit("last_signature_update").alias("config_key"),
        F.unix_timestamp(as_timestamp(at)).cast("string").alias("config_value"),
        as_timestamp(at).alias("created_at"),
        as_timestamp(at).alias("updated_at"),
    )
