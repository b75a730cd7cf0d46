"""Column protection with AES-256-CBC: `enc:` + base64(IV + ciphertext)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Marker and cipher of a protected value.
PREFIX = "enc:"
KEY_BYTES = 32


def hidden_key(spark: SparkSession, key: bytes) -> Column:
    """The key as a subquery over a table of one row: plans, and so the UI and event logs, name it but do not hold it."""
    if len(key) != KEY_BYTES:
        raise ValueError(f"the key must have {KEY_BYTES} bytes")
    return spark.createDataFrame([(bytearray(key),)], "key BINARY").scalar()


def _key(key: bytes | Column) -> Column:
    if isinstance(key, Column):
        return key
    if len(key) != KEY_BYTES:
        raise ValueError(f"the key must have {KEY_BYTES} bytes")
    return F.lit(key)


def is_encrypted(value: Column) -> Column:
    return F.coalesce(F.startswith(value, F.lit(PREFIX)), F.lit(False))


def _blank(value: Column) -> Column:
    return value.isin("", "0")


def encrypt(value: Column, key: bytes | Column) -> Column:
    """Protect a text column with a random IV per value; empty values stay as they are.

    Keys given as bytes become literals of the plan; use :func:`hidden_key` where plans are logged.
    """
    sealed = F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(value, _key(key), F.lit("CBC"), F.lit("PKCS"))))
    return F.when(_blank(value), value).otherwise(sealed)


def decrypt(value: Column, key: bytes | Column) -> Column:
    """Recover a protected value; unprefixed values pass through, broken ones give NULL."""
    raw = F.try_to_binary(F.substring(value, len(PREFIX) + 1, 2**31 - 1), F.lit("base64"))
    opened = F.try_aes_decrypt(raw, _key(key), F.lit("CBC"), F.lit("PKCS")).cast("string")
    return F.when(is_encrypted(value), opened).otherwise(value)
