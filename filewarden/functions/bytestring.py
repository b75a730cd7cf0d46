"""Byte-exact string columns.

Content is a byte string. Decoding it as ISO-8859-1 gives one character per
byte, so `length`, `instr`, `substring` and the regex functions count bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence length and context radius, in bytes.
EVIDENCE_BYTES = 200
CONTEXT_BYTES = 100


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text column."""
    return F.encode(text, "UTF-8")


def latin1(content: Column) -> Column:
    """Byte string to a column with one character per byte."""
    return F.decode(content, "ISO-8859-1")


def to_bytes(byte_chars: Column) -> Column:
    """Inverse of :func:`latin1`."""
    return F.encode(byte_chars, "ISO-8859-1")


def display(byte_chars: Column) -> Column:
    """One-character-per-byte text back to readable UTF-8; a cut character shows as U+FFFD."""
    return F.make_valid_utf8(to_bytes(byte_chars).cast("string"))


def search_text(content: Column) -> Column:
    """Lower-cased content for cheap substring tests (ASCII needles only)."""
    return F.lower(content.cast("string"))
