"""Byte histogram and Shannon entropy.

The histogram is the only step that leaves the JVM: one Arrow batch in, 256
counters per value out. Nothing is exploded or shuffled for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTE_VALUES = 256


def _slices(values: pa.Array):
    """The bytes of each value as a view on the Arrow buffer (None for NULL)."""
    values = values.cast(pa.large_binary())
    _, offset_buffer, data_buffer = values.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(values)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else None


@F.arrow_udf(T.ArrayType(T.LongType()))
def _byte_counts(values: pa.Array) -> pa.Array:
    return pa.array(
        [None if v is None else np.bincount(v, minlength=BYTE_VALUES) for v in _slices(values)],
        type=pa.list_(pa.int64()),
    )


@F.arrow_udf(T.DoubleType())
def _byte_entropy(values: pa.Array) -> pa.Array:
    out = []
    for v in _slices(values):
        if v is None:
            out.append(None)
            continue
        counts = np.bincount(v, minlength=BYTE_VALUES)
        p = counts[counts > 0] / max(len(v), 1)
        out.append(float(-(p * np.log2(p)).sum()) + 0.0)
    return pa.array(out, type=pa.float64())


def byte_counts(content: Column) -> Column:
    """256 counters, one per byte value."""
    return _byte_counts(content)


def byte_entropy(content: Column) -> Column:
    """Shannon entropy of the bytes in bits, 0 to 8; 0 for empty content."""
    return _byte_entropy(content)


def entropy_of_counts(counts: Column) -> Column:
    """Entropy from a byte histogram, JVM-side: ``log2(n) - sum(c * log2(c)) / n``."""
    zero = F.lit(0.0)
    total = F.aggregate(counts, zero, lambda acc, c: acc + c)
    weighted = F.aggregate(counts, zero, lambda acc, c: acc + F.when(c > 0, c * F.log2(c)).otherwise(zero))
    return F.when(total == 0, zero).otherwise(F.log2(total) - weighted / total)
