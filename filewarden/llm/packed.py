"""Sorted 64-bit numbers as compact binaries, cut into slices of equal ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PRIME_A = 0x9E3779B97F4A7C15
PRIME_B = 0xBF58476D1CE4E5B9
PRIME_C = 0x94D049BB133111EB


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = values + np.uint64(PRIME_A)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(PRIME_B)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(PRIME_C)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte: equal high bytes stand together and compress."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def cuts(values: np.ndarray, slices: int) -> np.ndarray:
    """Places at which ascending numbers go on to the next of `slices` equal ranges, with 0 and the end."""
    bounds = np.array([(i << 64) // slices for i in range(1, slices)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(values, bounds), [len(values)]]).astype(np.int64)


def column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()
