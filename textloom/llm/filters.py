"""Filters of fixed size for 64-bit values, which tell tasks what a join can't need."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, as a power of two.
BITS = 26


def bit_filter(of: DataFrame, h: str) -> np.ndarray:
    """Which of 2 ** BITS remainders occur among the values of ``h``, as bytes. What it lets pass wrongly, a join drops."""
    x = F.col(h).bitwiseAND((1 << BITS) - 1) + 1
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for at, some in of.groupBy(F.bitmap_bucket_number(x)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x))).toLocalIterator():
        bits[(at - 1) * len(some) : at * len(some)] = np.frombuffer(some, np.uint8)
    return bits


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = h.view(np.int64) & ((1 << BITS) - 1)
    return (bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)
