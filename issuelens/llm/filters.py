"""A fixed-size bitmap of keys, to skip at the source most rows that a later exact join would drop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_bits(keys: DataFrame, key: Column, bits: int) -> np.ndarray:
    """``2**bits`` flags with one set for each 64-bit key.

    Its size is fixed, whatever the number of keys: with many keys it lets more
    rows through, never fewer, and the exact join behind it decides.
    """
    spot = F.shiftrightunsigned(key, 64 - bits)
    rows = (keys.select((spot / 32).cast("int").alias("word"), (spot % 32).cast("int").alias("bit"))
            .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("value")).toArrow())
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    bitmap[rows.column("word").to_numpy()] = rows.column("value").to_numpy().astype(np.uint32)
    return bitmap


def may_have(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys have their flag set."""
    bits = int(len(bitmap)).bit_length() + 4
    spot = keys >> np.uint64(64 - bits)
    return (bitmap[spot >> np.uint64(5)] >> (spot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
