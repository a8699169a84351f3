"""Bitmaps of a fixed number of bits that stand for any number of 64-bit hashes.

A value whose bit is clear is certainly not among them; one whose bit is set may be. So a bitmap can go to
every task whatever the size of the data: it only thins out rows before an exact join, or fixes an order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24  # 2**24 bits, 2 MB
_BUCKET = 32768  # bits of one value of bitmap_construct_agg


def bitmap_of(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of a long column: at most 2**bits / 32768 rows of 4 KB reach the driver."""
    place = f"pmod({column}, {1 << bits}L)"
    rows = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.expr(f"int({place} div {_BUCKET}) AS bucket"))
        .agg(F.expr(f"bitmap_construct_agg({place} % {_BUCKET})").alias("bitmap"))
        .collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows:
        at = row["bucket"] * _BUCKET // 8
        out[at : at + _BUCKET // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values have their bit set."""
    place = values.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    byte = bitmap[(place >> np.uint64(3)).astype(np.int64)]
    return (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
