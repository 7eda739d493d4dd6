"""A filter of fixed size over the long values of a column: it may let others pass, never stops one of its own.

It spares a shuffle of rows that a later join would drop. Its 2^25 bits are 4 MB whatever
the column holds; the more values, the less it stops, and the join decides in any case.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, PAGE = 25, 15  # powers of two: bits in all, bits of a row that Spark makes


def bits_of(df: DataFrame, value: Column) -> Broadcast:
    """The filter of a long column, nulls left out: 1024 rows of 4 KB at most reach the driver."""
    slot = df.where(value.isNotNull()).select(value.bitwiseAND((1 << SIZE) - 1).alias("slot"))
    pages = slot.groupBy(F.shiftright("slot", PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << PAGE) - 1)).alias("bits"))
    whole = np.zeros(1 << SIZE - 3, np.uint8)
    for r in pages.collect():
        at = int(r.page) << PAGE - 3
        whole[at : at + (1 << PAGE - 3)] = np.frombuffer(bytes(r.bits), np.uint8)
    return df.sparkSession.sparkContext.broadcast(whole)


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each of the signed or unsigned longs may be in the column."""
    slot = values.astype(np.int64, copy=False) & ((1 << SIZE) - 1)
    return bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
