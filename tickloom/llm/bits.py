"""Bit filters of a fixed size: a cheap test that drops rows before a shuffle.

A filter never drops a row that has a partner; a value outside may pass by chance. Built from sums of
bitmaps on the executors, it is ``SIZE`` bits (16 MB) whatever the input, and is only made while it can
be at most an eighth full; beyond that callers shuffle without it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 27


def filled(values: DataFrame) -> np.ndarray | None:
    """The filter of a table's only column (long); None where it would be too full."""
    if values.count() > SIZE // 8:
        return None
    place = F.pmod(F.col(values.columns[0]), F.lit(SIZE)) + 1
    parts = values.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(SIZE // 8, np.uint8)
    for r in parts.collect():  # at most SIZE bits in all
        at = (r.b - 1) * len(r.m)
        out[at : at + len(r.m)] = np.frombuffer(r.m, np.uint8)
    return out


def test(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    p = values & np.int64(SIZE - 1)
    return (held[p >> 3] >> (p & 7).astype(np.uint8)) & np.uint8(1) != 0
