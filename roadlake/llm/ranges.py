"""Ranges of an ordering column, small enough for one task each, found by a literal search tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upper_ends(df: DataFrame, order: str, weight: Column, target: int) -> list[int]:
    """Values of an integer column that end ranges of about ``target`` weight; the last is the largest value.

    The list grows with the table, a value per range: a thousand ranges of 32 MB hold 32 GB.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0
    n = int(total // target) + 1
    shares = [(i + 1) / n for i in range(n - 1)]
    found = df.agg(F.max(order).alias("top"), F.percentile_approx(order, shares or [1.0], max(10_000, 10 * n)).alias("ends")).first()
    return [] if found["top"] is None else sorted({*(found["ends"] if shares else []), found["top"]})


def range_of(value: Column, ends: list[int]) -> Column:
    """The number of ends below the value, by halving: log2(ranges) steps a row."""
    if not ends:
        return F.lit(0)
    held = F.lit(np.array(ends, np.int64))
    strides = [1 << k for k in reversed(range(len(ends).bit_length()))]

    def step(at: Column, stride: Column) -> Column:
        reach = at + stride
        return F.when((reach <= len(ends)) & (F.get(held, reach - 1) < value), reach).otherwise(at)

    return F.aggregate(F.lit(np.array(strides, np.int32)), F.lit(0), step)
