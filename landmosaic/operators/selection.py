"""Exact percentiles in bounded memory: histograms over ever narrower ranges of values.

The first histogram is over signs and powers of two, the next ones over PARTS equal parts of the range that the wanted place
fell into; each needs as many counters as it has parts, whatever the values, and is added up within tasks first. A range of
doubles with one power of two is down to single values after five such passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 4096


def _power(x: Column) -> Column:
    """A whole number that grows with x: its sign and power of two. NaN is the largest, as in an ascending sort."""
    size = F.floor(F.log2(F.abs(x))).cast("int") + 1100
    finite = F.when(x == 0, 0).when(x > 0, size).otherwise(-size)
    return F.when(F.isnan(x), 5000).when(x == math.inf, 4000).when(x == -math.inf, -4000).otherwise(finite)


def _histogram(values: DataFrame, part: Column) -> list:
    """(part, n, least, most), in order; as many rows as parts."""
    rows = values.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    return sorted(rows.collect(), key=lambda r: r["part"])


def order_statistic(values: DataFrame, place: int) -> tuple[float, int, int]:
    """The value at a place (from 0) of the column x in ascending order, how many values are less, and how many passes it took."""
    part, before, passes = _power(F.col("x")), 0, 0
    rows = values
    while True:
        passes += 1
        for r in _histogram(rows, part):
            if place < before + r["n"]:
                break
            before += r["n"]
        low, high = r["least"], r["most"]
        if low == high or math.isnan(low):
            return low, before, passes
        rows = values.where(F.col("x").between(low, high))
        width = high / PARTS - low / PARTS  # of one part; halves first, so that it can't overflow
        x = F.col("x")
        part = F.when(x == high, PARTS).otherwise(F.least(F.floor((x / PARTS - low / PARTS) / width * PARTS).cast("int"), F.lit(PARTS - 1))) if width > 0 else F.when(x == low, 0).otherwise(1)
        if width > 0 and passes > 60:
            part = F.when(x == low, 0).when(x == high, 2).otherwise(1)


def exact_percentile(rows: DataFrame, column: str, share: float) -> float | None:
    """The percentile, by linear interpolation between neighbours, of a column's values that aren't null; null without any."""
    values = rows.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n = values.count()
    if not n:
        return None
    at = (n - 1) * share
    low_at, high_at = math.floor(at), math.ceil(at)
    low, less, _ = order_statistic(values, low_at)
    if low_at == high_at:
        return low
    same = values.where(F.col("x").eqNullSafe(F.lit(low))).count()
    high = low if high_at < less + same else values.where(F.col("x") > low).agg(F.min("x")).first()[0]
    return low if high == low else (high_at - at) * low + (at - low_at) * high
