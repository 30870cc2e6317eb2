"""Exact order statistics by distributed selection.

A range of values that holds the wanted rank is cut into buckets of equal width, the buckets are counted (partial counts before the shuffle), and the bucket that holds
the rank, with its own least and greatest value, is the next range.  When few different values can be left, they are counted one by one.  A pass is one scan; what comes
to the driver is bounded by ``BUCKETS`` rows for each range, and no task holds more than counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that a range is cut into; a range with no more rows than ``FEW`` is counted value by value.
BUCKETS, FEW = 1024, 4096


@dataclass
class _Range:
    low: object
    high: object
    before: int  # values below the range
    n: int


def _bucket(value: Column, low: object, high: object, buckets: int) -> Column:
    """Grows with the value; halves keep the width of a range of doubles finite."""
    width = float(high) * 0.5 - float(low) * 0.5
    return F.least(F.floor((value.cast("double") * 0.5 - F.lit(float(low) * 0.5)) / F.lit(width) * buckets), F.lit(buckets - 1)).cast("int")


def order_statistics(rows: DataFrame, value: str, ranks: Sequence[int], buckets: int = BUCKETS, few: int = FEW) -> dict[int, object]:
    """The values at ranks (from 0) in ascending order; ranks beyond the last value are left out.  Nulls and NaNs take no part."""
    kind = rows.schema[value].dataType
    known = rows.select(F.col(value).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    n, low, high = known.agg(F.count("v"), F.min("v"), F.max("v")).first()
    at = {r: _Range(low, high, 0, n) for r in set(ranks) if 0 <= r < n}
    found: dict[int, object] = {}
    while True:
        found |= {r: x.low for r, x in at.items() if x.low == x.high}
        at = {r: x for r, x in at.items() if r not in found}
        if not at:
            return found
        spans = sorted({(x.low, x.high, x.before, x.n) for x in at.values()})
        typed = lambda x: F.lit(x).cast(kind)
        cells = []
        for i, (low, high, _, n) in enumerate(spans):
            inside = (F.col("v") >= typed(low)) & (F.col("v") <= typed(high))
            narrow = n <= few or float(high) * 0.5 - float(low) * 0.5 <= 0  # longs that are one double
            cell = F.struct(F.lit(i).alias("span"), F.lit(-1).alias("bucket"), F.col("v").alias("one")) if narrow else F.struct(F.lit(i).alias("span"), _bucket(F.col("v"), low, high, buckets).alias("bucket"), F.lit(None).cast(kind).alias("one"))
            cells.append(F.when(inside, cell))
        counted = known.withColumn("c", F.explode(F.array_compact(F.array(*cells)))).groupBy("c.span", "c.bucket", "c.one").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        by_span: dict[int, list] = {}
        for c in sorted(counted, key=lambda c: c.low):
            by_span.setdefault(c.span, []).append(c)
        for r, x in at.items():
            before = x.before
            for c in by_span[spans.index((x.low, x.high, x.before, x.n))]:
                if r < before + c.n:
                    at[r] = _Range(c.low, c.high, before, c.n)
                    break
                before += c.n


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], **options: int) -> list[float | None]:
    """Exact percentiles, between two values in proportion; None without values."""
    n = rows.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).count()
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    found = order_statistics(rows, value, [r for p in places for r in (math.floor(p), math.ceil(p))], **options)
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        a, b = float(found[low]), float(found[high])
        out.append(a if a == b else (high - p) * a + (p - low) * b)
    return out
