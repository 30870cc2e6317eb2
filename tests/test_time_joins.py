"""As-of and overlap joins against brute force: hot keys, ties, nulls, long intervals, edges of partitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import time_joins


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def latest(left, right, strict, within):
    out = []
    for k, g, t, i in left:
        own = [] if None in (k, g, t) else [(u, j) for k2, g2, u, j in right if (k2, g2) == (k, g) and u is not None and (u < t or u == t and not strict)]
        best = max(own, default=(None, None))
        out.append((k, g, t, i, *(best if best[0] is not None and (within is None or t - best[0] <= within) else (None, None))))
    return out


def made(r, n, keys, times, base):
    return [(r.choice(keys), r.choice(["x", "y", None]) if r.random() < 0.3 else "x", r.choice(times), base + i) for i in range(n)]


@pytest.mark.parametrize(("strict", "within"), [(False, None), (True, None), (False, 5), (True, 3)])
def test_as_of(spark, many_parts, strict, within):
    r = random.Random(strict * 10 + (within or 0))
    start = dt.datetime(2024, 1, 1)
    at = lambda x: None if x is None else start + dt.timedelta(seconds=x)
    left = made(r, 300, [1, 1, 1, 2, 3, None, *range(4, 30)], [*range(40), None], 0)
    right = made(r, 120, [1, 1, 1, 2, 5, None, *range(20, 40)], [*range(0, 40, 3), None], 1000)
    left += [(1, "x", 20, 5000 + i) for i in range(200)]  # one key and time over many partitions
    right += [(1, "x", 20, 7000 + i) for i in range(50)]
    a = spark.createDataFrame([(k, g, at(t), i) for k, g, t, i in left], "k bigint, g string, t timestamp, i bigint").repartition(5)
    b = spark.createDataFrame([(k, g, at(t), i) for k, g, t, i in right], "k bigint, g string, u timestamp, j bigint").repartition(3)
    got = time_joins.as_of_join(a, b, ["k", "g"], "t", "u", ["j"], None if within is None else F.expr(f"INTERVAL {within} SECONDS"), strict)
    want = latest(left, right, strict, within)
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(((k, g, at(t), i, at(u), j) for k, g, t, i, u, j in want), key=str)


def test_as_of_carries_over_empty_stretches(spark, many_parts):
    """The only right row is far before the left rows that ask for it, with whole partitions between."""
    a = spark.createDataFrame([(7, t, t) for t in range(1, 2000)], "k int, t int, i int")
    b = spark.createDataFrame([(7, 0, "first"), (6, 5000, "other")], "k int, u int, j string")
    got = time_joins.as_of_join(a, b, ["k"], "t", "u")
    assert got.filter("j = 'first' AND u = 0").count() == 1999 == got.count()
    assert time_joins.as_of_join(a, b.limit(0), ["k"], "t", "u").filter("j IS NULL").count() == 1999
    assert time_joins.as_of_join(a.limit(0), b, ["k"], "t", "u").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        time_joins.as_of_join(a, b.withColumnRenamed("j", "i"), ["k"], "t", "u")


def pairs(left, right):
    return sorted((i, j) for k, b, e, i in left for k2, b2, e2, j in right if None not in (k, b, e, b2, e2) and k == k2 and b < e and b2 < e2 and b < e2 and b2 < e)


def test_overlaps(spark, many_parts):
    """Lengths from 1 to the whole range, negative times, one key with most of the rows."""
    r = random.Random(5)
    span = lambda: (b := r.randrange(-3000, 3000), b + r.choice([0, -4, 1, 1, 2, 7, 30, 200, 6000, 50_000]))
    rows = [[(r.choice([1, 1, 1, 2, 3]), *span(), n + i) for i in range(250)] for n in (0, 1000)]
    rows[0] += [(None, 0, 5, 400), (1, None, 5, 401), (1, 0, None, 402)]
    rows[1] += [(None, 0, 5, 1400), (1, -10_000, 90_000, 1401), (2, 0, 1, 1402), (2, 0, 1, 1402)]
    a = spark.createDataFrame(rows[0], "k int, b bigint, e bigint, i int").repartition(4)
    b = spark.createDataFrame(rows[1], "k int, b2 bigint, e2 bigint, j int").repartition(4)
    got = time_joins.overlap_join(a, b, ["k"], ("b", "e"), ("b2", "e2"))
    assert sorted((x.i, x.j) for x in got.collect()) == pairs(*rows)
    assert got.columns == ["k", "b", "e", "i", "b2", "e2", "j"]
    assert time_joins.overlap_join(a.limit(0), b, ["k"], ("b", "e"), ("b2", "e2")).count() == 0


def test_long_intervals_are_not_copied_into_short_buckets(spark):
    rows = spark.range(1000).selectExpr("1 AS k", "id AS b", "id + 1 AS e", "id AS i")
    long = spark.createDataFrame([(1, 0, 10**12, 0)], "k int, b2 bigint, e2 bigint, j int")
    assert time_joins.overlap_join(rows, long, ["k"], ("b", "e"), ("b2", "e2")).count() == 1000
