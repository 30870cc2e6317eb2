"""Ranks over whole tables, selection and mergeable summaries against plain Python."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import ranking, selection, sketches


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def hard_rows():
    r = random.Random(6)
    nan, inf = float("nan"), float("inf")
    rows = [(r.choice([1, 1, 1, 2, 3, None, 9]), r.choice([0.5, -0.0, 0.0, nan, inf, -inf, None, r.random()]), r.choice(["a", "B", "é", None, ""]), i) for i in range(700)]
    return rows + [(5, 5.0, "hot", 1000 + i) for i in range(900)]  # one key over many partitions


@pytest.mark.parametrize("order", [["a"], [("a", True), "b"], ["c", ("b", True)], ["b"]])
def test_ranks_are_those_of_windows(spark, many_parts, order):
    rows = spark.createDataFrame(hard_rows(), "a int, b double, c string, i int").repartition(7)
    keys = [(F.col(k).desc() if down else F.col(k).asc()) for k, down in ((k, False) if isinstance(k, str) else k for k in order)]
    w = Window.partitionBy(F.lit(0)).orderBy(*keys)
    want = {r.i: (r.rank, r.dense_rank, r.percent_rank) for r in rows.select("i", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.percent_rank().over(w).alias("percent_rank")).collect()}
    got = ranking.ranks(rows, order, tiles=7).collect()
    assert {r.i: (r.rank, r.dense_rank, pytest.approx(r.percent_rank, abs=1e-15)) for r in got} == want
    assert sorted(r.row_number for r in got) == list(range(1, len(want) + 1))
    assert all(r.rank <= r.row_number < r.rank + sum(x[0] == r.rank for x in want.values()) for r in got[:50])
    tiles = Counter(r.ntile for r in got)
    assert sorted(tiles) == list(range(1, 8)) and [tiles[t] for t in range(1, 8)] == [len(want) // 7 + (t <= len(want) % 7) for t in range(1, 8)]
    assert all(a.ntile <= b.ntile for a, b in zip(sorted(got, key=lambda r: r.row_number), sorted(got, key=lambda r: r.row_number)[1:], strict=False))


def test_ranks_of_few_rows(spark, many_parts):
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    assert [tuple(r) for r in ranking.ranks(one, ["a"], tiles=3).collect()] == [(1, "x", 1, 1, 1, 0.0, 1)]
    assert ranking.ranks(one.limit(0), ["a"]).count() == 0
    same = spark.createDataFrame([(1,)] * 500, "a int").repartition(9)
    assert {(r.rank, r.dense_rank) for r in ranking.ranks(same, ["a"]).collect()} == {(1, 1)}
    with pytest.raises(ValueError, match="tile"):
        ranking.ranks(one, ["a"], tiles=0)


@pytest.mark.parametrize("kind", ["double", "bigint", "int"])
def test_selection(spark, kind):
    r = random.Random(len(kind))
    values = {"double": [r.choice([1e300, -1e300, 5e-324, 0.0, -0.0, r.gauss(0, 1), 7.0, 7.0]) for _ in range(3000)] + [1.7e308, -1.7e308, None, float("nan")], "bigint": [r.choice([2**62 + r.randrange(50), -(2**62), r.randrange(100), 5]) for _ in range(3000)] + [None], "int": [4] * 2000 + [None] * 5}[kind]
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5)
    known = sorted(v for v in values if v is not None and v == v)
    ranks = [0, 1, 17, len(known) // 3, len(known) // 2, len(known) - 2, len(known) - 1, len(known), -1]
    assert selection.order_statistics(rows, "v", ranks, buckets=16, few=20) == {k: known[k] for k in ranks if 0 <= k < len(known)}
    assert selection.order_statistics(rows.limit(0), "v", [0]) == {}


def test_percentiles(spark):
    values = [3.0, 1.0, 2.0, 10.0, None, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    assert selection.percentiles(rows, "v", shares) == pytest.approx(np.quantile([1, 2, 3, 10], shares).tolist())
    assert selection.percentiles(rows.filter("v IS NULL"), "v", [0.5]) == [None]


def hashes(words, k):
    return sorted({int(hashlib.md5(w.encode()).hexdigest()[:13], 16) for w in words})[:k]


def test_distinct_sketches_roll_up(spark):
    r = random.Random(1)
    rows = [(i % 5, "s" if i % 3 else "t", [f"w{r.randrange(4000 if i % 2 else 30)}" for _ in range(r.randrange(40))]) for i in range(600)] + [(1, "empty", []), (2, "empty", None)]
    docs = spark.createDataFrame(rows, "shard int, source string, words array<string>")
    own = sketches.distinct_sketches(docs, ["shard", "source"], F.col("words"), 64)
    rolled = {x.source: x.hashes for x in sketches.merged_distinct(own, ["source"], 64).collect()}
    words = {s: {w for _, t, ws in rows if t == s for w in ws or []} for s in ("s", "t")}
    assert rolled == {s: hashes(w, 64) for s, w in words.items()}
    assert rolled == {x.source: x.hashes for x in sketches.distinct_sketches(docs, ["source"], F.col("words"), 64).collect()}
    big = spark.createDataFrame([(hashes([f"a{i}" for i in range(5000)], 256), hashes([f"a{i}" for i in range(2500, 7500)], 256))], "a array<bigint>, b array<bigint>")
    estimate, alike, few = big.select(sketches.distinct_estimate(F.col("a"), 256), sketches.shared_estimate(F.col("a"), F.col("b"), 256), sketches.distinct_estimate(F.slice("a", 1, 9), 256)).first()
    assert abs(estimate - 5000) < 5 * 5000 / math.sqrt(254) and abs(alike - 1 / 3) < 0.15 and few == 9


def test_quantile_sketches_roll_up(spark):
    rows = spark.range(20_000).selectExpr("id % 7 AS shard", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source", "id * 17 % 20011 AS v")
    stored = sketches.quantile_sketches(rows, ["shard", "source"], "v")
    for x in sketches.merged_quantiles(stored, ["source"]).select("source", "n", F.kll_sketch_get_quantile_bigint("kll", F.lit(0.5)).alias("m")).collect():
        assert rows.filter((F.col("source") == x.source) & (F.col("v") <= x.m)).count() / x.n == pytest.approx(0.5, abs=3 * sketches.KLL_ERROR)
