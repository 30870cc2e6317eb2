"""Orders, heads, samples and fixed-size batches, all by stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.scalar import uniform
from corpusmill.operators.corpus import numbered, prefix_sums


def seeded_order(key: str, seed: int | str) -> Column:
    """A key's place in a shuffle: its md5 with the seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.orderBy(seeded_order(key, seed), key)


def head_by(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group before it deals the rows."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def fixed_sample(rows: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group, the same ones for the same seed."""
    ranked = rows.withColumn("_order", seeded_order(key, seed))
    return head_by(ranked, by, ["_order", key], n).drop("_order")


def batches(rows: DataFrame, by: str, order: str, n: int, item: str) -> DataFrame:
    """(by, batch, items): runs of n rows, the last may be shorter."""
    if n < 1:
        raise ValueError("a batch has at least one row")
    cut = numbered(rows, order, "_k", by).withColumn("batch", F.floor(F.col("_k") / n))
    return cut.groupBy(by, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i")))), lambda x: x["i"]).alias("items"))


def interval_lookup(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Range join low <= at < high: both sides are cut into buckets of ``width``, so it is an equi-join."""
    cut = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    dealt = points.withColumn("_b", F.floor(F.col(at) / width))
    return dealt.join(cut, "_b").filter((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("_b")


def pairwise_offsets(lengths: DataFrame, by: str, order: str, n: str) -> DataFrame:
    """Adds (begin, end) of each row in the concatenation of its group."""
    return prefix_sums(lengths, order, n, "begin", by).withColumn("end", F.col("begin") + F.col(n))


def bootstrap_means(rows: DataFrame, key: str, value: str, samples: int, size: int, seed: int = 0) -> DataFrame:
    """(sample, mean): means of ``samples`` resamples of ``size`` values with replacement; without values no rows.

    A draw asks for a rank in the order of a whole-number ``key`` (ties by value) and meets the value by an equi-join, so
    neither values nor draws are gathered anywhere.  Null values take no part."""
    values = numbered(rows.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value")).filter(F.col("_value").isNotNull()), "_key", "_rank", then=("_value",))
    n = values.count()
    draws = rows.sparkSession.range(samples).withColumnRenamed("id", "sample").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    asked = draws.withColumn("_rank", F.floor(uniform(F.lit(seed), "sample", "draw") * n))
    return asked.join(values.select("_rank", "_value"), "_rank").groupBy("sample").agg(F.avg("_value").alias("mean"))
