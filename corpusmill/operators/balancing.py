"""Items over workers, so that loads are alike."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.corpus import prefix_sums
from corpusmill.operators.sampling import interval_lookup

#: Items of the head for each worker.
HEAD = 16


def least_loaded(sizes: list[int], workers: int) -> tuple[list[int], list[int]]:
    """The worker of each size, in the order given, always the one with the least load (ties: the lowest number), and the loads."""
    heap, loads, out = [(0, w) for w in range(workers)], [0] * workers, []
    for size in sizes:
        load, w = heap[0]
        heapq.heapreplace(heap, (load + size, w))
        loads[w] = load + size
        out.append(w)
    return out, loads


def room(loads: list[int], rest: int) -> list[int]:
    """How much each worker gets of ``rest`` if all are filled up to one level; whole numbers that add up to ``rest`` or up to a worker's unit more."""
    level, total = None, 0
    for k, load in enumerate(sorted(loads), 1):
        total += load
        own = -(-(rest + total) // k)
        level = own if level is None else min(level, own)
    return [max(0, level - load) for load in loads]


def balanced(items: DataFrame, key: str, size: str, workers: int, head: int | None = None) -> DataFrame:
    """Adds ``worker`` to items (with a whole-number key, each once, and a size): loads differ by two of the tail's items at most, unless an item is larger than a worker's share.

    The largest items (``head`` for all workers together, so bounded) go to the least loaded worker one by one.  The others, the tail, fill up what room is left under a common level: each worker takes a
    range of their running total, in the order of the key (two-level prefix sums and a bucketed range join)."""
    if workers < 1:
        raise ValueError("at least one worker")
    spark, head = items.sparkSession, head or HEAD * workers
    sized = items.withColumn("_size", F.coalesce(F.col(size).cast("bigint"), F.lit(0)))
    first = sized.select(key, "_size").orderBy(F.desc("_size"), key).limit(head).collect()
    assigned, loads = least_loaded([r["_size"] for r in first], workers)
    kinds = T.StructType([T.StructField("_key", items.schema[key].dataType), T.StructField("worker", T.IntegerType())])
    ahead = spark.createDataFrame([(r[key], w) for r, w in zip(first, assigned, strict=True)], kinds)
    top = items.join(F.broadcast(ahead), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")  # ``head`` rows
    if len(first) < head:
        return top
    last = first[-1]
    tail = sized.filter((F.col("_size") < last["_size"]) | ((F.col("_size") == last["_size"]) & (F.col(key) > F.lit(last[key]))))
    rest = tail.agg(F.sum("_size")).first()[0] or 0
    ranges, at = [], 0
    for w, n in enumerate(room(loads, rest)):
        if n:
            ranges.append((w, at, at + n))
            at += n
    if not ranges:  # what is left has no size
        return top.unionByName(tail.drop("_size").withColumn("worker", F.lit(loads.index(min(loads)))))
    placed = prefix_sums(tail, key, "_size", "_at").withColumn("_at", F.least(F.col("_at"), F.lit(at - 1)))  # after the end: items without a size
    shares = spark.createDataFrame(ranges, "worker int, _low bigint, _high bigint")  # a row for each worker
    found = interval_lookup(placed, shares, "_at", "_low", "_high", max(1, at // workers))
    return top.unionByName(found.select(*items.columns, "worker"))
