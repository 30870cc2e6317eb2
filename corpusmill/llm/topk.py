"""Exact top-k search over integer vectors by MaxScore.

A vector's component ``d`` is a posting of term ``d``.  Against a query's component the
posting contributes at least ``low`` and at most ``low + spread`` within a shard, so after
taking out the lows every contribution is non-negative and bounded by its spread.
For each query the terms are ordered by spread.  The smallest ones whose spreads together
can't reach the k-th best score so far are non-essential.  Essential terms' postings are
traversed for all vectors; the rest are probed only for vectors that can still compete, a few
terms at a time, largest bound first.  A vector goes only when its bound is strictly
below the threshold, so ties are kept.  Shards' winners are merged.

Queries are dealt to blocks and candidates to shards of a bounded number of bytes, and every block meets every shard
in a task of its own.

Vectors that are null, hold a null or non-finite component, or have a null id take no
part.  Components beyond a shorter vector's end count as 0.  Repeated ids are separate
candidates (the query's own id is left out altogether).  Very long vectors make shards of fewer rows.  Components so
large that a score could leave 64 bits are an error.  Only the id and the vector are read, so other columns can have any name.
An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors, as 64-bit numbers, in a shard and in a block of queries.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 2 << 20
_PROBE = 8


def quantise(vectors: DataFrame, scale: int = 256, name: str = "embedding") -> DataFrame:
    """(vec_id, v): components as floor(scale * x); unusable vectors are left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col(name).isNotNull()).filter(~F.coalesce(F.exists(name, bad), F.lit(False)))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(name, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Terms by vectors."""
    column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return np.ascontiguousarray(out.T)


def max_score(query: np.ndarray, terms: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best vectors; ``low`` and ``high`` are the postings' extremes."""
    ends = np.stack([query * low, query * high])
    least, spread = ends.min(0), ends.max(0) - ends.min(0)
    order = np.argsort(-spread, kind="stable")
    alive = np.flatnonzero(ids != own)
    k = min(k, len(alive))
    if not k:
        return alive, alive
    # A first threshold: the full scores of the vectors that lead after the strongest terms.
    lead = order[:_PROBE]
    partial = query[lead] @ terms[lead]
    first = alive[np.argpartition(-partial[alive], k - 1)[:k]] if len(alive) > k else alive
    threshold = int((query @ terms[:, first]).min())
    rest = np.cumsum(spread[order][::-1])[::-1]  # spreads of a term and all weaker ones
    n_essential = max(_PROBE, int(np.count_nonzero(rest + least.sum() >= threshold)))
    essential = order[_PROBE:n_essential]
    partial = (partial + query[essential] @ terms[essential])[alive]
    done = max(n_essential, _PROBE)
    while True:
        left = order[done:]
        if len(left):
            stays = partial + int(least[left].sum() + spread[left].sum()) >= threshold
            alive, partial = alive[stays], partial[stays]
        else:
            break
        step = left[:_PROBE]
        partial = partial + query[step] @ terms[np.ix_(step, alive)]
        done += len(step)
        if len(alive) > k:
            floor = int((np.partition(partial, len(partial) - k)[-k:]).min() + (least[order[done:]].sum() if done < len(order) else 0))
            threshold = max(threshold, floor)
    best = np.lexsort((ids[alive], -partial))[:k]
    return alive[best], partial[best]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates but itself; ties to the smaller id.

    Both inputs are results of ``quantise``.  The queries are a stated set; every one meets every shard."""
    queries = queries.distinct()
    sizes = (F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))))
    (n, wide, large), (asked_n, asked_wide, asked_large) = candidates.agg(*sizes).first(), queries.agg(*sizes).first()
    if (wide or 0) * (large or 0.0) * (asked_large or 0.0) >= 2.0**61:
        raise ValueError("scores of these vectors can leave 64 bits")
    shards = max(1, math.ceil(n * 8 * (wide or 1) / shard_bytes))
    blocks = max(1, math.ceil(asked_n * 8 * (asked_wide or 1) / block_bytes))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda m: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(m)).cast("int")
    dealt = candidates.select(own(shards).alias("shard"), every(blocks).alias("block"), "vec_id", "v")
    asked = queries.select(every(shards).alias("shard"), own(blocks).alias("block"), "vec_id", "v")

    def search(query: pa.Table, own: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [])
        if query.num_rows and own.num_rows:
            width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (query, own))
            ids, terms = own.column("vec_id").to_numpy(), _matrix(own.column("v"), width)
            low, high = terms.min(1), terms.max(1)
            for q, v in zip(query.column("vec_id").to_pylist(), _matrix(query.column("v"), width).T, strict=True):
                found, score = max_score(v, terms, low, high, ids, q, k) if width else (np.flatnonzero(ids != q)[:0], np.zeros(0, np.int64))
                for column, value in zip(out, (np.full(len(found), q), ids[found], score), strict=True):
                    column.append(value)
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    keys = ("shard", "block")
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
