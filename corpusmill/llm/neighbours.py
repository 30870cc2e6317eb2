"""Approximate nearest neighbours by cosine, with a forest of random-projection trees.

A node of a tree cuts space by the plane between two of its points, at the median.  The trees are fitted on a bounded sample (``SAMPLE_ROWS`` rows,
``SAMPLE_BYTES`` bytes), and every row is then sent down every tree to a leaf.  A query takes the leaves of all trees from one priority queue: a leaf's priority is
what the query would have to cross to get there (minus the sum of squared distances to the planes on whose wrong side it lies), and it visits leaves until their rows, counted for the whole table, reach a
share of all rows.  That share is calibrated on the sample: so many rows as ``TARGET`` of the exact neighbours of ``TRIALS`` sampled rows need.
Data without structure need a large share (half of all rows, for 64 independent components), clustered data a small one.  All rows of the visited leaves are ranked by their exact cosine in
double precision; the neighbours found by several trees are the same rows, and count once.

A leaf with many rows is divided into parts of bounded bytes and its queries into blocks, so copies of one vector, which share all leaves, are
dealt over many tasks.  Each part returns the best k of each query.  No row is left out of a leaf, and no leaf is cut off.

Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null id, take no part.  Components beyond a shorter vector's end count
as 0.  Repeated ids and repeated rows are rows of their own: each is a candidate (but for the query itself), and each query row has its own ranking.
Ties go to the smaller id.  Only ``vec_id`` and the vector are read, so other columns can have any name.  With no more than k other rows, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: The sample for fitting and calibration: rows, and bytes as 64-bit numbers.
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 64 << 20
#: Trees; rows that a leaf should have; the least depth; sampled rows that a leaf has at least.
TREES, LEAF_ROWS, LEAST_DEPTH, LEAF_SAMPLE = 4, 1024, 6, 8
#: Sampled rows whose exact neighbours are looked for, and the share of these that has to be reached.
TRIALS, TARGET = 256, 0.98
#: Bytes of vectors, as 64-bit numbers, in a part of a leaf and in a block of its queries; numbers compared at a time.
PART_BYTES, BLOCK_BYTES, COMPARED = 8 << 20, 2 << 20, 1 << 21
_CLOSE = 1e-9


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """(uid, vec_id, v): rows that take part, with a number for each."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(F.exists(name, lambda x: x != 0), F.lit(False)) & ~F.coalesce(F.exists(name, bad), F.lit(True)))
    return kept.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(name, lambda x: x.cast("double")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` components, each times a power of two that brings its largest component to 1/2 ... 1 (cosines stay the same, to the bit)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    row, at = np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = values
    _, exponent = np.frexp(np.abs(out).max(axis=1, initial=0))
    return np.ldexp(out, -exponent[:, None])


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


class Forest:
    """Planes and offsets of trees of equal depth; leaves are numbered over all trees."""

    def __init__(self, points: np.ndarray, trees: int, depth: int, seed: int = 0) -> None:
        random = np.random.default_rng(seed)
        self.depth, self.trees, width = depth, [], points.shape[1]
        for _ in range(trees):
            node, levels = np.zeros(len(points), np.int64), []
            for d in range(depth):
                planes, cut = np.zeros((2**d, width)), np.zeros(2**d)
                for k in range(2**d):
                    own = points[node == k]
                    normal = np.subtract(*own[random.choice(len(own), 2, replace=False)]) if len(own) > 1 else np.zeros(width)
                    if not np.abs(normal).max(initial=0) > 1e-12:  # copies
                        normal = random.normal(size=width)
                    planes[k] = normal / np.sqrt((normal * normal).sum())
                    cut[k] = np.median(own @ planes[k]) if len(own) else 0.0
                levels.append((planes, cut))
                node = 2 * node + ((points * planes[node]).sum(axis=1) > cut[node])
            self.trees.append(levels)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """For each point its leaf in each tree."""
        out = np.empty((len(points), len(self.trees)), np.int32)
        for t, levels in enumerate(self.trees):
            node = np.zeros(len(points), np.int64)
            for planes, cut in levels:
                node = 2 * node + ((points * planes[node]).sum(axis=1) > cut[node])
            out[:, t] = node + (t << self.depth)
        return out

    def queue(self, points: np.ndarray) -> np.ndarray:
        """All leaves of all trees for each point, the highest priority first."""
        found = []
        for levels in self.trees:
            price = np.zeros((len(points), 1))
            for planes, cut in levels:
                beyond = points @ planes.T - cut
                both = np.empty((len(points), 2 * price.shape[1]))
                both[:, 0::2] = price + np.maximum(beyond, 0) ** 2
                both[:, 1::2] = price + np.maximum(-beyond, 0) ** 2
                price = both
            found.append(price)
        return np.argsort(np.concatenate(found, axis=1), axis=1, kind="stable").astype(np.int32)


def calibrated(forest: Forest, points: np.ndarray, k: int) -> float:
    """Visited rows (once for each tree), as a multiple of all rows, within which ``TARGET`` of the exact neighbours of sampled points are met."""
    n, trials = len(points), points[:TRIALS]
    if n <= k + 1:
        return float(len(forest.trees))
    alike = trials @ points.T
    alike[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
    near = np.argpartition(-alike, k, axis=1)[:, :k]
    leaves, queue = forest.leaves(points), forest.queue(trials)
    counts = np.bincount(leaves.ravel(), minlength=queue.shape[1])
    reached = np.empty_like(queue, dtype=np.int64)  # rows visited when a leaf is done
    np.put_along_axis(reached, queue, np.cumsum(counts[queue], axis=1), axis=1)
    needed = np.min([np.take_along_axis(reached, leaves[near, t], axis=1) for t in range(len(forest.trees))], axis=0)
    return float(np.quantile(needed, TARGET)) / n


def _nearest(query: tuple, own: tuple, k: int) -> tuple[list[np.ndarray], ...]:
    """Numbers of queries and rows and their cosines: each query's k best of these rows.  Both are (uid, id, vectors, norms), rows by id."""
    (q_uid, _, q, q_norm), (uid, ids, v, norm) = query, own
    by_uid = np.argsort(uid, kind="stable")
    found: tuple[list, list, list] = ([], [], [])
    step = max(1, COMPARED // max(1, len(v)))
    for a in range(0, len(q), step):
        part = slice(a, a + step)
        cosine = (q[part] @ v.T) / (q_norm[part, None] * norm)
        at = by_uid[np.minimum(np.searchsorted(uid[by_uid], q_uid[part]), len(uid) - 1)]
        same = np.flatnonzero(uid[at] == q_uid[part])
        cosine[same, at[same]] = -np.inf
        least = np.partition(cosine, -k, axis=1)[:, -k] if len(v) > k else np.full(len(cosine), -2.0)
        row, one = np.nonzero(cosine >= np.maximum(least, -2.0)[:, None] - _CLOSE)
        exact, many = np.empty(len(row)), max(1, COMPARED // max(1, v.shape[1]))
        for b in range(0, len(row), many):  # the same sums whatever rows stand beside them
            i, j = row[b : b + many], one[b : b + many]
            exact[b : b + many] = (q[part][i] * v[j]).sum(axis=1) / (q_norm[part][i] * norm[j])
        order = np.lexsort((uid[one], ids[one], -exact, row))
        row, one, exact = row[order], one[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        for column, values in zip(found, (row[first] + a, one[first], exact[first]), strict=True):
            column.append(values)
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, name: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, part_bytes: int = PART_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that is a query (a condition on ``vec_id``).

    The index (each row with its leaves) and the queries' leaves are written to the shared folder."""
    spark = vectors.sparkSession
    base = usable(vectors, name)
    n, width = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = width or 1
    sampled = base.orderBy(F.xxhash64("uid"), "uid").limit(max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))).select("v").toArrow()  # bounded in rows and bytes
    points = matrix(sampled.column("v"), width)
    points = points / norms(points)[:, None] if n else points
    depth = max(0, min(max(LEAST_DEPTH, math.ceil(math.log2(max(1, n / leaf_rows)))), int(math.log2(max(1, len(points) / LEAF_SAMPLE)))))
    forest = Forest(points, trees, depth)
    budget = max(math.ceil(calibrated(forest, points, k) * n), trees * (k + 1))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            leaves = forest.leaves(v / norms(v)[:, None])
            yield batch.append_column("leaves", pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * trees), pa.array(leaves.ravel())))

    schema = "uid bigint, vec_id bigint, v array<double>, leaves array<int>"
    index, index_path = store.materialise(base.mapInArrow(route, schema), "neighbours-index")
    rows_of = {r.leaf: r.n for r in index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each leaf
    counts = np.array([rows_of.get(leaf, 0) for leaf in range(trees << depth)], np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, COMPARED // len(counts))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                v = matrix(part.column("v"), width)
                queue = forest.queue(v / norms(v)[:, None])
                before = np.cumsum(counts[queue], axis=1) - counts[queue]
                visited = (before < budget) & (counts[queue] > 0)
                at = np.concatenate([[0], np.cumsum(visited.sum(axis=1))]).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(at), pa.array(queue[visited]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uid", "vec_id", "v")), leaves], ["uid", "vec_id", "v", "leaves"])

    asked, asked_path = store.materialise(index.filter(is_query).select("uid", "vec_id", "v").mapInArrow(ask, schema), "neighbours-queries")
    asks_of = {r.leaf: r.n for r in asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each leaf
    divided = [(leaf, math.ceil(m * 8 * width / part_bytes), math.ceil(asks_of[leaf] * 8 * width / block_bytes)) for leaf, m in rows_of.items() if leaf in asks_of]
    plan = F.broadcast(spark.createDataFrame(divided, "leaf int, parts int, blocks int"))  # a row for each leaf
    own = lambda m, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    each = lambda rows: rows.select("uid", "vec_id", "v", F.explode("leaves").alias("leaf")).join(plan, "leaf")
    members = each(index).withColumn("part", own("parts", 3)).withColumn("block", every("blocks"))
    queries = each(asked).withColumn("block", own("blocks", 4)).withColumn("part", every("parts"))
    keys = ("leaf", "part", "block")

    def search(query: pa.Table, own: pa.Table) -> pa.Table:
        sides = []
        for side in (query, own):
            uid, ids = (side.column(c).to_numpy() for c in ("uid", "vec_id"))
            order = np.lexsort((uid, ids))
            v = matrix(side.column("v"), width)[order]
            sides.append((uid[order], ids[order], v, norms(v)))
        found = _nearest(*sides, k) if query.num_rows and own.num_rows else ([], [], [])
        row, one, score = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, (np.int64, np.int64, np.float64), strict=True))
        (q_uid, q_ids, _, _), (uid, ids, _, _) = sides
        return pa.table({"query": q_uid[row], "query_id": q_ids[row], "uid": uid[one], "vec_id": ids[one], "score": score})

    columns = ("uid", "vec_id", "v", *keys)
    met = queries.select(*columns).groupBy(*keys).cogroup(members.select(*columns).groupBy(*keys))
    found = met.applyInArrow(search, "query bigint, query_id bigint, uid bigint, vec_id bigint, score double")
    once = found.dropDuplicates(["query", "uid"])  # by several trees
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")  # k rows for each leaf visited
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
