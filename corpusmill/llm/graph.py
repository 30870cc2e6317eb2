"""Connected components of an edge table, by large-star and small-star steps.

Every step replaces edges by edges to a smaller neighbour; when nothing changes, every
vertex points at the smallest of its component.  Vertices and edges stay distributed;
a hub's edges are reduced by partial minima and met by joins that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v), u > v, distinct."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(u, v): each vertex of ``edges`` (u, v) that isn't its component's smallest, and the smallest;
    and the path of the table that holds it."""
    spark = edges.sparkSession
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, path = store.materialise(ordered, "edges")
    digest = None
    while True:
        following, next_path = store.materialise(_stars(_stars(now, True), False), "edges")
        store.release(spark, path)
        now, path = following, next_path
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == digest:
            return now, path
        digest = found
