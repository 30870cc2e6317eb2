"""Ranks over a whole table, without a window that holds all rows.

Rows are range-partitioned and sorted by their keys; ties are spread by the row's place in the input, so a key of any share of the rows
is dealt over several partitions.  Each partition numbers its rows and its runs of equal keys as they stream by; what a partition needs
from those before it (rows, distinct keys, and where a run that straddles the edge began) comes from one summary row for each partition.

Nulls come first in ascending order and last in descending order and are equal to each other, as are NaNs.  Rows that tie in all keys
get consecutive row numbers in no stated order.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources.scratch import new_folder

_PLACES = (("_part", T.IntegerType()), ("_at", T.LongType()), ("_run_at", T.LongType()), ("_run", T.LongType()))


def key_changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """For each row but the first: does any key differ from the row before?"""
    out = np.zeros(table.num_rows - 1, dtype=bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        here, before = column[1:], column[:-1]
        same = pc.fill_null(pc.equal(here, before), False)
        same = pc.or_(same, pc.and_(pc.is_null(here, nan_is_null=True), pc.is_null(before, nan_is_null=True)))
        if pa.types.is_floating(column.type):  # a null isn't a NaN
            same = pc.and_(same, pc.equal(pc.is_null(here), pc.is_null(before)))
        out |= ~same.to_numpy(zero_copy_only=False)
    return out


def _numbering(keys: list[str]):
    """Adds a partition's number, the row's place in it, the place where the row's run began, and the run's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, run_at, runs, last = TaskContext.get().partitionId(), 0, 0, -1, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key_rows = pa.Table.from_batches([batch.select(keys)])
            new = np.ones(n, dtype=bool)
            if last is None:
                new[1:] = key_changes(key_rows, keys)
            else:
                new[:] = key_changes(pa.concat_tables([last, key_rows]), keys)
            at = seen + np.arange(n)
            began = np.maximum.accumulate(np.where(new, at, run_at))
            number = runs + np.cumsum(new)
            for name, values in zip(("_part", "_at", "_run_at", "_run"), (np.full(n, part, np.int32), at, began, number), strict=True):
                batch = batch.append_column(name, pa.array(values))
            yield batch
            seen, run_at, runs, last = seen + n, int(began[-1]), int(number[-1]), key_rows.slice(n - 1)

    return run


def ranks(rows: DataFrame, order: Sequence[str | tuple[str, bool]], tiles: int | None = None) -> DataFrame:
    """Adds row_number, rank, dense_rank, percent_rank (and ntile of ``tiles``) in the order of columns, a pair with True being descending.

    The sorted rows are written once to the shared folder; all ranks are read from there."""
    keys = [(k, False) if isinstance(k, str) else k for k in order]
    names = [k for k, _ in keys]
    sort: list[Column] = [F.col(k).desc() if down else F.col(k).asc() for k, down in keys]
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("_spread", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(parts, *sort, "_spread").sortWithinPartitions(*sort, "_spread").drop("_spread")
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(n, t) for n, t in _PLACES)])
    path = new_folder(spark, "ranks")
    dealt.mapInArrow(_numbering(names), schema).write.parquet(path)
    placed = spark.read.schema(schema).parquet(path)

    key = F.struct(*names)
    summary = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.max("_run").alias("_last_run"), F.max("_run_at").alias("_last_at"), F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_end"))
    line = Window.partitionBy(F.lit(0)).orderBy("_part")  # a row for each partition
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_goes_on", F.coalesce(F.col("_first").eqNullSafe(F.lag("_end").over(line)) & F.lag("_n").over(line).isNotNull(), F.lit(False)))
    summary = summary.withColumns({"_rows": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(F.lit(0)))})
    opened = F.when(~(F.col("_goes_on") & (F.col("_last_run") == 0)), F.col("_rows") + F.col("_last_at"))  # where the partition's last run began, if it began there
    summary = summary.withColumn("_carried", F.last(opened, ignorenulls=True).over(earlier))
    runs = F.col("_last_run") + 1 - F.col("_goes_on").cast("long")
    summary = summary.withColumn("_runs", F.coalesce(F.sum(runs).over(earlier), F.lit(0)) - F.col("_goes_on").cast("long"))

    out = placed.join(F.broadcast(summary.select("_part", "_rows", "_all", "_goes_on", "_carried", "_runs")), "_part")  # a row for each partition
    number = (F.col("_rows") + F.col("_at") + 1).cast("long")
    rank = F.when(F.col("_goes_on") & (F.col("_run_at") == 0), F.col("_carried")).otherwise(F.col("_rows") + F.col("_run_at")) + 1
    found = {"row_number": number, "rank": rank.cast("long"), "dense_rank": (F.col("_runs") + F.col("_run") + 1).cast("long")}
    found["percent_rank"] = F.when(F.col("_all") > 1, (rank - 1) / (F.col("_all") - 1)).otherwise(F.lit(0.0))
    if tiles is not None:
        if tiles < 1:
            raise ValueError("at least one tile")
        size, larger = F.floor(F.col("_all") / tiles), F.col("_all") % tiles  # the first tiles have a row more
        before = number - 1
        found["ntile"] = F.when(before < larger * (size + 1), F.floor(before / (size + 1))).otherwise(larger + F.floor((before - larger * (size + 1)) / F.greatest(size, F.lit(1)))).cast("long") + 1
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(c.alias(n) for n, c in found.items()))
