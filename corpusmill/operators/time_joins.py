"""Joins by time: the latest earlier row, and overlapping intervals.  No key's rows have to fit one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.ranking import key_changes
from corpusmill.sources.scratch import new_folder

_RIGHT, _LEFT = 0, 1


def _carried(keys: list[str]):
    """Walks a sorted partition of both sides: each left row with the last right row of its key, and at the end the partition's last right row.

    A left row without one is open if its key has been there since the partition began: an earlier partition may have the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, opening = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key_rows = pa.Table.from_batches([batch.select(keys)])
            new = np.zeros(n, dtype=bool)
            if last is None:
                new[1:] = key_changes(key_rows, keys)
            else:
                new[:] = key_changes(pa.concat_tables([last, key_rows]), keys)
            side, at = batch.column("_side").to_numpy(), np.arange(1, n + 1)
            right = batch.column("_right")
            stock = pa.concat_arrays([right.slice(0, 0) if carry is None else carry, right])  # before the first row: what is carried
            shift = 0 if carry is None else 1
            began = np.maximum.accumulate(np.where(new, at, 0))  # 0: the key came from before this batch
            seen = np.maximum.accumulate(np.where(side == _RIGHT, at, 0))
            here = (seen > 0) & (seen >= began)
            from_before = ~here & (began == 0) & (carry is not None)
            found = np.where(here, seen - 1 + shift, 0)
            taken = stock.take(pa.array(found, mask=~(here | from_before)))
            is_open = ~here & (began == 0) & opening & (carry is None)
            left = np.flatnonzero(side == _LEFT)
            columns = {k: batch.column(k).take(pa.array(left)) for k in keys}
            columns |= {"_left": batch.column("_left").take(pa.array(left)), "_found": taken.take(pa.array(left)), "_open": pa.array(is_open[left]), "_part": pa.array(np.full(len(left), part, np.int32)), "_tail": pa.array(np.zeros(len(left), bool))}
            yield pa.RecordBatch.from_pydict(columns)
            if here[-1]:
                carry = right.slice(seen[-1] - 1, 1)
            elif began[-1]:
                carry = None
            opening = opening and not new.any()
            last = key_rows.slice(n - 1)
        if last is not None:
            none = batch.column("_left").slice(0, 0)
            columns = {k: last.column(k).combine_chunks() for k in keys} | {"_left": pa.nulls(1, none.type), "_found": pa.nulls(1, right.type) if carry is None else carry}
            yield pa.RecordBatch.from_pydict(columns | {"_open": pa.array([False]), "_part": pa.array([part], pa.int32()), "_tail": pa.array([True])})

    return run


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, right_time: str | None = None, ties: Sequence[str] = (), within: Column | None = None, strict: bool = False) -> DataFrame:
    """Every left row with the latest right row of its key at or before (``strict``: before) its time; nulls where there is none.

    Both sides are range-partitioned by key, time and the row's place in the input together, so one key's rows go over as many tasks as their number needs, and so do
    rows of one key and time.  The last right row is carried from row to row, and over the edges by one row for each partition.
    Of right rows of one key and time the greatest by ``ties`` is taken.  ``within`` is the most that may lie between (an interval).  Rows with a null key or time match nothing.
    The result has the left columns and those right columns that aren't keys; other names must differ."""
    spark, by, right_time = left.sparkSession, list(by), right_time or time
    usable = lambda rows, t: [F.col(c).isNotNull() for c in (*by, t)]
    whole = lambda marks: F.coalesce(*(F.when(~m, F.lit(False)) for m in marks), F.lit(True))
    extra = [c for c in right.columns if c not in by]
    clash = set(extra) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    keys = [f"_by{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    packed = lambda names: F.struct(*names)
    left_kind, right_kind = left.select(packed(left.columns)).schema[0].dataType, right.select(packed(extra)).schema[0].dataType
    order = 1 if strict else 0
    a = left.filter(whole(usable(left, time))).select(*named, F.col(time).alias("_time"), F.lit(1 - order).alias("_first"), F.lit(_LEFT).alias("_side"), packed(left.columns).alias("_left"), F.lit(None).cast(right_kind).alias("_right"), F.lit(None).cast(right.select(F.struct(F.lit(0), *ties)).schema[0].dataType).alias("_tie"))
    b = right.filter(whole(usable(right, right_time))).select(*named, F.col(right_time).alias("_time"), F.lit(order).alias("_first"), F.lit(_RIGHT).alias("_side"), F.lit(None).cast(left_kind).alias("_left"), packed(extra).alias("_right"), F.struct(F.lit(0), *ties).alias("_tie"))
    both = a.unionByName(b).withColumn("_spread", F.monotonically_increasing_id())
    sort = [*keys, "_time", "_first", "_tie", "_spread"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).select(*keys, "_side", "_left", "_right")
    key_fields = dealt.schema.fields[: len(keys)]
    schema = T.StructType([*key_fields, T.StructField("_left", left_kind), T.StructField("_found", right_kind), T.StructField("_open", T.BooleanType()), T.StructField("_part", T.IntegerType()), T.StructField("_tail", T.BooleanType())])
    path = new_folder(spark, "as-of")
    dealt.mapInArrow(_carried(keys), schema).write.parquet(path)
    walked = spark.read.schema(schema).parquet(path)

    tails = walked.filter("_tail").select("_part", F.when(F.col("_found").isNotNull(), F.struct(*keys, "_found")).alias("_last"))
    line = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = tails.select("_part", F.last("_last", ignorenulls=True).over(line).alias("_before"))
    joined = walked.filter("not _tail").join(F.broadcast(carried), "_part")  # a row for each partition
    same = F.col("_open") & F.col("_before").isNotNull()
    for k in keys:
        same = same & (F.col(k) == F.col(f"_before.{k}"))
    joined = joined.select("_left", F.when(F.coalesce(same, F.lit(False)), F.col("_before._found")).otherwise(F.col("_found")).alias("_found"))
    if within is not None:
        joined = joined.withColumn("_found", F.when(F.col(f"_found.{right_time}") >= F.col(f"_left.{time}") - within, F.col("_found")))
    met = joined.select(*(F.col(f"_left.{c}").alias(c) for c in left.columns), *(F.col(f"_found.{c}").alias(c) for c in extra))
    alone = left.filter(~whole(usable(left, time))).select(*left.columns, *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra))
    return met.unionByName(alone)


#: Each level's buckets are so many times as wide as those of the level below.
STEP = 4


def _bucket(at: Column, width: Column) -> Column:
    """The number of the bucket that holds a whole number: what is divided is a multiple of the width, so the quotient is exact (below 2^53)."""
    return ((at - F.pmod(at, width)) / width).cast("long")


def _buckets(span: tuple[str, str], level: int, width: int) -> Column:
    """(level, bucket) of all of a level's buckets that an interval touches."""
    w = F.lit(width).cast("long")
    return F.transform(F.sequence(_bucket(F.col(span[0]), w), _bucket(F.col(span[1]) - 1, w)), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bucket")))


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str], span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of one key whose intervals [begin, end) share a moment; begins and ends are whole numbers.

    Buckets come in levels of growing width.  An interval lives at the level whose buckets are at least as wide as it is long, so in two
    buckets at most, and visits two buckets of each wider level; a long interval isn't copied into many short buckets.  Of two intervals the longer
    one's level decides, and a pair is made only in that level's bucket where the later one begins, so once.  Rows with a null key or end, and empty
    intervals, match nothing.  Names of both sides must differ but for the keys."""
    by = list(by)
    clash = (set(left.columns) & set(right.columns)) - set(by)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    length = lambda s: F.col(s[1]) - F.col(s[0])
    sizes = [rows.filter(length(s) > 0).agg(F.percentile_approx(length(s), 0.5), F.max(length(s))).first() for rows, s in ((left, span), (right, right_span))]
    base = max(1, min((int(m) for m, _ in sizes if m is not None), default=1))
    widths = [base]
    while widths[-1] < max((int(m) for _, m in sizes if m is not None), default=1):
        widths.append(widths[-1] * STEP)

    def dealt(rows: DataFrame, s: tuple[str, str], home: str) -> DataFrame:
        own = F.lit(len(widths) - 1)
        for level in range(len(widths) - 2, -1, -1):
            own = F.when(length(s) <= widths[level], F.lit(level)).otherwise(own)
        places = [_buckets(s, level, width) for level, width in enumerate(widths)]
        none = F.array().cast("array<struct<level: int, bucket: bigint>>")
        levels = [F.when(F.col(home) <= level, p).otherwise(none) for level, p in enumerate(places)]
        some = rows.filter(length(s) > 0).withColumn(home, own)
        return some.withColumn("_place", F.explode(F.concat(*levels))).withColumns({"_level": F.col("_place.level"), "_bucket": F.col("_place.bucket")}).drop("_place")

    met = dealt(left, span, "_home").join(dealt(right, right_span, "_right_home"), [*by, "_level", "_bucket"])
    later, width = F.greatest(F.col(span[0]), F.col(right_span[0])), F.lit(widths[-1])
    for level in range(len(widths) - 2, -1, -1):
        width = F.when(F.col("_level") == level, F.lit(widths[level])).otherwise(width)
    share = (F.col(span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(span[1]))
    once = (F.col("_level") == F.greatest("_home", "_right_home")) & (_bucket(later, width.cast("long")) == F.col("_bucket"))
    return met.filter(share & once).drop("_level", "_bucket", "_home", "_right_home")
