"""Two streams joined in a bound of time, and a packer that is steered while it runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def joined_within(left: DataFrame, right: DataFrame, by: Sequence[str], times: tuple[str, str], before: str, late: str) -> DataFrame:
    """Pairs of rows of one key, the right one at most ``before`` (an interval) earlier than the left one, and not later.

    On streams both sides are kept until the watermark says that no partner can come any more: a right row for ``before`` and ``late``, a left row for ``late``.
    Rows that come later than ``late`` behind the slower stream are dropped, and counted in the query's progress.  On tables
    it is the same join without state.  Names must differ but for the keys."""
    a, b = (rows.withColumn(t, F.col(t).cast("timestamp")) for rows, t in zip((left, right), times, strict=True))
    if left.isStreaming:
        a, b = a.withWatermark(times[0], late), b.withWatermark(times[1], late)
    keys = [f"_by{i}" for i in range(len(by))]
    b = b.withColumnsRenamed(dict(zip(by, keys, strict=True)))
    met = (F.col(times[1]) <= F.col(times[0])) & (F.col(times[1]) >= F.col(times[0]) - F.expr(f"INTERVAL {before}"))
    for k, own in zip(by, keys, strict=True):
        met = met & (F.col(k) == F.col(own))
    return a.join(b, met).drop(*keys)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Windows given out, and runs of ids put in order, at a time.
WINDOWS = 1 << 12


def _in_order(places: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Runs of ids, one after another in ``flat``, in the order of their places."""
    if (places[1:] >= places[:-1]).all():
        return flat
    order, begin, out, at = np.argsort(places, kind="stable"), np.cumsum(sizes) - sizes, np.empty_like(flat), 0
    for i in range(0, len(order), WINDOWS):
        own = order[i : i + WINDOWS]
        shift = np.cumsum(sizes[own]) - sizes[own]
        n = int(sizes[own].sum())
        out[at : at + n] = flat[np.repeat(begin[own] - shift, sizes[own]) + np.arange(n)]
        at += n
    return out


class _Packer(StatefulProcessor):
    """State of a stream: tokens that don't fill a window yet, the number of its next window, and the length that holds from the next batch on."""

    def __init__(self, length: int) -> None:
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "ids binary")
        self.place = handle.getValueState("place", "step bigint, length int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        step, length = self.place.get() if self.place.exists() else (0, self.length)
        none = np.zeros(0, np.int32)
        places, sizes, flat, order = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [none], None
        for part in rows:  # kept as plain numbers, without an object for each row
            tokens = part[part["length"].isna() & part["ids"].notna()]
            places.append(tokens["position"].to_numpy())
            sizes.append(np.fromiter(map(len, tokens["ids"]), np.int64, len(tokens)))
            flat.append(np.concatenate([none, *tokens["ids"]]).astype(np.int32))
            for place, new in part.loc[part["length"].notna(), ["position", "length"]].itertuples(index=False):
                order = (place, new) if order is None or place >= order[0] else order
        rest = np.frombuffer(self.rest.get()[0], np.int32) if self.rest.exists() else none
        held = np.concatenate([rest, _in_order(np.concatenate(places), np.concatenate(sizes), np.concatenate(flat))])
        n = max(0, (len(held) - 1) // length)  # neighbours share a token
        self.rest.update((held[n * length :].tobytes(),))
        self.place.update((int(step) + n, int(order[1]) if order else int(length)))
        for a in range(0, n, WINDOWS):
            b = min(a + WINDOWS, n)
            inputs, targets = (held[s + a * length : s + b * length].reshape(b - a, length) for s in (0, 1))
            yield pd.DataFrame({"stream": [key[0]] * (b - a), "step": np.arange(step + a, step + b), "inputs": list(inputs), "targets": list(targets)})

    def close(self) -> None:
        pass


def steered_packing(tokens: DataFrame, control: DataFrame, length: int) -> DataFrame:
    """(stream, step, inputs, targets): windows of a stream's tokens whose length can be changed while the query runs.

    ``tokens``: (stream, position, ids); ``control``: (stream, position, length), the orders.  What comes in a micro-batch is cut with the length that holds when it begins;
    an order (the one with the greatest position, if there are several) holds from the next micro-batch on, and across restarts.  State is kept in RocksDB, whose rows a stream's rest
    (shorter than a window) and two numbers are."""
    spark = tokens.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    none = lambda kind: F.lit(None).cast(kind)
    both = tokens.select("stream", "position", F.col("ids").cast("array<int>").alias("ids"), none("double").alias("length"))
    both = both.unionByName(control.select("stream", "position", none("array<int>").alias("ids"), F.col("length").cast("double").alias("length")))
    return both.groupBy("stream").transformWithStateInPandas(_Packer(length), "stream string, step bigint, inputs array<int>, targets array<int>", "Append", "None")


def run_lot(stream: DataFrame, out: str, checkpoint: str) -> list[dict]:
    """Takes all that has come, to the end; returns the progress of the batches."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "dropped": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]), "state": sum(s["numRowsTotal"] for s in p["stateOperators"])} for p in query.recentProgress]


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that are put into a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).mkdirs(where)  # a stream's folder has to be there
    return spark.readStream.schema(schema).parquet(path)
