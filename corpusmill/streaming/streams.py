"""Structured Streaming: metric events, late data, resumed ingestion, a stateful token packer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

METRICS = "event string, step int, t_elapsed double, train_loss double, tokens_per_s double, mfu double, val_macro double, val_per_source map<string, double>, text_val double"


def metric_events(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Events appended as JSON lines while a run goes on; lines of all kinds share one wide schema."""
    return spark.readStream.schema(METRICS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def event_totals(events: DataFrame) -> DataFrame:
    """Running count, last step and mean loss of each kind of event."""
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step"), F.avg("train_loss").alias("mean_loss"))


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of tumbling or sliding windows; rows later than ``late`` are dropped.  Works on streams and on tables."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def session_counts(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def pack_stream(tokens: DataFrame, length: int, changes: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """(stream, step, inputs, targets): windows of ``length`` + 1 tokens from a stream of (stream, position, ids), one token shared
    by neighbours.  ``changes`` are (step, length): from that window on the other length holds.  The state of a stream is its rest
    (shorter than a window) and the number of its next window, so another ``length`` or other changes, given to a query
    that continues from the checkpoint, hold from the next window on."""
    schedule = sorted(changes)

    def length_at(step: int) -> int:
        own = [n for first, n in schedule if first <= step]
        return own[-1] if own else length

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, rest = state.get if state.exists else (0, b"")
        parts = sorted(((p, np.asarray(i, np.int32)) for f in frames for p, i in zip(f.position, f.ids, strict=True)), key=lambda x: x[0])
        held = np.concatenate([np.frombuffer(rest, np.int32), *(ids for _, ids in parts)])
        begin, out = 0, []
        while len(held) - begin >= (n := length_at(step)) + 1:
            out.append((key[0], step, held[begin : begin + n], held[begin + 1 : begin + n + 1]))
            begin, step = begin + n, step + 1
        state.update((step, held[begin:].tobytes()))
        yield pd.DataFrame(out, columns=["stream", "step", "inputs", "targets"])

    return tokens.groupBy("stream").applyInPandasWithState(run, "stream string, step bigint, inputs array<int>, targets array<int>", "step bigint, rest binary", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, out: str, checkpoint: str):
    """Run what is there to the end; a later call goes on after the files already taken."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_metrics(events: DataFrame, out: str, checkpoint: str):
    query = events.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
