"""Evaluation: span-masked bits per byte, choice accuracy, averaged losses, run logs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import selection
from corpusmill.operators.corpus import pieces, with_ids


def prepare_spans(docs: DataFrame, encode: Callable[[list[str]], list[list[int]]], decode_bytes: Callable[[list[int]], int], max_len: int) -> DataFrame:
    """Adds (ids, cont_start, n_bytes) to (text, spans): the first span's start as a token, cut from the left to ``max_len``,
    and the bytes of what is scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, "text")):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            begin = [(s[0][0] if s and s[0] else 0) for s in batch.column("spans").to_pylist()]
            full, head = encode(texts), encode([t[:c] for t, c in zip(texts, begin, strict=True)])
            out: tuple[list, ...] = ([], [], [])
            for ids, before in zip(full, head, strict=True):
                start = max(0, min(len(before), len(ids) - 1))
                cut = max(0, len(ids) - max_len)
                out[2].append(decode_bytes(ids[max(start, cut) :]))
                out[0].append(ids[cut:])
                out[1].append(max(0, start - cut))
            yield batch.append_column("ids", pa.array(out[0], pa.list_(pa.int32()))).append_column("cont_start", pa.array(out[1], pa.int32())).append_column("n_bytes", pa.array(out[2], pa.int64()))

    return docs.mapInArrow(run, T.StructType([*with_ids(docs.schema).fields, T.StructField("cont_start", T.IntegerType()), T.StructField("n_bytes", T.LongType())]))


def bits_per_byte(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro-averaged (bpb, ppl, tokens) from (ids, cont_start, n_bytes, nats); documents of fewer than two tokens or with a
    sum that isn't finite are left out.  Without tokens both are NaN; text of no bytes counts as one."""
    first = F.greatest(F.col("cont_start") - 1, F.lit(0))
    tail = F.slice("nats", first + 1, F.greatest(F.size("nats") - first, F.lit(0)))
    rows = scored.filter(F.size("ids") >= 2).withColumn("_nats", F.aggregate(tail, F.lit(0.0), lambda a, x: a + x)).withColumn("_n", F.size(tail))
    rows = rows.filter(~F.isnan("_nats") & (F.abs("_nats") < float("inf")) & (F.col("_n") > 0))
    sums = rows.groupBy(*(by or [])).agg(F.sum("_nats").alias("nats"), F.sum("_n").alias("tokens"), F.sum("n_bytes").alias("bytes"))
    nan = F.lit(float("nan"))
    bpb = F.when(F.col("tokens") > 0, F.col("nats") / F.lit(math.log(2)) / F.greatest("bytes", F.lit(1))).otherwise(nan)
    ppl = F.when(F.col("tokens") > 0, F.exp(F.col("nats") / F.col("tokens"))).otherwise(nan)
    return sums.select(*(by or []), bpb.alias("bpb"), ppl.alias("ppl"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def set_columns(by_set: DataFrame, sets: list[str], key: str) -> DataFrame:
    """One row for each key, with the metrics of each set as columns <set>_bpb and <set>_ppl."""
    return by_set.groupBy(key).pivot("set", sets).agg(F.first("bpb").alias("bpb"), F.first("ppl").alias("ppl"))


def choice_accuracy(losses: DataFrame, task: str = "task_id") -> DataFrame:
    """(correct, tasks, accuracy) from (task, ending, loss, n_tokens, label): the ending with the lowest mean loss wins, the first on ties."""
    best = losses.groupBy(task).agg(F.min_by("ending", F.struct((F.col("loss") / F.col("n_tokens")).alias("m"), "ending")).alias("picked"), F.first("label").alias("label"))
    return best.agg(F.sum((F.col("picked") == F.col("label")).cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("tasks"), F.avg((F.col("picked") == F.col("label")).cast("double")).alias("accuracy"))


def macro_loss(losses: DataFrame, source: str = "source", batch: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Per source the mean of its batches' weighted means, and the plain mean over sources."""
    each = losses.groupBy(source, batch).agg((F.sum(F.col("loss") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1.0))).alias("m"))
    by_source = each.groupBy(source).agg(F.avg("m").alias("loss"))
    return by_source, by_source.agg(F.avg("loss").alias("macro"))


def weighted_mean(loss: str, weight: str):
    return F.sum(F.col(loss) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))


# -- run logs -----------------------------------------------------------------------------------------


def segment_runs(lines: DataFrame, file: str = "file", order: str = "line_no", step: str = "step") -> DataFrame:
    """Adds ``run``: a new one begins at each step 0."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    begins = F.sum(F.when(F.col(step) == 0, 1).otherwise(0)).over(w)
    any_zero_first = F.first(F.when(F.col(step) == 0, 1).otherwise(0)).over(w)
    return lines.withColumn("run", (begins - any_zero_first).cast("bigint"))


def average_runs(rows: DataFrame, keys: list[str], step: str = "step", loss: str = "val_loss") -> DataFrame:
    """Mean loss at each step over the runs of a result."""
    return rows.groupBy(*keys, step).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("runs"))


def result_curves(results: DataFrame, log_rows: DataFrame) -> DataFrame:
    """(result, step, loss, runs) up to each result's number of steps; a result without a log is an error."""
    curves = average_runs(log_rows, ["result"])
    joined = results.join(curves, "result", "left")
    checked = joined.withColumn("step", F.when(F.col("step").isNull(), F.raise_error(F.concat(F.lit("no log for result "), F.col("result").cast("string")))).otherwise(F.col("step")))
    return checked.filter(F.col("step") <= F.col("steps_to_target")).select("result", "step", "loss", "runs")


def last_match(lines: DataFrame, file: str = "file", order: str = "line_no", loss: str = "val_loss") -> DataFrame:
    return lines.groupBy(file).agg(F.max_by(loss, order).alias(loss))


def common_cells(rows: DataFrame, cell: list[str], file: str = "file") -> DataFrame:
    """Cells that every file has."""
    n = rows.agg(F.count_distinct(file).alias("_files"))
    each = rows.groupBy(*cell).agg(F.count_distinct(file).alias("_n"))
    return each.join(F.broadcast(n), F.col("_n") == F.col("_files")).select(*cell)  # one row


def moving_means(rows: DataFrame, by: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """Adds the mean of the last ``k`` values and of all so far."""
    if k < 1:
        raise ValueError("a window has at least one value")
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"moving": F.avg(value).over(w.rowsBetween(-(k - 1), 0)), "lifetime": F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def steady_state(events: DataFrame, skip: int = 5) -> DataFrame:
    """Median and mean throughput and utilisation after the first steps."""
    rows = events.filter(F.col("step") >= skip)
    medians = {c: selection.percentiles(rows, c, [0.5])[0] for c in ("tokens_per_s", "mfu")}
    means = rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in medians))
    return means.select(*(x for c, m in medians.items() for x in (F.lit(m).cast("double").alias(f"median_{c}"), F.col(f"mean_{c}"))))


def warm_up_steps(transitions: DataFrame, step: str = "step") -> DataFrame:
    """Distinct steps to try out before a run: 0 and 1, and the last two before and the first two of each transition (from 2 on)."""
    around = transitions.select(F.explode(F.transform(F.array(*map(F.lit, (-2, -1, 0, 1))), lambda o: F.col(step) + o)).alias("step")).filter("step >= 2")
    first = transitions.sparkSession.range(2).select(F.col("id").cast(around.schema["step"].dataType).alias("step"))
    return first.union(around).distinct()
