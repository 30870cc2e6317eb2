"""Batches from token streams: contiguous windows, document-aligned packing, choice tasks, collation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.scalar import bigram_hash
from corpusmill.operators.corpus import START_ID, TEXT_SHARE, numbered, pieces, prefix_sums, speech_mixture
from corpusmill.sources.scratch import new_folder

# Sizes of the offsets vector for the usual numbers of tokens in a batch.
MAX_DOCS = {16384: 64, 32768: 96, 49152: 128}


def max_docs(n_tokens: int) -> int:
    return MAX_DOCS.get(n_tokens, max(1, math.ceil(n_tokens // 300 / 128)) * 128)


# -- contiguous windows ----------------------------------------------------------------------------


def windows(shards: DataFrame, batch: int, ranks: int = 1, skip: int = 0, n: str = "n_tokens") -> DataFrame:
    """(step, rank, begin, length) of every shard's whole batches, in closed form; a window has one token more
    than it predicts.  ``skip`` leaves out a shard's first batches."""
    count = F.floor((F.col(n) - 2) / batch)
    rows = shards.withColumn("_count", count).filter(F.col("_count") > skip)
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(skip).cast("bigint"), F.col("_count") - 1))).drop("_count")
    rows = rows.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    per = batch // ranks
    return rows.withColumn("begin", F.col("step") * batch + F.col("rank") * per).withColumn("length", F.lit(per + 1))


def cyclic_windows(shards: DataFrame, steps: int, batch: int, ranks: int = 1, order: str = "shard", n: str = "n_tokens") -> DataFrame:
    """``windows`` numbered over all shards, starting again after the last, until there are ``steps``."""
    found = windows(shards, batch, 1, n=n)
    per_shard = shards.select(order, F.greatest(F.floor((F.col(n) - 2) / batch), F.lit(0)).alias("_k"))
    before = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per_shard = per_shard.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).withColumn("_all", F.sum("_k").over(Window.partitionBy(F.lit(0))))
    rows = found.join(per_shard, order).withColumn("_at", F.col("_before") + F.col("step")).filter("_all > 0")
    rounds = F.sequence(F.lit(0).cast("bigint"), F.floor((F.lit(steps - 1) - F.col("_at")) / F.col("_all")))
    rows = rows.filter(F.col("_at") < steps).withColumn("_round", F.explode(rounds)).withColumn("step", F.col("_at") + F.col("_round") * F.col("_all"))
    per = batch // ranks
    rows = rows.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1)))).withColumn("begin", F.col("begin") + F.col("rank") * per)
    return rows.withColumn("length", F.lit(per + 1)).drop("_k", "_before", "_all", "_at", "_round")


def rank_cyclic_windows(shards: DataFrame, steps: int, batch: int, ranks: int, order: str = "shard", n: str = "n_tokens") -> DataFrame:
    """(step, rank, shard, begin, length): each rank has a cursor of its own over all shards, starting again after the last.

    A rank starts a shard at rank * batch and goes on by ranks * batch; it leaves the shard when its next stride doesn't fit, so
    ranks may change shards at different steps.  Every shard gives each rank one batch at least."""
    stride = batch * ranks
    rows = shards.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    rows = rows.withColumn("_k", F.greatest(F.lit(1).cast("bigint"), F.floor((F.col(n) - 1 - F.col("rank") * batch) / stride)))
    rows = _laps(rows, ["rank"], order, steps)
    return rows.withColumns({"begin": F.col("rank") * batch + F.col("_i") * stride, "length": F.lit(batch + 1)}).drop("_i")


def rank_stride_windows(streams: DataFrame, steps: int, length: int, ranks: int, key: str = "stream", n: str = "n_tokens") -> DataFrame:
    """(key, step, rank, begin, length): each rank starts a stream at rank * length, goes on by ranks * length, and rewinds to its start
    when the next window doesn't fit.  A stream without a window for a rank is an error."""
    rows = streams.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    count = F.floor((F.col(n) - 1 - length * (F.col("rank") + 1)) / (ranks * length)) + 1
    rows = rows.withColumn("_k", F.when(count > 0, count).otherwise(F.raise_error(F.lit("a stream is shorter than a window of each rank"))))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps - 1).cast("bigint"))))
    return rows.withColumns({"begin": (F.col("rank") + F.pmod("step", F.col("_k")) * ranks) * length, "length": F.lit(length + 1)}).drop("_k")


def _laps(rows: DataFrame, by: list[str], order: str, steps: int) -> DataFrame:
    """Adds (step, _i): a group's rows give ``_k`` items each, in order, again and again, until the group has ``steps``.

    The rows are shards, a dimension."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_before": F.coalesce(F.sum("_k").over(before), F.lit(0)), "_all": F.sum("_k").over(whole)})
    rows = rows.filter("_k > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1))).withColumn("_at", F.col("_before") + F.col("_i"))
    rounds = F.sequence(F.lit(0).cast("bigint"), F.floor((F.lit(steps - 1) - F.col("_at")) / F.col("_all")))
    rows = rows.filter(F.col("_at") < steps).withColumn("_round", F.explode(rounds))
    return rows.withColumn("step", F.col("_at") + F.col("_round") * F.col("_all")).drop("_k", "_before", "_all", "_at", "_round")


#: Blocks that are looked up together.
CELL = 64


def pool_blocks(draws: DataFrame, shards: DataFrame, block: int) -> DataFrame:
    """(step, pool, shard, begin, length, tiled): the block that each draw of a pool reads at the pool's cursor.

    ``draws``: (step, pool, k), k the number of earlier draws of the pool; ``shards``: (pool, shard, n_tokens), shards from 0.  A block has
    ``block`` + 1 tokens and the cursor goes on by ``block``; a shard that is used up gives way to the next, and the first follows the last.
    Where all of a pool's shards are too short, the shard two further on is repeated until it fills the block."""
    blocks = F.greatest(F.floor((F.col("n_tokens") - 1) / block), F.lit(0).cast("bigint"))
    cut = numbered(shards.select("pool", "shard", blocks.alias("_blocks")), "shard", "_i", "pool")
    pools = cut.groupBy("pool").agg(F.sum("_blocks").alias("_all"), F.count(F.lit(1)).alias("_shards"))
    rows = draws.join(pools, "pool").withColumn("_at", F.when(F.col("_all") > 0, F.pmod("k", F.col("_all"))))
    ranges = prefix_sums(cut.filter("_blocks > 0"), "shard", "_blocks", "_first", "pool")
    ranges = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_first") / CELL), F.floor((F.col("_first") + F.col("_blocks") - 1) / CELL))))  # a shard's blocks by cells: an equi-join finds them
    found = rows.filter("_all > 0").withColumn("_cell", F.floor(F.col("_at") / CELL)).join(ranges.select("pool", "shard", "_first", "_blocks", "_cell"), ["pool", "_cell"])
    found = found.filter((F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_first") + F.col("_blocks"))).withColumn("begin", (F.col("_at") - F.col("_first")) * block)
    short = rows.filter("_all = 0").withColumn("_i", F.pmod(2 * (F.col("k") + 1), F.col("_shards"))).join(cut.select("pool", "shard", "_i"), ["pool", "_i"]).withColumn("begin", F.lit(0).cast("bigint"))
    columns = ["step", "pool", "shard", "begin", "_all"]
    return found.select(columns).unionByName(short.select(columns)).select("step", "pool", "shard", "begin", F.lit(block + 1).alias("length"), (F.col("_all") == 0).alias("tiled"))


def stream_documents(shards: DataFrame, target: int, length: int, order: str = "shard", n: str = "n_tokens") -> DataFrame:
    """(shard, begin, length): documents of ``length`` tokens cut from shards in order, until ``target`` tokens are taken; what is left of
    a shard is a shorter document.  Shards are a dimension."""
    before = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = shards.withColumn("_left", F.lit(target) - F.coalesce(F.sum(n).over(before), F.lit(0)))
    rows = rows.withColumn("_take", F.least(F.col(n), F.col("_left"))).filter("_take > 0")
    rows = rows.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_take") - 1, F.lit(length).cast("bigint"))))
    return rows.withColumn("length", F.least(F.lit(length), F.col("_take") - F.col("begin"))).drop("_left", "_take")


def rechunked_mixture(speech: DataFrame, shards: DataFrame, target: int, weights: dict[str, int], length: int, share: float = 0.01, seed: int = 0, bound: int = 66647) -> DataFrame:
    """The mixture of speech and text whose text part is cut from token shards: documents of ``length`` tokens, until text has its part of the target.

    ``speech``: (doc_id, source, n_tokens, max_id); ``shards``: (shard, n_tokens, max_id), a dimension.  Text documents are numbered through the shards, and
    the result has the shard and the begin of each (null for speech), so that it can be fetched."""
    cut = stream_documents(shards, int(target * TEXT_SHARE), length)
    text = numbered(cut.withColumn("_key", F.col("shard") * (1 << 32) + F.col("begin")), "_key", "doc_id").select("doc_id", "shard", "begin", F.col("length").cast("bigint").alias("n_tokens"), "max_id")
    mixed = speech_mixture(speech, text.select("doc_id", "n_tokens", "max_id"), target, weights, share, seed, bound)
    places = text.select(F.lit("text").alias("source"), "doc_id", "shard", "begin")
    return mixed.join(places, ["source", "doc_id"], "left")


# -- document-aligned packing ---------------------------------------------------------------------


def pack_documents(lengths: np.ndarray, per_rank: int, longest: int, ranks: int = 1) -> list[list[tuple[int, int]]]:
    """Bins of (document, tokens taken): documents in order, each cut to ``longest``, until a bin has per_rank + 1
    tokens; the last one is cut to fit and its rest dropped.  Bins come in steps of ``ranks``; an incomplete step is dropped."""
    capped = np.minimum(lengths, longest)
    total = np.concatenate([[0], np.cumsum(capped)])
    bins, s, n = [], 0, len(lengths)
    while s < n:
        j = int(np.searchsorted(total, total[s] + per_rank + 1, side="left"))
        if j > n:
            break
        taken = capped[s:j].copy()
        taken[-1] = per_rank + 1 - (total[j - 1] - total[s])
        bins.append([(s + k, int(t)) for k, t in enumerate(taken)])
        s = j
    return bins[: len(bins) // ranks * ranks]


def pack_shards(tokens: DataFrame, per_rank: int, longest: int, ranks: int = 1, buckets: int | None = None, start_id: int = START_ID) -> DataFrame:
    """Document-aligned batches of each shard: (shard, step, rank, inputs, targets, offsets, bigrams).

    ``tokens``: (shard, position, tokens), pieces of shards.  Tokens before a shard's first document are skipped.  A shard is
    one group; its size is the shard writer's parameter.  Tokens stay in Arrow's buffers: a task holds a shard's stream and its batches as plain numbers."""
    width = max_docs(per_rank)

    def lists(values: np.ndarray, n: int, size: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(values.reshape(-1)))

    def run(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("position")
        stream = pieces.column("tokens").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        starts = np.flatnonzero(stream == start_id)
        bins = pack_documents(np.diff(np.append(starts, len(stream))), per_rank, longest, ranks)
        n = len(bins)
        inputs, targets = np.empty((n, per_rank), np.int32), np.empty((n, per_rank), np.int64)
        offsets = np.full((n, width), per_rank, np.int32)
        mixed = np.empty((n, per_rank), np.int64) if buckets is not None else None
        for k, docs in enumerate(bins):
            if len(docs) > width - 1:
                raise ValueError(f"{len(docs)} documents in a batch, room for {width - 1}")
            buffer = np.concatenate([stream[starts[d] : starts[d] + t] for d, t in docs])
            ends = np.cumsum([t for _, t in docs])
            ends[-1] -= 1
            inputs[k], targets[k] = buffer[:-1], buffer[1:]
            offsets[k, 0] = 0
            offsets[k, 1 : len(ends) + 1] = ends
            if mixed is not None:
                mixed[k] = hash_bigrams(buffer[:-1].astype(np.int64), buckets)
        number = np.arange(n, dtype=np.int32)
        shard = pieces.column("shard")[0].as_py() if pieces.num_rows else 0
        columns = {"shard": pa.array(np.full(n, shard, np.int64)), "step": pa.array(number // ranks), "rank": pa.array(number % ranks), "inputs": lists(inputs, n, per_rank), "targets": lists(targets, n, per_rank), "offsets": lists(offsets, n, width)}
        if mixed is not None:
            columns["bigrams"] = lists(mixed, n, per_rank)
        return pa.table(columns)

    schema = "shard bigint, step int, rank int, inputs array<int>, targets array<bigint>, offsets array<int>" + (", bigrams array<bigint>" if buckets is not None else "")
    return tokens.groupBy("shard").applyInArrow(run, schema)


def array_bigrams(tokens: Column, buckets: int) -> Column:
    """Bigram buckets along an array; documents' edges don't count, the batch's does."""
    return F.transform(tokens, lambda x, i: bigram_hash(x, F.get(tokens, i - 1), buckets))


def hash_bigrams(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bigram buckets along one run of 64-bit ids."""
    # The multipliers of the current and of the previous token.
    mixed = np.full(len(ids), buckets - 1, np.int64)
    mixed[1:] = ((36313 * ids[1:]) ^ (27191 * ids[:-1])) % (buckets - 1)
    return mixed


def with_bigrams(rows: DataFrame, buckets: int, tokens: str = "inputs", name: str = "bigrams") -> DataFrame:
    """Adds ``array_bigrams`` of an array column, hashed for ``AT_ONCE`` bytes of an Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, tokens)):
            lists = batch.column(tokens)
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64)
            at = at - at[0]
            mixed = hash_bigrams(ids, buckets)
            mixed[at[:-1][at[:-1] < at[1:]]] = buckets - 1
            made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(mixed), mask=lists.is_null() if lists.null_count else None)
            yield batch.append_column(name, made)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))]))


def document_offsets(lengths: Column) -> Column:
    """0 and the cumulative sums of an array of lengths."""
    zero = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(lengths, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("bigint"))))


# -- multiple-choice tasks ---------------------------------------------------------------------------


def choice_offsets(seq_len: int) -> int:
    """Entries of the offsets vector of a sequence of choices: room for documents of 70 tokens on average."""
    return (seq_len // 70 // 128 + 1) * 128


#: Tasks of a part whose places are found together.
CELL_TASKS = 1 << 16


def _openers(n: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums before each task (and of all), and for a task that opens a sequence the next one that does; ``len(n)`` if there is none."""
    total = np.concatenate([[0], np.cumsum(n)])
    return total, np.maximum(np.searchsorted(total, total[:-1] + seq_len + 1) - 1, np.arange(len(n)) + 1)


def _first_opener(total: np.ndarray, at: int, seq_len: int) -> int:
    """The first task that doesn't fit after ``at`` tokens of the sequence before."""
    return max(1, int(np.searchsorted(total, seq_len - at))) - 1


def _choice_places(sizes: DataFrame, seq_len: int, group: str) -> DataFrame:
    """(group, _i, sequence, begin) of tasks (group, _i, _n), numbered from 0 in each group: the place of each in its sequence.

    A cell of ``CELL_TASKS`` tasks is reduced to what it does to each sequence that may be open before it: only its first tasks, up to a sequence's length, can
    be the first that opens a new one.  These short tables are run through for each group, and then each cell knows where it begins."""
    kind = next(f.dataType.simpleString() for f in sizes.schema.fields if f.name == group)
    cells = sizes.withColumn("_cell", F.floor(F.col("_i") / CELL_TASKS))
    head = f"`{group}` {kind}, _cell bigint"

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        total, after = _openers(pdf.sort_values("_i")["_n"].to_numpy(), seq_len)
        n = len(after)
        last, count = np.arange(n), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                last[i], count[i] = last[after[i]], count[after[i]] + 1
        first = min(n, _first_opener(total, 0, seq_len) + 1)
        return pd.DataFrame({group: pdf[group].iloc[:1], "_cell": pdf["_cell"].iloc[:1]}).assign(upto=[total[: first + 1]], left=[total[-1] - total[last[:first]] - 1], count=[count[:first]], all=int(total[-1]), n=n)

    def begun(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_cell")
        sequence, at, out = -1, seq_len, []
        for x in pdf.itertuples():
            out.append((sequence, at))
            i = _first_opener(np.asarray(x.upto), at, seq_len)
            sequence, at = (sequence + int(x.count[i]), int(x.left[i])) if i < x.n else (sequence, at + int(x.all))
        return pdf[[group, "_cell"]].assign(_sequence=[s for s, _ in out], _at=[a for _, a in out])

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        total, after = _openers(pdf["_n"].to_numpy(), seq_len)
        opens = np.zeros(len(after), bool)
        i = _first_opener(total, int(pdf["_at"].iloc[0]), seq_len)
        while i < len(after):
            opens[i] = True
            i = after[i]
        number = np.cumsum(opens)
        begin = np.where(number > 0, total[:-1] - total[np.append(0, np.flatnonzero(opens))][number] - 1, total[:-1] + pdf["_at"].iloc[0])
        return pdf[[group, "_i"]].assign(sequence=pdf["_sequence"] + number, begin=np.where(opens, 0, begin))

    tables = cells.groupBy(group, "_cell").applyInPandas(reduced, f"{head}, upto array<bigint>, left array<bigint>, count array<bigint>, all bigint, n bigint")
    starts = tables.groupBy(group).applyInPandas(begun, f"{head}, _sequence bigint, _at bigint")
    return cells.join(starts, [group, "_cell"]).groupBy(group, "_cell").applyInPandas(placed, f"`{group}` {kind}, _i bigint, sequence bigint, begin bigint")


def pack_choices(tasks: DataFrame, encode: Callable[[str], list[int]], seq_len: int, group: str = "part", end_id: int = START_ID) -> DataFrame:
    """Sequences of multiple-choice tasks: (part, sequence, tokens, targets, task_ids, spans, labels, offsets).

    ``tasks``: (part, task_id, ctx, endings, label); the tasks of a part are packed in order of their id.  Each of the four endings
    gives a piece: context and ending without their last token as inputs, without their first as targets, with an ``end_id`` in
    both before it unless it opens the sequence.  A span is where an ending's tokens are targets.  Offsets are 0 and the places
    after each end, filled up with the length.  A task whose texts don't fit beside the ones before opens a sequence; one that
    doesn't fit at all is an error.

    Tasks are numbered and measured first, and kept in a folder of ``scratch``; their places follow from lengths alone, in cells of a part, and then the texts of a sequence meet."""
    width = choice_offsets(seq_len)
    columns = [group, "task_id", "ctx", "endings", "label"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, "ctx")):
            sizes = []
            for key, c, four in zip(*(batch.column(x).to_pylist() for x in ("task_id", "ctx", "endings")), strict=True):
                if len(four) != 4:
                    raise ValueError("a task has four endings")
                sizes.append(4 * len(encode(c)) + sum(len(encode(" " + e)) for e in four))
                if sizes[-1] - 1 > seq_len:
                    raise ValueError(f"task {key} is longer than a sequence")
            yield batch.append_column("_n", pa.array(sizes, pa.int64()))

    def sequence_of(rows: list[dict]) -> pa.RecordBatch:
        inputs, targets, spans = np.zeros(seq_len, np.int32), np.zeros(seq_len, np.int32), []
        for row in rows:
            a, context = row["begin"], encode(row["ctx"])
            for e in row["endings"]:
                whole = [*context, *encode(" " + e)]
                if a:  # a piece's end mark stands before it; the first piece of a sequence has none
                    inputs[a] = targets[a] = end_id
                    a += 1
                inputs[a : a + len(whole) - 1], targets[a : a + len(whole) - 1] = whole[:-1], whole[1:]
                spans.append([a + len(context) - 1, a + len(whole) - 1])
                a += len(whole) - 1
        ends = np.flatnonzero(inputs == end_id) + 1
        if len(ends) >= width:
            raise ValueError(f"{len(ends)} documents in a sequence, room for {width - 1}")
        offsets = np.full(width, seq_len, np.int32)
        offsets[: len(ends) + 1] = [0, *ends]
        made = (int(rows[0][group]), rows[0]["sequence"], inputs, targets, [r["task_id"] for r in rows], spans, [r["label"] for r in rows], offsets)
        kinds = (pa.int32(), pa.int32(), *2 * [pa.list_(pa.int32())], pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), *2 * [pa.list_(pa.int32())])
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds, strict=True)], names=["part", "sequence", "tokens", "targets", "task_ids", "spans", "labels", "offsets"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in (x for whole in batches for x in pieces(whole, "ctx")):
            for row in batch.to_pylist():
                if held and (row[group], row["sequence"]) != (held[0][group], held[0]["sequence"]):
                    yield sequence_of(held)
                    held = []
                held.append(row)
        if held:
            yield sequence_of(held)

    last = F.coalesce(F.col("task_id").cast("bigint"), F.lit(1 << 62))  # tasks without an id
    rows = numbered(tasks.select(*columns, last.alias("_key")), "_key", "_i", group).select(*columns, "_i")
    path = new_folder(tasks.sparkSession, "choices")
    rows.mapInArrow(measured, T.StructType([*rows.schema.fields, T.StructField("_n", T.LongType())])).write.parquet(path)
    stored = tasks.sparkSession.read.parquet(path)
    places = _choice_places(stored.select(group, "_i", "_n"), seq_len, group)
    met = stored.drop("_n").join(places, [group, "_i"]).repartition(group, "sequence").sortWithinPartitions(group, "sequence", "_i")
    return met.mapInArrow(assembled, "part int, sequence int, tokens array<int>, targets array<int>, task_ids array<bigint>, spans array<array<int>>, labels array<int>, offsets array<int>")


# -- conversations ------------------------------------------------------------------------------------

# The chat form, and the ids of an image's place holder and of the marks of its begin, its end and the end of a row of patches.
USER_TURN, ANSWER_TURN = "\nUser: {}\nAssistant:", " {}"
PATCH_ID, LOW_ID, IMAGE_START_ID, IMAGE_END_ID, ROW_END_ID, LOW_START_ID = 50257, 50258, 50259, 50260, 50261, 50262
IMAGE_IDS = (PATCH_ID, LOW_ID, IMAGE_START_ID, IMAGE_END_ID, ROW_END_ID, LOW_START_ID)


def encode_turns(rows: DataFrame, encode: Callable[[list[str]], list[list[int]]], seq_len: int, end_id: int = START_ID) -> DataFrame:
    """(id, inputs, targets, weights) of flattened conversations (id, turns, message_weight, n_sub, and image_ids, if there are any).

    Turns alternate between user and assistant; an unpaired last turn is dropped.  Each answer ends with ``end_id``, and its tokens weigh
    message_weight / sqrt(their number) / sqrt(n_sub); all others weigh 0, and so do image ids as targets.  The sequence begins with the
    image ids, is cut to ``seq_len``, and is shifted by one."""
    images = F.coalesce(F.col("image_ids").cast("array<int>"), F.array().cast("array<int>")) if "image_ids" in rows.columns else F.array().cast("array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, "turns")):
            names = ("id", "turns", "message_weight", "n_sub", "image_ids")
            read = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            said = [(turns or [])[: len(turns or []) // 2 * 2] for _, turns, *_ in read]
            coded = iter(encode([(ANSWER_TURN if k % 2 else USER_TURN).format(t) for turns in said for k, t in enumerate(turns)]))
            out: tuple[list, ...] = ([], [], [], [])
            for (key, _, weight, n_sub, image), turns in zip(read, said, strict=True):
                ids, weights = list(image), [0.0] * len(image)
                for k in range(len(turns)):
                    own = next(coded)
                    if k % 2:
                        own = [*own, end_id]
                    ids += own
                    weights += [(weight or 0.0) / math.sqrt(len(own)) / math.sqrt(max(n_sub or 0, 1)) if k % 2 else 0.0] * len(own)
                ids, weights = ids[:seq_len], weights[:seq_len]
                weights = [0.0 if t in IMAGE_IDS else w for t, w in zip(ids, weights, strict=True)]
                for column, value in zip(out, (key, ids[:-1], ids[1:], weights[1:]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in out[1:3]), pa.array(out[3], pa.list_(pa.float64()))], names=["id", "inputs", "targets", "weights"])

    read = rows.select(F.col("id").cast("bigint").alias("id"), "turns", F.col("message_weight").cast("double").alias("message_weight"), F.col("n_sub").cast("int").alias("n_sub"), images.alias("image_ids"))
    return read.mapInArrow(run, "id bigint, inputs array<int>, targets array<int>, weights array<double>")


def collate(examples: DataFrame, multiple: int = 16, filler: int = START_ID) -> DataFrame:
    """One packed row for each batch: (batch, inputs, targets, weights, offsets), padded to a multiple with a document of filler (targets and
    weights 0).

    ``examples``: (batch, id, inputs, targets, weights); a batch is a few examples by definition."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "inputs", "targets", "weights")))
    rows = examples.groupBy("batch").agg(ordered.alias("x"))
    pad = F.pmod(-F.aggregate("x", F.lit(0), lambda a, x: a + F.size(x["inputs"])), F.lit(multiple))
    join = lambda c, fill, t: F.concat(F.flatten(F.transform("x", lambda x: x[c])), F.array_repeat(F.lit(fill).cast(t), pad.cast("int")))
    lengths = F.transform("x", lambda x: F.size(x["inputs"]))
    lengths = F.when(pad > 0, F.concat(lengths, F.array(pad.cast("int")))).otherwise(lengths)
    return rows.select("batch", join("inputs", filler, "int").alias("inputs"), join("targets", 0, "int").alias("targets"), join("weights", 0.0, "double").alias("weights"), document_offsets(lengths).alias("offsets"))


def prune_images(examples: DataFrame, patches_per_crop: int) -> DataFrame:
    """Examples (batch, id, inputs, crops, pooled) with the pooled rows of the place holders that are left in ``inputs`` (a prefix), the crops
    that these rows read, and patch numbers counted through the batch; -1 stays."""
    left = F.size(F.filter("inputs", lambda t: t == PATCH_ID))
    cut = left < F.size("pooled")
    kept = F.when(cut, F.slice("pooled", F.lit(1), left)).otherwise(F.col("pooled"))
    rows = examples.withColumns({"_cut": cut, "pooled": kept})
    read = F.coalesce(F.array_max(F.flatten("pooled")), F.lit(-1))
    rows = rows.withColumn("crops", F.when(F.col("_cut"), F.floor((F.greatest(read, F.lit(-1)) + patches_per_crop) / patches_per_crop)).otherwise(F.col("crops")).cast("int"))
    before = Window.partitionBy("batch").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_shift", F.coalesce(F.sum("crops").over(before), F.lit(0)) * patches_per_crop)
    moved = F.transform("pooled", lambda row: F.transform(row, lambda x: F.when(x >= 0, x + F.col("_shift")).otherwise(F.lit(-1).cast("bigint"))))
    return rows.withColumn("pooled", moved).drop("_cut", "_shift")


def collate_images(examples: DataFrame, patches_per_crop: int, multiple: int = 16, filler: int = START_ID) -> DataFrame:
    """``collate`` of examples with images (see ``prune_images``): also the crops of each example and all pooled rows, in order."""
    pruned = prune_images(examples, patches_per_crop)
    ordered = F.array_sort(F.collect_list(F.struct("id", "crops", "pooled")))
    seen = pruned.groupBy("batch").agg(ordered.alias("x")).select("batch", F.transform("x", lambda x: x["crops"]).alias("crops"), F.flatten(F.transform("x", lambda x: x["pooled"])).alias("pooled"))
    return collate(pruned, multiple, filler).join(seen, "batch")


def bigram_ids_touched(tokens: DataFrame, buckets: int) -> DataFrame:
    """Distinct (step, bucket) of the bigrams in each step's inputs."""
    return with_bigrams(tokens.select("step", "inputs"), buckets).select("step", F.explode(F.array_distinct("bigrams")).alias("bucket")).distinct()
