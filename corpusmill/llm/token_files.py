"""Token files: Parquet lists of token ids that can be read selectively.

Layout of a token table (a folder of Parquet files in ascending ``doc_id`` order):

``doc_id``       delta-encoded; null ids come first
``part``         number of the range of documents that a file holds
``local_start``  ids before the document within its part; delta-encoded
``n_tokens``     ids of the document, the end id included
``ids``          the ids, dictionary-encoded (at 50,000 ids, two bytes each at most)

Version-2 data pages hold the delta encodings, row groups are small and every
page has an entry in the column and offset indexes, so a reader of some
documents' ids, or of the metadata alone, touches only those pages.

Empty or null texts hold only the end id.  A very long text is one row of the table, whole, and is encoded by itself.  Documents that share a ``doc_id`` stay
apart and follow one another by text.  An empty table gives an empty token table.
Other columns of the input are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store, textops, tokens

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 512

SCHEMA = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"


def writer_options(row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> dict[str, str]:
    return {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#local_start": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }


def tokenise(docs: DataFrame, path: str, kind: str, end_id: int | None) -> DataFrame:
    """(doc_id, part, local_start, n_tokens, ids), in the order of the rows given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = tokens.encoder(path, kind).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in textops.slices(batch, limit=tokens.ENCODE_BYTES):
                ids, size = encode([x or "" for x in piece.column("text").to_pylist()])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(size), end_id)
                    size = size + 1
                ends = np.cumsum(size)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(start + ends - size), pa.array(size), lists], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                start += int(ends[-1])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, out: str, tokenizer: str, kind: str = "byte", end_id: int | None = 0, **layout: int) -> None:
    """Encode whole texts and write them as a token table below ``out``."""
    ordered = docs.select("doc_id", "text").repartitionByRange(store.partitions(docs.sparkSession), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    tokenise(ordered, tokenizer, kind, end_id).write.options(**writer_options(**layout)).parquet(out)


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, part, local_start, n_tokens): the ids' pages are not touched."""
    return spark.read.schema(SCHEMA).parquet(out).select("doc_id", "part", "local_start", "n_tokens")


def part_offsets(spark: SparkSession, out: str) -> DataFrame:
    """(part, part_start): ids before each part; a row for each file, from metadata alone."""
    ends = read_metadata(spark, out).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read(spark: SparkSession, out: str, doc_ids: Iterable[int] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); ``doc_ids`` and ``between`` (both ends included)
    reach the files as predicates, so row groups and pages without them are skipped."""
    rows = spark.read.schema(SCHEMA).parquet(out)
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(list(doc_ids)))
    if between is not None:
        rows = rows.filter(F.col("doc_id").between(*between))
    return rows.join(F.broadcast(part_offsets(spark, out)), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def digests(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of ``read``; the checksum is over
    the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, raw = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
