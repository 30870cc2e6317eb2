"""Line deduplication that returns keep bitmaps instead of text.

A line's key is the line without \\x20 and \\x09-\\x0D at both ends, A-Z lower-cased.
A key of at least ``min_chars`` code points found in at least ``min_docs`` documents
loses its lines in every document but the one with the largest ``doc_id`` that holds it.

Keys become 128-bit hashes, one row for each key and document.  These rows are
range-partitioned by (hash, document), so that a key with any share of the rows
is dealt over many tasks, and sorted within, the largest document first.  Each part
is streamed once: of a key, the first document's rows stay, the others go once
there are enough documents.  Only a part's first and last key can go on in another
part; their rows are marked, and settled by counts for these keys, of which there
are two a part at most.

Null texts and empty texts are one empty line.  Rows with a null ``doc_id`` are
passed through whole and count for nobody.  Rows that share a ``doc_id`` are one
document for the rule, and each keeps its own bitmap (told apart by text).
A very long text is read whole, by a task that holds it and a row for each of its lines' keys; a very long line is one hash.
Other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

MIN_CHARS, MIN_DOCS = 20, 3
_STRIP = " \t\n\x0b\x0c\r"
_UPPER = re.compile("[A-Z]+")
_LINES = "doc_id bigint, text_hash bigint, h1 bigint, h2 bigint, positions binary"


def key_of(line: str) -> str:
    line = line.strip(_STRIP)
    return line.lower() if line.isascii() else _UPPER.sub(lambda m: m[0].lower(), line)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each key and document: hashes and the positions of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text")
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text_hash, text in zip(ids, hashes, texts, strict=True):
                found: dict[bytes, list[int]] = {}
                for n, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars and len(key := key_of(line)) >= min_chars:
                        found.setdefault(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")), []).append(n)
                for h, at in found.items():
                    for column, value in zip(out, (i, text_hash, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), np.array(at, "<u4").tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], names=["doc_id", "text_hash", "h1", "h2", "positions"])

    return docs.filter("doc_id is not null").mapInArrow(run, _LINES)


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A range partition is bounded whatever the keys are, so it is held as a whole.
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        part = pa.Table.from_batches(rows)
        a, b, d = (part.column(x).to_numpy() for x in ("h1", "h2", "doc_id"))
        new_key = np.ones(len(a), bool)
        new_key[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= d[1:] != d[:-1]
        heads, group = np.flatnonzero(new_key), np.cumsum(new_key) - 1
        docs = np.add.reduceat(new_doc.astype(np.int64), heads)
        pending = (group == 0) | (group == len(heads) - 1)
        goes = (docs[group] >= min_docs) & (d != d[heads][group])
        part = part.append_column("pending", pa.array(pending)).filter(pa.array(goes | pending))
        yield from part.to_batches()

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, positions) of the lines that go, a row for each key and document.

    ``docs`` has doc_id, text and text_hash."""
    spark = docs.sparkSession
    keys, keys_path = store.materialise(line_keys(docs, min_chars), "line-keys")
    order = ("h1", "h2", F.desc("doc_id"))
    ordered = keys.repartitionByRange(store.partitions(spark), *order).sortWithinPartitions(*order)
    marked, _ = store.materialise(ordered.mapInArrow(_stream(min_docs), _LINES + ", pending boolean"), "line-drops")
    del keys, ordered
    store.release(spark, keys_path)
    pending = marked.filter("pending")
    counts = pending.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("stays")).filter(F.col("n_docs") >= min_docs)
    columns = ("doc_id", "text_hash", "positions")
    settled = pending.join(F.broadcast(counts), ["h1", "h2"]).filter("doc_id <> stays").select(*columns)  # two keys a part at most
    return marked.filter("not pending").select(*columns).unionByName(settled)


def pack_bitmap(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bitmap(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, bitmap) for every document that loses lines: the compressed bits of
    the lines up to the last that goes, 1 for a line that stays.  Documents without a row
    keep all lines."""
    drops = dropped_lines(with_text_hash(docs), min_chars, min_docs).groupBy("doc_id", "text_hash").agg(F.collect_set("positions").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blobs in batch.column("positions").to_pylist():
                at = np.frombuffer(b"".join(blobs), "<u4")
                keep = np.ones(int(at.max()) + 1, bool)
                keep[at] = False
                out.append(pack_bitmap(keep) + len(keep).to_bytes(4, "little"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(out, pa.binary())], names=["doc_id", "text_hash", "bitmap"])

    return drops.mapInArrow(run, "doc_id bigint, text_hash bigint, bitmap binary")


def with_text_hash(docs: DataFrame) -> DataFrame:
    """Only the columns needed, with a hash that tells rows of one doc_id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row of ``docs``; with ``carry``, also
    the text as it was and the columns named."""
    extra = ("text", *carry) if carry is not None else ()
    joined = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), *(carry or ())).join(bitmaps.hint("shuffle_hash"), ["doc_id", "text_hash"], "left").drop("text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, bits in zip(batch.column("text"), batch.column("bitmap"), strict=True):
                lines = (text := text.as_py() or "").split("\n")
                n_lines.append(len(lines))
                if (bits := bits.as_py()) is None:
                    n_dropped.append(0)
                    kept.append(text)
                    continue
                keep = unpack_bitmap(bits[:-4], int.from_bytes(bits[-4:], "little"))
                stay = [x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :]
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            columns = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()), *(batch.column(c) for c in extra)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_text", *extra])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return joined.mapInArrow(run, ", ".join(["doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string", *(f"`{c}` {types[c]}" for c in extra)]))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row of ``docs``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
