"""Removal of repeated word runs, found by fixed-block anchors.

Rule: a window is ``window`` consecutive words of one document.  Each word covered by
a window whose word sequence also starts in a document with a smaller ``doc_id`` goes;
windows are judged on the input.

1. Anchors.  Every document is cut into non-overlapping blocks of ``block`` words, the
   index; every rolling run of ``block`` words probes it.  With 2 * block - 1 <= window,
   each window holds a whole block of any other document that has the same window.
   Probes travel as packed arrays (32 bits of hash, a position, one bit that says
   "this is an index block"); the part they are dealt by adds bits.  A probe whose hash
   is an index block's and occurs in another document, too, is a hit.  Many texts are
   probed together; what their own blocks settle is not sent, but for two probes that tell the others.
2. Extension.  Hits are gathered for each document.  The windows around them are dealt
   by a 96-bit hash of all their words, and each part finds the windows' smallest
   document.  A window that a smaller document among those hashed together has, too, is
   settled there.  Runs of such windows are the maximal repeats.  A false hit of the first step dies here.
3. Removal.  The repeats' spans meet the texts.

Nothing pairs the members of a group of copies, and nothing is capped.  What is dealt for a word sequence that
many documents hold is one or two entries for each ``CHUNK`` of words, not one for each place where it stands.

Null texts and texts of fewer words than a window lose nothing.  A null ``doc_id`` counts
as larger than all others but 2**63 - 1, which it equals.  Rows that share a ``doc_id`` don't repeat each other; they are
told apart by text.  A very long text is hashed by itself.  Only ``doc_id`` and ``text`` are read, so other columns
can have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textops

WINDOW = 13
NO_ID = 2**63 - 1
#: Windows packed at a time.
CHUNK = 1 << 21
_PACKED = "part int, ids binary, hashes binary, counts binary, keys binary, places binary"
_SENT = _PACKED + ", settled boolean"
_FOUND = "doc_id bigint, text_hash bigint, places binary"


def _pack(hashes: np.ndarray, low: np.ndarray, owner: np.ndarray, place: np.ndarray, ids: np.ndarray, text_hashes: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part: its documents, how many entries each has, and the entries."""
    part = (hashes % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.int64)
    order = np.argsort(part, kind="stable")
    part, low, owner, place = part[order], low[order], owner[order], place[order].astype(np.uint32)
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    columns: tuple[list, ...] = ([], [], [], [], [], [])
    for a, b in zip(cuts, np.append(cuts[1:], len(part))[: len(cuts)], strict=True):
        heads = np.flatnonzero(np.append(True, owner[a + 1 : b] != owner[a : b - 1]))
        docs = owner[a:b][heads]
        gaps = np.diff(place[a:b], prepend=np.uint32(0))
        gaps[heads] = place[a:b][heads]
        row = (int(part[a]), textops.planes(ids[docs]), textops.planes(text_hashes[docs]), textops.planes(np.diff(np.append(heads, b - a)).astype(np.uint32)), textops.planes(low[a:b]), textops.planes(gaps))
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=[x.split()[0] for x in _PACKED.split(", ")])


def _unpack(table: pa.Table, key_type: np.dtype) -> tuple[np.ndarray, ...]:
    """ids and text hashes of the documents; for each entry its document, place and key."""
    ids, hashes, owner, place, keys, base = [], [], [], [], [], 0
    for row in zip(*(table.column(x).to_pylist() for x in ("ids", "hashes", "counts", "keys", "places")), strict=True):
        ids.append(textops.from_planes(row[0], np.int64))
        hashes.append(textops.from_planes(row[1], np.int64))
        counts = textops.from_planes(row[2], np.uint32).astype(np.int64)
        owner.append(np.repeat(np.arange(base, base + len(counts)), counts))
        base += len(counts)
        gaps = textops.from_planes(row[4], np.uint32).astype(np.int64)
        total, heads = np.cumsum(gaps), np.cumsum(counts) - counts
        place.append(total - np.repeat(total[heads] - gaps[heads], counts))
        keys.append(np.frombuffer(np.ascontiguousarray(np.frombuffer(row[3], np.uint8).reshape(key_type.itemsize, -1).T).tobytes(), key_type))
    return tuple(np.concatenate(x) for x in (ids, hashes, owner, place, keys))


def _found(ids: np.ndarray, hashes: np.ndarray, owner: np.ndarray, place: np.ndarray, hit: np.ndarray, parts: int) -> pa.RecordBatch:
    """What has been found, packed for the parts that the documents are dealt to."""
    owner, place = owner[hit], place[hit]
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    to = textops.mix(ids.view(np.uint64) ^ textops.mix(hashes.view(np.uint64)))
    return _pack(to[owner], np.zeros(len(owner), np.uint8), owner, place, ids, hashes, parts)


def _gather(table: pa.Table) -> pa.Table:
    """One row for each document, from all parts that have found something in it."""
    ids, hashes, owner, place, _ = _unpack(table, np.dtype(np.uint8))
    pairs = np.stack([ids, hashes])
    distinct, number = np.unique(pairs, axis=1, return_inverse=True)
    owner = number.reshape(-1)[owner]
    order = np.lexsort((place, owner))
    counts = np.bincount(owner, minlength=distinct.shape[1])
    return pa.table({"doc_id": distinct[0], "text_hash": distinct[1], "places": textops.binaries(place[order].astype(np.uint32), counts)})


def _sort_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _heads(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys (96 bits) together, and where each begins."""
    order, _ = _sort_groups(np.ascontiguousarray(keys["a"]))
    a, b = keys["a"][order], keys["b"][order]
    if len(a) > 1 and ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # 64 bits don't tell some apart
        order = order[np.lexsort((b, a))]
        a, b = keys["a"][order], keys["b"][order]
    return order, np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))


def settle_anchors(hashes: np.ndarray, keys: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the probes that are hits by the index blocks among them, and of those to send.

    Of a hash that is settled two documents' probes are sent, marked as blocks (in ``keys``)."""
    order, heads = _sort_groups(hashes)
    own = document[order]
    size = np.diff(np.append(heads, len(order)))
    least, most = np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)
    hit = np.logical_or.reduceat((keys & np.uint32(1)).astype(bool)[order], heads) & (least != most)
    settled = np.repeat(hit, size)
    told = np.zeros(len(order), bool)
    for end in (least, most):
        first = np.flatnonzero(settled & (own == np.repeat(end, size)))
        group = np.repeat(np.arange(len(heads)), size)[first]
        told[first[np.append(True, group[1:] != group[:-1])] if len(first) else first] = True
    keys[order[told]] |= np.uint32(1)
    found, sent = np.zeros(len(order), bool), np.zeros(len(order), bool)
    found[order], sent[order] = settled, ~settled | told
    return found, sent


def settle_windows(_: np.ndarray, keys: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the windows that a smaller document among them has, too, and of the others, which are sent."""
    order, heads = _heads(keys)
    own = document[order]
    found = np.zeros(len(order), bool)
    found[order] = own > np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(order))))
    return found, ~found


def _chunks(parts: int, entries, settle) -> Iterator[pa.RecordBatch]:
    """Packs what ``entries`` yields (hashes, keys, owner, place, ids, text hashes), many texts at a time: what is sent
    to the hashes' parts, and what ``settle`` has found, for the documents' parts."""
    held: list[tuple] = []
    docs = total = 0

    def packed() -> Iterator[pa.RecordBatch]:
        hashes, keys, owner, place, ids, text_hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        found, sent = settle(hashes, keys, ids[owner])
        for batch, settled in ((_pack(hashes[sent], keys[sent], owner[sent], place[sent], ids, text_hashes, parts), False), (_found(ids, text_hashes, owner, place, found, parts), True)):
            if batch.num_rows:
                yield batch.append_column("settled", pa.array(np.full(batch.num_rows, settled)))

    for hashes, keys, owner, place, ids, text_hashes in entries:
        if not len(hashes):
            continue
        held.append((hashes, keys, owner + docs, place, ids, text_hashes))
        docs, total = docs + len(ids), total + len(hashes)
        if total >= CHUNK:
            yield from packed()
            held, docs, total = [], 0, 0
    if held:
        yield from packed()


def _passing(judge):
    """Lets settled entries pass; they lie in their documents' part already."""

    def run(table: pa.Table) -> pa.Table:
        settled = table.column("settled")
        open_, done = table.filter(pc.invert(settled)).drop_columns("settled"), table.filter(settled).drop_columns("settled")
        return pa.concat_tables([done, pa.Table.from_batches([judge(open_)])]) if open_.num_rows else done

    return run


def find_anchors(docs: DataFrame, block: int, parts: int) -> DataFrame:
    """(doc_id, text_hash, places): starts of runs that hit another document's index block, or are one that is hit."""

    def entries(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for piece in textops.slices(batch):
                raw, at = textops.text_buffers(piece.column("text"))
                starts, ends, first = textops.find_words(raw, at)
                h = textops.rolling(textops.word_hashes(raw, starts, ends), block)
                owner = textops.owners(first)
                inside = np.flatnonzero(owner[: len(h)] == owner[len(starts) - len(h) :]) if len(h) else np.zeros(0, np.int64)
                place = inside - first[:-1][owner[inside]]
                h = h[inside]
                key = ((h >> np.uint64(33)) << np.uint64(1) | (place % block == 0)).astype(np.uint32)
                yield h, key, owner[inside], place, textops.longs(piece.column("doc_id"), NO_ID), textops.longs(piece.column("text_hash"), 0)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(parts, entries(batches), settle_anchors)

    def match(table: pa.Table) -> pa.RecordBatch:
        ids, hashes, owner, place, keys = _unpack(table, np.dtype(np.uint32))
        order, heads = _sort_groups(keys >> 1)
        indexed = np.logical_or.reduceat((keys & 1).astype(bool)[order], heads)
        document = ids[owner][order]
        hit = indexed & (np.minimum.reduceat(document, heads) != np.maximum.reduceat(document, heads))
        return _found(ids, hashes, owner, place, order[np.repeat(hit, np.diff(np.append(heads, len(order))))], parts)

    return docs.select("doc_id", "text", "text_hash").mapInArrow(probe, _SENT).groupBy("part").applyInArrow(_passing(match), _PACKED).groupBy("part").applyInArrow(_gather, _FOUND)


def find_repeats(docs: DataFrame, anchors: DataFrame, window: int, block: int, parts: int) -> DataFrame:
    """(doc_id, text_hash, places): starts of windows that a document with a smaller id has, too."""
    near = docs.select("doc_id", "text", "text_hash").join(anchors.withColumnRenamed("places", "anchors").hint("shuffle_hash"), ["doc_id", "text_hash"])

    def entries(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for piece in textops.slices(batch):
                raw, at = textops.text_buffers(piece.column("text"))
                starts, ends, first = textops.find_words(raw, at)
                h = textops.word_hashes(raw, starts, ends)
                marks = np.zeros(len(h) + 1, np.int64)
                for i, blob in enumerate(piece.column("anchors").to_pylist()):
                    marks[first[i] + np.frombuffer(blob, np.uint32) + 1] = 1
                marks = np.cumsum(marks)
                wide, other = textops.rolling(h, window), textops.rolling(h, window, 0xA24BAED4963EE407)
                owner = textops.owners(first)
                n = len(wide)
                reach = window - block + 1
                inside = np.flatnonzero((owner[:n] == owner[len(h) - n :]) & (marks[reach : reach + n] > marks[:n])) if n else np.zeros(0, np.int64)
                keys = np.empty(len(inside), np.dtype([("a", "<u8"), ("b", "<u4")]))
                keys["a"], keys["b"] = wide[inside], other[inside].astype(np.uint32)
                yield wide[inside], keys, owner[inside], inside - first[:-1][owner[inside]], textops.longs(piece.column("doc_id"), NO_ID), textops.longs(piece.column("text_hash"), 0)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(parts, entries(batches), settle_windows)

    def smallest(table: pa.Table) -> pa.RecordBatch:
        ids, hashes, owner, place, keys = _unpack(table, np.dtype([("a", "<u8"), ("b", "<u4")]))
        order, heads = _heads(keys)
        document = ids[owner][order]
        least = np.repeat(np.minimum.reduceat(document, heads), np.diff(np.append(heads, len(order))))
        return _found(ids, hashes, owner, place, order[document > least], parts)

    return near.mapInArrow(windows, _SENT).groupBy("part").applyInArrow(_passing(smallest), _PACKED).groupBy("part").applyInArrow(_gather, _FOUND)


def remove_repeats(docs: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text); spans: of words, from and to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for text, blob in zip(batch.column("text"), batch.column("repeats"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                gone: list[dict[str, int]] = []
                if (blob := blob.as_py()) is not None:
                    at = np.frombuffer(blob, np.uint32).astype(np.int64)
                    apart = np.flatnonzero(np.diff(at) > window)
                    begins, ends = at[np.append(0, apart + 1)], at[np.append(apart, len(at) - 1)] + window
                    gone = [{"begin": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    for span in reversed(gone):
                        del words[span["begin"] : span["end"]]
                n_removed.append(n_words[-1] - len(words))
                spans.append(gone)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("own_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    joined = docs.join(repeats.withColumnRenamed("places", "repeats").hint("shuffle_hash"), ["doc_id", "text_hash"], "left")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<begin: bigint, end: bigint>>, kept_text string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) for every row of ``docs``."""
    spark = docs.sparkSession
    block, parts = (window + 1) // 2, store.partitions(spark)
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").alias("own_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    anchors, anchors_path = store.materialise(find_anchors(docs, block, parts), "anchors")
    store.release(spark)
    repeats, _ = store.materialise(find_repeats(docs, anchors, window, block, parts), "repeats")
    del anchors
    store.release(spark, anchors_path)
    return remove_repeats(docs, repeats, window)
