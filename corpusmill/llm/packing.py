"""Packing of documents into fixed windows with lexically related neighbours.

Documents are tokenised once and dealt to shards of about ``SHARD_TOKENS`` tokens by a lexical
signature (the smallest hash of their token pairs), so that similar texts meet.  A
signature with more tokens than a shard holds is cut by a second signature, and what has equal
signatures and still is more than two shards (copies, usually) by a hash of the document.  Each
shard has its own BM25 inverted index.  The first unused document seeds a window; the
index is asked with its strongest terms, and the unused neighbours, best first, fill the window.
A document that doesn't fit is cut at the window's end, and its rest seeds the next window.
So only a shard's last window is not full.

A seed is asked about its own shard only, with its ``QUERY_TERMS`` strongest terms, and takes ``ANSWER`` neighbours at a
time (it is asked again when they are used up); these parameters choose neighbours and never lose an id.

A document's ids are those of its whole text (null: empty), then ``end_id``; every id lies in
exactly one piece.  A very long text is cut like any other, into as many windows as it needs.  Rows that share a
``doc_id`` are separate documents; a null ``doc_id`` is kept.  An empty table gives no rows.  Only ``doc_id`` and
``text`` are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textops, tokens

WINDOW = 2048
SHARD_TOKENS = 1 << 20
BUCKET_BITS = 16
#: Terms of a seed that the index is asked for, and neighbours taken from an answer.
QUERY_TERMS, ANSWER = 24, 32
K1, B = 1.2, 0.75
#: Rows of the table of oversized shards up to which it is broadcast.
BROADCAST_ROWS = 100_000
#: Bits of a sequence's number within its part, and of a part's within its shard.
SEQUENCE_BITS, PIECE_BITS = 16, 22


def tokenise(docs: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """(doc_id, n, bucket, second, ids): ids as little-endian unsigned 32-bit numbers, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, kind).encode
        for batch in batches:
            for piece in textops.slices(batch, limit=tokens.ENCODE_BYTES):
                ids, size = encode([x or "" for x in piece.column("text").to_pylist()])
                ids = np.insert(ids, np.cumsum(size), end_id)
                size = size + 1
                heads = np.cumsum(size) - size
                pairs = ids.astype(np.uint64)
                pairs[:-1] = textops.mix(pairs[:-1] << np.uint64(32) | pairs[1:])
                pairs[heads[1:] - 1] = pairs[-1] = 2**64 - 1  # no pair, or one across two documents
                bucket = (textops.mix(np.minimum.reduceat(pairs, heads)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                # The second signature: the smallest of the hashes with their halves exchanged.
                other = np.minimum.reduceat(pairs << np.uint64(32) | pairs >> np.uint64(32), heads)
                second = (textops.mix(other) >> np.uint64(32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(bucket), pa.array(second), textops.binaries(ids.astype("<u4"), size)], names=["doc_id", "n", "bucket", "second", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, bucket int, second bigint, ids binary")


def shard_plan(table: DataFrame, shard_tokens: int) -> DataFrame:
    """(bucket, first, shards): at most 2**BUCKET_BITS rows, whatever the corpus' size."""
    first, held, rows = 0, 0, []
    for bucket, n in sorted((r.bucket, r.n) for r in table.groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        if held and held + n > shard_tokens:
            first, held = first + 1, 0
        shards = max(1, -(-n // shard_tokens))
        rows.append((bucket, first, shards))
        if shards > 1:
            first, held = first + shards, 0
        else:
            held += n
    return table.sparkSession.createDataFrame(rows, "bucket int, first bigint, shards bigint")


def deal(table: DataFrame, shard_tokens: int) -> DataFrame:
    """Adds (shard, part): of a shard above twice ``shard_tokens`` the documents are dealt to parts by their hash."""
    plan = F.broadcast(shard_plan(table, shard_tokens))  # 2**BUCKET_BITS rows at most
    placed = lambda t: t.join(plan, "bucket").withColumn("shard", F.col("first") + F.floor(F.col("second") * F.col("shards") / F.lit(1 << 32)))
    large = placed(table.select("bucket", "second", "n")).groupBy("shard").agg(F.sum("n").alias("w")).filter(F.col("w") > 2 * shard_tokens)
    large, _ = store.materialise(large.select("shard", F.ceil(F.col("w") / shard_tokens).alias("parts")), "packing-large")
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.col("parts"))).otherwise(0)
    return placed(table).join(large, "shard", "left").withColumn("part", part)


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        n = len(size)
        key, tf = np.unique(np.repeat(np.arange(n), size) << 32 | ids, return_counts=True)
        doc, term = key >> 32, key & 0xFFFFFFFF
        self.terms, term, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (size / size.mean())[doc]))).astype(np.float32)
        self.doc_at = np.searchsorted(doc, np.arange(n + 1))
        self.doc_terms, self.doc_weights, self.df = term.astype(np.int32), weight, df
        order = np.argsort(term, kind="stable")
        self.postings, self.weights = doc[order].astype(np.int32), weight[order]
        self.term_at = np.concatenate([[0], np.cumsum(df)])
        self.n = n

    def ask(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share terms with the seed, best first."""
        a, b = self.doc_at[seed], self.doc_at[seed + 1]
        terms, weights = self.doc_terms[a:b], self.doc_weights[a:b]
        shared = self.df[terms] > 1
        terms, weights = terms[shared], weights[shared]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-weights, QUERY_TERMS)[:QUERY_TERMS]]
        at = textops.spread(self.term_at[terms], self.df[terms])
        score = np.bincount(self.postings[at], self.weights[at], self.n)
        score[used] = 0
        best = np.argpartition(-score, min(ANSWER, self.n - 1))[:ANSWER] if self.n > ANSWER else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))]


def pack_shard(ids: np.ndarray, size: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    index, used, out = Index(ids, size), np.zeros(len(size), bool), []
    sequence = offset = unused = 0

    def put(doc: int, start: int) -> int:
        """Place a document's ids from ``start``; returns where it was cut, or 0."""
        nonlocal sequence, offset
        length = min(int(size[doc]) - start, window - offset)
        out.append((doc, start, length, sequence, offset))
        offset += length
        if offset == window:
            sequence, offset = sequence + 1, 0
        return start + length if start + length < size[doc] else 0

    cut = 0
    seed = None
    while True:
        if not cut:
            while unused < len(size) and used[unused]:
                unused += 1
            if unused == len(size):
                return out
            seed = unused
            used[seed] = True
        cut = put(seed, cut)
        while offset and not cut:
            answer = index.ask(seed, used)
            if not len(answer):
                break  # the next unused document goes on in this window
            for doc in answer.tolist():
                used[doc] = True
                cut = put(doc, 0)
                if cut:
                    seed = doc
                if cut or not offset:
                    break


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece; ids as
    little-endian unsigned 32-bit numbers."""
    table, _ = store.materialise(tokenise(docs, tokenizer, kind, end_id), "packing-tokens")

    def run(shard: pa.Table) -> pa.Table:
        tokens.drop_encoders()
        null = shard.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        doc_ids, size = textops.longs(shard.column("doc_id"), 0), shard.column("n").to_numpy()
        ids, at = textops.numbers(shard.column("ids").combine_chunks(), "<u4")
        order = np.lexsort((doc_ids, null))
        same = (doc_ids[order[1:]] == doc_ids[order[:-1]]) & (null[order[1:]] == null[order[:-1]])
        if same.any():  # rows that share an id: by their ids, so that a task that runs again does the same
            order = np.array(sorted(range(len(size)), key=lambda i: (null[i], doc_ids[i], ids[at[i] : at[i + 1]].tobytes())), np.int64)
        ids = ids[textops.spread(at[:-1][order], size[order])]
        doc_ids, null, size = doc_ids[order], null[order], size[order]
        doc, start, length, sequence, offset = np.array(pack_shard(ids, size, window), np.int64).T
        if sequence[-1] >> SEQUENCE_BITS:
            raise ValueError("a shard has too many sequences; use smaller shards")
        at = textops.spread((np.cumsum(size) - size)[doc] + start, length)
        names = pa.array(doc_ids[doc], mask=null[doc])
        number = (shard.column("shard")[0].as_py() << PIECE_BITS | shard.column("part")[0].as_py()) << SEQUENCE_BITS
        return pa.table([names, pa.array(start), pa.array(length), pa.array(size[doc]), pa.array(number + sequence), pa.array(offset), textops.binaries(ids[at], length)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    dealt = deal(table, shard_tokens).select("shard", "part", "doc_id", "n", "ids")
    return dealt.groupBy("shard", "part").applyInArrow(run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
