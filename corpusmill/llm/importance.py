"""Resampling of documents towards a target distribution, by hashed n-gram features.

A feature's bucket is the CRC-32 of its UTF-8 bytes modulo a number of buckets.  The CRC of each word is computed once.  A CRC is linear over GF(2),
so the CRC of two strings put together is the first one's, moved over the second one's length, plus the second one's; moving over 2^k
bytes is a 32 x 32 bit matrix, kept as four tables of 256, and any length is a product of those.  Longer n-grams are composed in
this way from their words' CRCs and lengths, and no n-gram's text is ever made.

Buckets are counted within each batch, then added by bucket: what moves is bounded by batches x buckets, and what reaches the driver by
``buckets`` (the gains, a number for each bucket).  Texts are read twice, once to count and once to score; only (doc_id, counts, score) is
sorted.  The draw is the best of a whole order that is made by range partitions (``operators.ranking``), so neither a
group nor the whole goes through one task.

Null and empty texts have no features and weight 0; documents with fewer than ``min_words`` words are returned but never drawn.  A null id counts as
an empty one in the hash and sorts before all others.  Repeated rows are rows of their own, with ranks next to each other.  Very long
texts are handled alone, whole.  Only ``doc_id`` and ``text`` are read, so other columns can have any name.  An empty target gives gains from
the documents' counts alone; without documents no rows come back.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import ranking

from . import store
from .textops import LOWER, find_words, owners, slices, text_buffers

#: Bytes \x00-\x2F, \x3A-\x60 and \x7B-\x7F separate words (A-Z are lower-cased before).
SEPARATES = np.zeros(256, dtype=bool)
SEPARATES[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_POLYNOMIAL = np.uint32(0xEDB88320)  # fixed value: CRC-32, bits reversed
_LONG_WORD = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (_POLYNOMIAL * (table & np.uint32(1)))
    return table


_BYTE = _byte_table()


def _as_tables(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 bit matrix, given by the images of the single bits, as one table for each byte of its argument."""
    tables = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        tables[bit // 8] ^= np.where(np.arange(256) >> (bit % 8) & 1, columns[bit], np.uint32(0)).astype(np.uint32)
    return tables


def _times(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = tables[0][values & np.uint32(255)]
    for byte in range(1, 4):
        out ^= tables[byte][(values >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def _shifts() -> list[np.ndarray]:
    """Matrices that move a CRC over 2^k zero bytes, k = 0 ... 39: each is the square of the one before."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns, out = _BYTE[bits & np.uint32(255)] ^ (bits >> np.uint32(8)), []
    for _ in range(40):
        out.append(_as_tables(columns))
        columns = _times(out[-1], columns)
    return out


_SHIFT = _shifts()


def moved(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved over ``lengths`` bytes."""
    out = crc.astype(np.uint32, copy=True)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero(lengths >> k & 1)
        out[some] = _times(_SHIFT[k], out[some])
    return out


def word_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges."""
    size = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    left, j = np.flatnonzero(size <= _LONG_WORD), 0
    left = left[size[left] > 0]
    while len(left):
        crc[left] = _BYTE[(crc[left] ^ raw[starts[left] + j]) & np.uint32(255)] ^ (crc[left] >> np.uint32(8))
        j += 1
        left = left[size[left] > j]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG_WORD):
        crc[i] = zlib.crc32(raw[starts[i] : ends[i]])
    return crc


def features(column: pa.Array, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all runs of ``shortest`` to ``longest`` words joined by a space, each one's text, and the texts' numbers of words."""
    raw, at = text_buffers(column)
    raw = LOWER[raw]
    starts, ends, first = find_words(raw, at, SEPARATES)
    own, size = owners(first), ends - starts
    words = word_crcs(raw, starts, ends)
    blank = np.full(len(words), zlib.crc32(b" "), np.uint32)
    joined = moved(blank, size) ^ words if longest > 1 else words  # of a space and the word
    crc, found, of = words, [], []
    for n in range(1, longest + 1):
        if n > 1:
            crc = moved(crc[: max(len(words) - n + 1, 0)], size[n - 1 :] + 1) ^ joined[n - 1 :]
        if n >= shortest:
            whole = own[: len(crc)] == own[n - 1 :]
            found.append(crc[whole])
            of.append(own[: len(crc)][whole])
    return np.concatenate(found), np.concatenate(of), np.diff(first)


def bucket_counts(texts: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(buckets, np.int64)
            for part in slices(batch):
                crc, _, _ = features(part.column("text"), shortest, longest)
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """For each bucket floor(1000 ln of the ratio of its smoothed shares in the target and in the documents)."""
    counts = []
    for rows in (docs, target):
        own = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(rows, shortest, longest, buckets).collect():  # a row for each bucket at most
            own[bucket] = n
        counts.append(own)
    have, want = counts
    all_have, all_want = float(have.sum() + buckets), float(want.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * all_have / ((s + 1) * all_want))) for s, t in zip(have.tolist(), want.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, shortest: int = 1, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains over a document's features."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                crc, of, words = features(part.column("text"), shortest, longest)
                weight = np.bincount(of, weights=gain[crc % np.uint32(buckets)].astype(np.float64), minlength=len(words)).astype(np.int64)  # sums stay below 2^53
                number = np.bincount(of, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words.astype(np.int64), number, weight))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def chance(key: Column, seed: int) -> Column:
    """The part of a score that comes from chance: Gumbel noise, in thousandths, from a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, min_words: int = 20, shortest: int = 1, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document.

    floor(``percent`` / 100) of the documents with at least ``min_words`` words are drawn without replacement, by the highest sums of weight
    and Gumbel noise, ties to the smaller id; ``rank`` is their place, null for the others."""
    if not 1 <= shortest <= longest or buckets < 1:
        raise ValueError("features have at least one word, and there is at least one bucket")
    weighed = weigh(docs, gains(docs, target, shortest, longest, buckets), shortest, longest)
    scored = weighed.withColumns({"score": F.col("weight") + chance(F.col("doc_id"), seed), "short": F.col("n_words") < min_words})
    scored, path = store.materialise(scored, "resampling-scores")  # no text: the ranges are found and dealt from this
    placed = ranking.ranks(scored, ["short", ("score", True), "doc_id"])
    store.release(docs.sparkSession, path)
    drawn = ~F.col("short") & (F.col("row_number") <= placed.filter("not short").count() * percent // 100)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("row_number")).alias("rank"))
