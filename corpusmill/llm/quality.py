"""Quality classifier: a byte-level convolutional network, in numpy.

A document's bytes are looked up in a learned embedding; learned filters slide over
overlapping chunks of ``WIDTH`` bytes, ``STRIDE`` apart, that cover the whole document; each
filter's largest response over all chunks (a max pool), its mean response and the logarithm of the
number of chunks enter a small hidden layer and a logistic unit, which give the
probability of the better label.

It is trained on the driver from a bounded sample of the labelled rows: of each label the
``max_train`` / 2 whose ids have the smallest hash.  Training and scoring read every byte
of a document, with the same chunks and the same pooling.

Null and empty texts are scored as a document of padding bytes.  Repeated rows get the
same score each.  Without any labelled row, or with one label only, the score is the
label's share (0.5 without labels).  A very long text is scored whole, block by block.  Only ``doc_id`` and
``text`` are read, so other columns can have any name.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling, store, textops

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 4, 8, 32, 16
#: Documents in training, at most.
MAX_TRAIN = 3000
#: Chunks that are held as windows at a time.
BLOCK = 1 << 16
#: A document is good from this score on.
DECISION = 0.5
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.004, 1e-4


@dataclass
class Network:
    embedding: np.ndarray  # 257 x EMBED; the last row is padding
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    offset: np.ndarray
    inner: np.ndarray  # 2 * FILTERS + 1 x HIDDEN
    inner_offset: np.ndarray
    weight: np.ndarray  # HIDDEN
    bias: float
    constant: float | None = None  # the score when there is nothing to learn

    def pooled(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per text: each filter's largest and mean response over all chunks."""
        size = np.diff(at)
        chunks = np.maximum(1, -(-(size - (WIDTH - STRIDE)) // STRIDE))
        padded = (chunks - 1) * STRIDE + WIDTH
        begin = np.cumsum(padded) - padded
        codes = np.full(int(padded.sum()), 256, np.uint16)
        for i, (a, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
            codes[a : a + n] = raw[at[i] : at[i + 1]]
        ends = np.cumsum(chunks)
        best = np.full((len(size), FILTERS), 0, np.float32)
        total = np.zeros((len(size), FILTERS), np.float64)
        for a in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):  # besides 2 bytes a byte of text, memory is a block's
            number = np.arange(a, min(a + BLOCK, int(ends[-1])))
            own = np.searchsorted(ends, number, side="right")
            rows = begin[own] + (number - (ends - chunks)[own]) * STRIDE
            windows = self.embedding[codes[rows[:, None] + np.arange(WIDTH)]].reshape(len(rows), -1)
            out = np.maximum(windows @ self.filters + self.offset, 0)
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best[own[cuts]] = np.maximum(best[own[cuts]], np.maximum.reduceat(out, cuts))
            total[own[cuts]] += np.add.reduceat(out, cuts)
        return _features(best, total / chunks[:, None], chunks)

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        z = np.tanh(self.pooled(raw, at) @ self.inner + self.inner_offset) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _features(best: np.ndarray, mean: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    return np.concatenate([best, mean, 0.2 * np.log(chunks)[:, None]], axis=1).astype(np.float64)


def _codes(text: str | None) -> np.ndarray:
    """A text's bytes, padded to whole chunks."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(raw) - (WIDTH - STRIDE)) // STRIDE))
    padded = np.full((n - 1) * STRIDE + WIDTH, 256, np.uint16)
    padded[: len(raw)] = raw
    return padded


def _blocks(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chunks, their documents' numbers) of all chunks of some documents, ``BLOCK`` at most at a time."""
    held, owner, room = [], [], BLOCK
    for i, doc in enumerate(docs):
        chunks = np.lib.stride_tricks.sliding_window_view(doc, WIDTH)[::STRIDE]
        while len(chunks):
            held.append(chunks[:room])
            owner.append(np.full(len(held[-1]), i))
            chunks, room = chunks[len(held[-1]) :], room - len(held[-1])
            if not room:
                yield np.concatenate(held), np.concatenate(owner)
                held, owner, room = [], [], BLOCK
    if held:
        yield np.concatenate(held), np.concatenate(owner)


def train(texts: list[str | None], labels: list[int], seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    net = Network(rng.normal(0, 0.3, (257, EMBED)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, (2 * FILTERS + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        net.constant = share
        return net
    net.bias = float(np.log(share / (1 - share)))
    docs = [_codes(x) for x in texts]
    names = ("embedding", "filters", "offset", "inner", "inner_offset", "weight")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    bias_first = bias_second = 0.0
    step = 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            step += 1
            own_docs = [docs[i] for i in some]
            size = np.array([(len(x) - WIDTH) // STRIDE + 1 for x in own_docs])
            best, total, ties = np.zeros((len(some), FILTERS), np.float32), np.zeros((len(some), FILTERS)), np.zeros((len(some), FILTERS))
            for x, own in _blocks(own_docs):
                out = np.maximum(net.embedding[x].reshape(len(x), -1) @ net.filters + net.offset, 0)
                cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                most = np.maximum.reduceat(out, cuts)
                equal = np.add.reduceat((out == most[np.cumsum(np.append(False, own[1:] != own[:-1]))]).astype(np.float64), cuts)
                d = own[cuts]
                ties[d] = np.where(most > best[d], equal, ties[d] + np.where(most == best[d], equal, 0))
                best[d] = np.maximum(best[d], most)
                total[d] += np.add.reduceat(out, cuts)
            mean = total / size[:, None]
            features = _features(best, mean, size)
            hidden = np.tanh(features @ net.inner + net.inner_offset)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.weight + net.bias, -40, 40)))
            d = (p - y[some]) / len(some)
            d_hidden = d[:, None] * net.weight * (1 - hidden * hidden)
            grad = {"weight": hidden.T @ d + DECAY * net.weight, "inner": features.T @ d_hidden + DECAY * net.inner, "inner_offset": d_hidden.sum(0)}
            d_features = d_hidden @ net.inner.T
            d_mean = (d_features[:, FILTERS : 2 * FILTERS] / size[:, None]).astype(np.float32)
            d_best = (d_features[:, :FILTERS] / np.maximum(1, ties)).astype(np.float32)
            grad |= {"filters": DECAY * net.filters, "offset": np.zeros_like(net.offset), "embedding": np.zeros_like(net.embedding)}
            for x, own in _blocks(own_docs):
                windows = net.embedding[x].reshape(len(x), -1)
                out = np.maximum(windows @ net.filters + net.offset, 0)
                d_out = (d_mean[own] + np.where(out == best[own], d_best[own], 0)) * (out > 0)
                grad["filters"] += windows.T @ d_out
                grad["offset"] += d_out.sum(0)
                back = (d_out @ net.filters.T).reshape(-1, EMBED)
                codes = x.reshape(-1)
                grad["embedding"] += np.stack([np.bincount(codes, back[:, k], 257) for k in range(EMBED)], axis=1).astype(np.float32)
            for n in names:
                g = grad[n]
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                change = RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - change).astype(getattr(net, n).dtype))
            g = float(d.sum())
            bias_first, bias_second = 0.9 * bias_first + 0.1 * g, 0.99 * bias_second + 0.01 * g * g
            net.bias -= RATE * (bias_first / (1 - 0.9**step)) / (np.sqrt(bias_second / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Network:
    """Train from a sample of the documents that ``labels`` (doc_id and 0/1 label) names: ``max_train`` at most, half of
    them of each label; the bias is then set for the labels' shares in all rows."""
    rows = labels.select("doc_id", F.least(F.greatest(F.col(label).cast("int"), F.lit(0)), F.lit(1)).alias("y"))
    sample = sampling.texts_of_labels(docs, rows, "y", max_train // 2)
    net = train([r.text for r in sample], [r.label for r in sample])
    total, taken = {r.label: r.n_rows for r in sample}, Counter(r.label for r in sample)
    if net.constant is None:
        net.bias += float(np.log(total[1] / total[0]) - np.log(taken[1] / taken[0]))
    del sample
    store.trim()  # training takes a few hundred megabytes on the driver
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size, some 30 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                p = shared.value.score(*textops.text_buffers(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, net: Network, threshold: float = DECISION) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                p = shared.value.score(*textops.text_buffers(piece.column("text")))
                yield piece.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
