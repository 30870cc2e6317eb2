"""Language identification by character language models.

For each language an interpolated Kneser-Ney model of order ``ORDER`` over the characters of
words (lower-cased, with a mark before and after each word).  The highest order counts
occurrences, lower orders count distinct left contexts; the discounts are n1/(n1+2*n2)
of each order; the lowest order is mixed with a uniform distribution.  All n-grams of all
languages lie in one sorted array of 64-bit hashes per order, with a column for each
language: log probabilities for seen n-grams, and for contexts the weight that goes to the
shorter one.  A text's language is the one with the lowest cross-entropy a character.

A letter is what Unicode calls one (categories L*); signs such as \u00b2, \u00bd, \u2460 or \u2167 are not.
Training takes a bounded sample: of each language the ``max_train`` whole texts with the smallest hash.
Scoring reads whole texts; each distinct word of a batch is scored once.

Rejection is calibrated on texts of the sample that the model has not counted: ``rejected`` is
true where the cross-entropy is above what all but ``REJECT`` of those texts have.
The label is given all the same; it is ``und`` only for a text that is null or has no letter.

Repeated rows get the same result each.  With no language to learn from all is ``und``,
with score 0.  A very long text is scored like any other, all of it.  Only ``doc_id``, ``text`` and, in
training, ``lang`` are read, so other columns can have any name.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import sampling, textops

ORDER = 4
#: Texts of each language in training, at most.
MAX_TRAIN = 300
REJECT = 0.001
#: Letters that any model reserves room for (the uniform distribution's size).
ALPHABET = 256
SHARPNESS = 40.0
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _WORD.findall(text.lower())
    if text.isascii():
        return found
    return [x for w in found for x in ((w,) if w.isalpha() else ("".join(run) for letters, run in groupby(w, str.isalpha) if letters))]


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of the rows of an array of code points."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for k in range(codes.shape[1]):
        h = h * _MULTIPLY + codes[:, k].astype(np.uint64) + np.uint64(1)
    return textops.mix(h)


def _one(gram: tuple[int, ...]) -> int:
    return int(_hash(np.array([gram], np.int64).reshape(1, -1))[0])


@dataclass
class Models:
    languages: list[str]
    grams: list[np.ndarray]  # order 1..ORDER: sorted hashes of n-grams
    logs: list[np.ndarray]  # log2 probabilities, n-grams x languages; nan: not seen
    contexts: list[np.ndarray]  # order 1..ORDER: sorted hashes of contexts (n-1 characters)
    backs: list[np.ndarray]  # log2 of the weight of the shorter context; 0: context not seen
    limit: float = float("inf")  # cross-entropy above which a text is rejected

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        return at, (keys[at] == h) if len(keys) else np.zeros(len(h), bool)

    def word_bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word under each language, and characters (the end mark included)."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        row = size + ORDER - 1  # marks before; 0 is the mark
        codes = np.zeros(int(row.sum()), np.int64)
        begin = np.cumsum(row) - row
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        codes[textops.spread(begin + ORDER - 1, size - 1)] = letters
        at = textops.spread(begin + ORDER - 1, size)
        total = np.zeros((len(at), len(self.languages)))
        carried = np.zeros_like(total)
        open_ = np.ones_like(total, bool)
        for n in range(ORDER, 0, -1):
            window = codes[at[:, None] + np.arange(1 - n, 1)]
            i, seen = self._find(self.grams[n - 1], _hash(window))
            logs = np.where(seen[:, None], self.logs[n - 1][i] if len(self.grams[n - 1]) else np.nan, np.nan)
            hit = open_ & ~np.isnan(logs)
            total[hit] = (carried + logs)[hit]
            open_ &= ~hit
            if not open_.any():
                break
            j, known = self._find(self.contexts[n - 1], _hash(window[:, :-1]))
            if len(self.contexts[n - 1]):
                carried += np.where(known[:, None], self.backs[n - 1][j], 0)
        total[open_] = (carried + np.log2(1 / ALPHABET))[open_]
        heads = np.cumsum(size) - size
        return -np.add.reduceat(total, heads, axis=0) if len(words) else total, size

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text under each language, and whether it has letters."""
        own = [words_of(x or "") for x in texts]
        numbers: dict[str, int] = {}
        codes = np.fromiter((numbers.setdefault(w, len(numbers)) for x in own for w in x), np.int64)
        count = np.fromiter(map(len, own), np.int64, len(own))
        bits = np.zeros((len(texts), len(self.languages)))
        if not len(codes):
            return bits, count > 0
        by_word, size = self.word_bits(list(numbers))
        some = np.flatnonzero(count)
        heads = (np.cumsum(count) - count)[some]
        for k in range(len(self.languages)):
            bits[some, k] = np.add.reduceat(by_word[codes, k], heads)
        bits[some] /= np.add.reduceat(size[codes], heads)[:, None]
        return bits, count > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and whether the text fits no language."""
        bits, has = self.entropies(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = bits.argmin(1)
        least = bits.min(1)
        score = 1 / np.exp(-SHARPNESS * (bits - least[:, None])).sum(1)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
        return names, np.where(has, score, 0.0), ~has | (least > self.limit)


def _kneser_ney(words: Counter) -> tuple[list[dict], list[dict]]:
    """Probabilities of seen n-grams and weights of shorter contexts, for orders 1..ORDER."""
    counts: list[Counter] = [Counter() for _ in range(ORDER + 1)]
    for word, times in words.items():
        codes = (0,) * (ORDER - 1) + tuple(map(ord, word)) + (0,)
        for i in range(ORDER - 1, len(codes)):
            counts[ORDER][codes[i - ORDER + 1 : i + 1]] += times
    for n in range(ORDER - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    probs: list[dict] = [{} for _ in range(ORDER)]
    backs: list[dict] = [{} for _ in range(ORDER)]
    lower = lambda gram: 1 / ALPHABET
    for n in range(1, ORDER + 1):
        once, twice = (sum(1 for c in counts[n].values() if c == k) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = defaultdict(int), defaultdict(int)
        for gram, c in counts[n].items():
            total[gram[:-1]] += c
            kinds[gram[:-1]] += 1
        back = {context: discount * kinds[context] / t for context, t in total.items()}
        own = {gram: (c - discount) / total[gram[:-1]] + back[gram[:-1]] * lower(gram[1:]) for gram, c in counts[n].items()}
        probs[n - 1], backs[n - 1] = own, back
        lower = own.__getitem__  # a seen n-gram's shorter one is seen, too
    return probs, backs


def train(texts: dict[str, list[str]]) -> Models:
    languages = sorted(texts)
    fitted, checked = {}, {}
    for name in languages:
        kept = [x for i, x in enumerate(texts[name]) if i % 10 or len(texts[name]) < 10]
        checked[name] = [x for i, x in enumerate(texts[name]) if not i % 10]
        fitted[name] = _kneser_ney(Counter(w for x in kept for w in words_of(x)))
    models = Models(languages, [], [], [], [])
    for n in range(ORDER):
        for part, keys_to, values_to, missing in ((0, models.grams, models.logs, np.nan), (1, models.contexts, models.backs, 0.0)):
            every = sorted({g for name in languages for g in fitted[name][part][n]})
            width = n + 1 - part
            h = _hash(np.array(every, np.int64).reshape(len(every), width))
            table = np.full((len(every), len(languages)), missing)
            place = {g: i for i, g in enumerate(every)}
            for k, name in enumerate(languages):
                for gram, p in fitted[name][part][n].items():
                    table[place[gram], k] = np.log2(p)
            order = np.argsort(h)
            keys_to.append(h[order])
            values_to.append(table[order])
    fit = [b.min() for name in languages for b, ok in zip(*models.entropies(checked[name]), strict=True) if ok]
    if fit:
        models.limit = float(np.quantile(fit, 1 - REJECT)) * 1.05
    return models


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Models:
    """Train from ``labelled`` (text and non-null lang)."""
    texts: dict[str, list[str]] = defaultdict(list)
    for r in sampling.labelled_texts(labelled, "lang", max_train):
        texts[r.label].append(r.text)
    return train(dict(texts))


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # its size is bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                names, score, rejected = shared.value.predict(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
