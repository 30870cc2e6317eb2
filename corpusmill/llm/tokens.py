"""Token ids of many texts by a public tokenizer of the ``tokenizers`` library.

The two vocabularies used here split a text into pretokens by a fixed pattern
and encode each pretoken by itself.  A worker therefore asks the library only
for pretokens that it hasn't met, and keeps their ids in a bounded cache.

Pretokens are found and looked up for a megabyte of text at a time, in numpy, without a Python object
for each: a pretoken's name is a 128-bit hash of its characters, in an open hash table.
A text with any character outside ``_KNOWN`` is encoded by the library as a whole,
because there the library's Unicode tables decide how the text is split.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from . import store

#: Pretokens kept by a worker (about 60 bytes each); beyond it the half that was used least goes.
CACHE_ENTRIES = 500_000
#: Bytes of text encoded at a time: the arrays take some 40 times as much.
ENCODE_BYTES = 1 << 20

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Characters whose class is the same everywhere: letters, numbers, and others up to U+017F, and general punctuation.
_UNKNOWN = re.compile("[^\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\xa1-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
_SPACE_CLASS, _LETTER_CLASS, _NUMBER_CLASS, _OTHER_CLASS, _NONE = 0, 1, 2, 3, 255
_CLASS = np.full(1 << 16, _OTHER_CLASS, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE_CLASS
for _pattern, _class in ((_LETTER, _LETTER_CLASS), (_NUMBER, _NUMBER_CLASS)):
    _CLASS[[i for i in range(0x180) if re.match(f"[{_pattern}]", chr(i))]] = _class
_QUOTE, _BLANK = ord("'"), ord(" ")
#: What follows a quote in a pretoken of its own: one of these, or two.
_ONE, _TWO = np.array([ord(c) for c in "stmd"], np.uint16), [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
_A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers at[i], at[i]+1, ... (size[i] of them), one range after another."""
    shift = np.repeat(at - (np.cumsum(size, dtype=np.int64) - size), size)
    shift += np.arange(len(shift))
    return shift


def pretokens(chars: np.ndarray, at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pretokens of texts; ``at``: where each text begins, and the end.

    "word": contractions, runs of letters, single numbers, runs of others.  "byte": the same with runs of numbers, each with
    one blank before it, if there is one, and white space: a run but for its last character, if a text goes on."""
    n = len(chars)
    cls = _CLASS[chars]
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], after[:-1] = cls[:-1], cls[1:]
    heads = at[:-1][at[:-1] < at[1:]]
    before[heads] = _NONE
    after[np.append(heads[1:], n) - 1] = _NONE
    if kind == "word":
        start = (cls != _SPACE_CLASS) & ((cls != before) | (cls == _NUMBER_CLASS))
    else:
        blank = np.zeros(n, bool)
        blank[1:] = chars[:-1] == _BLANK
        blank[heads] = False
        space = cls == _SPACE_CLASS
        start = np.where(space, (before != _SPACE_CLASS) | ((after != _SPACE_CLASS) & (after != _NONE)), (cls != before) & ~blank)
    quotes = np.flatnonzero(start & (chars == _QUOTE))
    if len(quotes):
        last = at[np.searchsorted(at, quotes, side="right")]
        padded = np.append(chars, np.zeros(2, np.uint16))
        one, two = padded[quotes + 1], padded[quotes + 2]
        length = np.where((quotes + 1 < last) & np.isin(one, _ONE), 2, 0)
        for a, b in _TWO:
            length[(quotes + 2 < last) & (one == a) & (two == b)] = 3
        quotes, last, length = quotes[length > 0], last[length > 0], length[length > 0]
        start[quotes + 1] = False
        following = (quotes + length)[quotes + length < last]
        start[following[cls[following] == _LETTER_CLASS]] = True
    starts = np.flatnonzero(start)
    if kind != "word":
        return starts, np.append(starts[1:], n)
    ends = (cls != _SPACE_CLASS) & ((after == _SPACE_CLASS) | (after == _NONE))
    ends[:-1] |= start[1:] & (cls[:-1] != _SPACE_CLASS)
    return starts, np.flatnonzero(ends) + 1


def _names(chars: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of characters, four at a time."""
    words = np.lib.stride_tricks.sliding_window_view(np.append(chars, np.zeros(4, np.uint16)), 4)
    low, high = size.astype(np.uint64), size.astype(np.uint64)
    left = np.arange(len(starts))
    j = 0
    while len(left):
        own = size[left] - j
        word = np.ascontiguousarray(words[starts[left] + j]).view(np.uint64).reshape(-1)
        short = own < 4
        word[short] &= (np.uint64(1) << (np.uint64(16) * own[short].astype(np.uint64))) - np.uint64(1)
        x = (low[left] ^ word) * _A
        low[left] = x ^ (x >> np.uint64(29))
        y = (high[left] + word) * _B
        high[left] = y ^ (y >> np.uint64(32))
        j += 4
        left = left[own > 4]
    return low, high


class Encoder:
    """``kind`` "byte": byte_bpe_50k.json; "word": word_bpe_49k.json."""

    def __init__(self, path: str, kind: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # a special token's name in a text is ordinary text
        self.kind, self.limit = kind, cache_entries
        self._reset(np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def _reset(self, low: np.ndarray, high: np.ndarray, slots: int = 1 << 12) -> None:
        """An open hash table of at least twice as many slots as there are entries."""
        while slots < 2 * len(low):
            slots *= 2
        self.low, self.high, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.n = 0
        if not len(low):
            self.at, self.size, self.used, self.pool, self.filled = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32), 0
        self._insert(low, high)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((low ^ (high >> np.uint64(7))) * _B >> np.uint64(40)).astype(np.int64) & (len(self.entry) - 1)

    def _insert(self, low: np.ndarray, high: np.ndarray) -> None:
        """New, distinct names get the numbers from ``n`` on."""
        slot, left = self._slot(low, high), np.arange(len(low))
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.low[slot[placed]], self.high[slot[placed]], self.entry[slot[placed]] = low[placed], high[placed], self.n + placed
            done = np.zeros(len(low), bool)
            done[placed] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (len(self.entry) - 1)
        self.n += len(low)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of names, -1 where they aren't known."""
        slot = self._slot(low, high)
        found = self.entry[slot]
        left = np.flatnonzero((found >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.entry) - 1)
            entry = self.entry[slot]
            found[left] = entry
            other = (entry >= 0) & ((self.low[slot] != low[left]) | (self.high[slot] != high[left]))
            left, slot = left[other], slot[other]
        return found

    def _forget(self) -> None:
        """Keep the half that was used most, and let its counts fade."""
        half = self.limit // 2
        kept = np.sort(np.argpartition(-self.used[: self.n], half)[:half])
        slots = np.flatnonzero(self.entry >= 0)
        names = np.empty((2, self.n), np.uint64)
        names[:, self.entry[slots]] = self.low[slots], self.high[slots]
        size, used = self.size[kept], self.used[kept] // 2
        self.pool = self.pool[_ranges(self.at[kept], size)]
        self.at, self.size, self.used, self.filled = np.cumsum(size, dtype=np.int32) - size, size, used, len(self.pool)
        self._reset(*names[:, kept], slots=len(self.entry))

    def _learn(self, new: list[str], low: np.ndarray, high: np.ndarray) -> None:
        found = self.library.encode(new, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.uint32)
        size = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(new)) if len(ids) else np.zeros(len(new), np.int64)
        n, m = self.n, self.n + len(new)
        if m > len(self.at):
            self.at, self.size, self.used = (np.concatenate([x, np.zeros(max(m - n, len(x) // 2), np.int32)]) for x in (self.at, self.size, self.used))
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool) // 2), np.uint32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.size[n:m] = size
        self.at[n:m] = self.filled + np.cumsum(size) - size
        self.filled += len(ids)
        if 2 * m > len(self.entry):
            slots = np.flatnonzero(self.entry >= 0)
            names = np.empty((2, n), np.uint64)
            names[:, self.entry[slots]] = self.low[slots], self.high[slots]
            kept = self.at, self.size, self.used, self.pool, self.filled
            self._reset(np.append(names[0], low), np.append(names[1], high))
            self.at, self.size, self.used, self.pool, self.filled = kept
        else:
            self._insert(low, high)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each text."""
        if self.n > self.limit:
            self._forget()
        whole = [i for i, text in enumerate(texts) if _UNKNOWN.search(text)]
        odd = set(whole)
        own = [("" if i in odd else text.lower() if self.kind == "word" else text) for i, text in enumerate(texts)]
        chars = np.frombuffer("".join(own).encode("utf-16-le"), np.uint16)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))])
        starts, ends = pretokens(chars, at, self.kind) if len(chars) else (at[:0], at[:0])
        low, high = _names(chars, starts, ends - starts)
        codes = self._find(low, high)
        missing = np.flatnonzero(codes < 0)
        while len(missing):
            _, first = np.unique(low[missing], return_index=True)
            new = missing[np.sort(first)]
            self._learn([chars[a:b].tobytes().decode("utf-16-le") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], low[new], high[new])
            codes[missing] = self._find(low[missing], high[missing])
            missing = missing[codes[missing] < 0]  # names that differ in their second hash only
        count = np.bincount(codes, minlength=self.n)
        self.used[: self.n] = np.minimum(self.used[: self.n] + count, 1 << 30)
        size = self.size[codes]
        bound = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.searchsorted(starts, at)]
        lengths = np.diff(bound)
        ids = self.pool[_ranges(self.at[codes], size)]
        if whole:
            pieces = np.split(ids, bound[1:-1])
            for i, found in zip(whole, self.library.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
                pieces[i] = np.array(found.ids, dtype=np.uint32)
                lengths[i] = len(pieces[i])
            ids = np.concatenate(pieces)
        return ids, lengths


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder; it lives as long as the worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, kind)


def drop_encoders() -> None:
    """Give a worker's caches back to the system, for a stage that encodes nothing."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
    store.trim()


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
