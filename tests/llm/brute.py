"""The operators' contracts in plain Python."""

import hashlib
import re
import zlib

import numpy as np

UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return (text or "").encode("utf-8").split()


def substring(rows):
    """rows: (doc_id, text); one result for each row, in order."""
    least = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            least[k] = min(least.get(k, float("inf")), key(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if least[tuple(w[p : p + 13])] < key(i):
                gone[p : p + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def lines(rows):
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 20 and i is not None:
                docs.setdefault(line_key(line), set()).add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        stays = [x for x in every if i is None or len(line_key(x)) < 20 or len(docs[line_key(x)]) < 3 or max(docs[line_key(x)]) == i]
        out.append((i, len(every), len(every) - len(stays), "\n".join(stays)))
    return out


def shingles(text, n=5):
    w = [x.decode().translate(UPPER) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(rows):
    """Component of each row: the smallest doc_id of all sets reachable from its own."""
    name = {}
    for i, t in rows:
        own = shingles(t)
        if i is not None and own:
            name[own] = min(i, name.get(own, i))
    up = {x: x for x in name}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = list(name)
    for k, a in enumerate(sets):
        for b in sets[:k]:
            if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(a), find(b)
                if name[x] > name[y]:
                    x, y = y, x
                up[y] = x
    return [None if i is None else name[find(shingles(t))] if shingles(t) else i for i, t in rows]


def phrase_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = phrase_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = phrase_words(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                own = windows.get(tuple(w[p : p + n]))
                if own:
                    found |= own
                    hit[p : p + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def check_packing(pieces, rows, encode, window=2048):
    """Every id in exactly one piece, sequences gapless and within the window; returns the padding."""
    whole = {}
    for i, t in rows:
        ids = np.array([*encode(t or ""), 1], "<u4")
        whole.setdefault(i, []).append(ids)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(whole)
    for i, own in by_doc.items():
        if len(whole[i]) > 1:
            assert sum(p.length for p in own) == sum(map(len, whole[i]))
            continue
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(whole[i][0]))
            assert p.ids_crc32 == zlib.crc32(whole[i][0][at : at + p.length].tobytes())
            at += p.length
        assert at == len(whole[i][0])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_sequence) * window - sum(p.length for p in pieces)


def cross_entropy(texts, asked, order, alphabet):
    """Bits a character of ``asked`` under an interpolated Kneser-Ney model of ``texts``, by its recursive definition."""
    import math
    from collections import Counter

    mark = lambda w: "\0" * (order - 1) + w + "\0"
    words_in = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        for w in map(mark, words_in(t)):
            for i in range(order - 1, len(w)):
                counts[order][w[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = []
    for c in counts:
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        cut.append(once / (once + 2 * twice) if once and twice else 0.5)

    def p(gram):
        if not gram:
            return 1 / alphabet
        n, own = len(gram), counts[len(gram)]
        following = {g: v for g, v in own.items() if g[:-1] == gram[:-1]}
        if not following:
            return p(gram[1:])
        total = sum(following.values())
        return max(own[gram] - cut[n], 0) / total + cut[n] * len(following) / total * p(gram[1:])

    known, bits, size = {}, 0.0, 0
    for w in map(mark, words_in(asked)):
        for i in range(order - 1, len(w)):
            g = w[i - order + 1 : i + 1]
            if g not in known:
                known[g] = -math.log2(p(g))
            bits, size = bits + known[g], size + 1
    return bits / size


def network_score(net, text, width, stride):
    raw = list(text.encode())
    best, total, chunks, at = 0.0, 0.0, 0, 0
    while True:
        own = raw[at : at + width]
        own += [256] * (width - len(own))
        out = np.maximum(np.concatenate([net.embedding[x] for x in own]) @ net.filters + net.offset, 0)
        best, total, chunks, at = np.maximum(best, out), total + out, chunks + 1, at + stride
        if at + width - stride >= len(raw):
            break
    features = np.concatenate([best, total / chunks, [0.2 * np.log(chunks)]])
    z = np.tanh(features @ net.inner + net.inner_offset) @ net.weight + net.bias
    return 1 / (1 + np.exp(-z))


KEYS = "(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth|bearer|private[_-]?key)"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk-|sk_live_|AIza|eyJ|glpat-|npm_"
SHAPE = "[0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]"


def secret_candidates(text):
    """(position, piece, key, value) of every candidate of a text."""
    out, cut = [], re.split(r"[\x20\x09-\x0D]+", re.sub(r"^[\x20\x09-\x0D]+", "", text or ""))
    for p, whole in enumerate(cut):
        around = " ".join(cut[max(0, p - 2) : p]).lower()
        after_key = re.search(KEYS + r"\W*$", around, re.A) is not None
        if "-----BEGIN" in whole:
            title = " ".join(["-----BEGIN", *cut[p + 1 : p + 4]])
            if "PRIVATE KEY-----" in title:
                out.append((p, "-----BEGIN", "", title))
                continue
        elif not (len(whole) >= 10 and re.search(SHAPE + "|" + PREFIXES, whole) or re.search(KEYS + r"[\w.-]*[\"']?[=:]", whole, re.I | re.A) or len(whole) >= 6 and after_key):
            continue
        pieces = [x for x in re.split(r"[\"'`,;&?{}\[\]()<>|\\]+", whole) if x]
        for k, piece in enumerate(pieces):
            front = pieces[k - 1] if k else ""
            if re.fullmatch("[:=]+", front):
                front = (pieces[k - 2] if k > 1 else "") + front
            key = r"(?i)[\w.-]*(?:" + KEYS[1:-1] + r"|key)[\w.-]*[=:]+"
            own = re.match(key, piece, re.A)
            own = own[0] if own else ""
            before = re.fullmatch(key, front, re.A)
            value = re.sub(r"^[^0-9A-Za-z_/+-]+|[^0-9A-Za-z_/+=-]+$", "", piece[len(own) :])
            own = own or (before[0] if before else "")
            if len(value) >= 10 and (re.search(SHAPE, value) or re.match(PREFIXES, value)) or len(value) >= 6 and (own or after_key and k == 0):
                out.append((p, piece, own, value))
    return out


def secret_features(value, own, before2, before, piece):
    n = max(1, len(value))
    share = lambda pattern: len(re.findall(pattern, value)) / n
    runs = re.sub("[0-9]+", "\1", value)
    runs = re.sub("[a-z]+", "\3", re.sub("[A-Z]+", "\2", runs))
    is_key = lambda x: float(re.search(KEYS[:-1] + r"|key)\W*$", (x or "").lower(), re.A) is not None)
    return {
        "length": n, "transitions": (len(runs) - 1) / n, "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "other": share("[^0-9A-Za-z]"),
        "distinct": len(set(value)) / n, "hex": share("[0-9a-f]"), "vowels": share("(?i)[aeiou]"), "own_key": float(own != ""), "key_before": max(is_key(before), is_key(own)), "key_near": is_key(before2),
        "address": float(re.search(r"@|://|\.[a-z]{2,4}(/|$)", piece) is not None),
    }
