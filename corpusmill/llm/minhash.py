"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation.

A document's set holds the distinct shingles of ``shingle`` words of its text, A-Z
lower-cased (of fewer words: the whole sequence as one shingle; without words: empty).  Documents are
linked when 100 * intersection >= 100 * threshold * union.

1. Each set gives ``BANDS`` * ``ROWS`` MinHash samples.  The samples are also folded into an odd
   sketch, a bitmap in which each (sample number, value) flips one bit.  Equal sets are one
   vertex from here on, named by 64 bits of their digest.
2. Vertices that share a band's samples are candidates.  Within such a bucket, pairs are judged by
   their sketches: from the population count of the XOR follows an estimate of the similarity,
   precise for high similarities.  A pair is plausible with an estimate >= threshold - ``MARGIN`` and
   sizes that allow the threshold.  The bucket gives a spanning forest of its plausible
   pairs, fewer edges than members; the components of all forests are the clusters.
3. Every link found by the bands lies inside one cluster.  A cluster's full sets of 64-bit shingle
   hashes meet in a task, which compares pairs of different components exactly and again gives a
   spanning forest only.  What is refuted is never written, so the output is linear.

Groups (buckets, clusters) above a limit are dealt to several tasks, in two rounds.  First each
part is judged by itself, together with a small sample of the group that all parts hold, so
that the parts' large components meet.  Then the members outside the group's
largest component (a few, usually) meet every part of it and each other, and nothing else
is compared twice.  While these members fit one part, a group of k members is dealt as k + o(k) rows.

At a similarity of 0.75, no common band has a probability of (1 - 0.75**4)**32 = 5.2e-6, and the margin
loses 2.0e-6 (exact distribution of the XOR's population count): the sketch loses less than the bands.

Null and empty texts have an empty set and are linked with nothing.  Rows with a null
``doc_id`` are linked with nothing; their component is null, and they stay.  Rows that share a ``doc_id``
but not a set are separate documents and each follow their own set; ``text_hash`` tells them apart.
Repeated rows get the same result each.  A very long text is one set like any other: groups are
dealt by the number of shingles.  Only ``doc_id`` and ``text`` are read, so other columns can have any
name.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, store, textops

SHINGLE, THRESHOLD = 5, 0.75
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
MARGIN = 0.23
#: Members of a bucket, and shingles of a cluster, that one task judges.
BLOCK, BLOCK_SHINGLES = 8192, 1 << 20
#: A group's sample that all its parts hold is about this share of a part.
PIVOTS = 16
#: Up to so many sets are compared one by one, more by an index of their shingles.
FEW = 8

_rng = np.random.default_rng(86028121)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text, as sorted 64-bit hashes."""
    raw = textops.LOWER[raw]
    starts, ends, first = textops.find_words(raw, at)
    h = textops.word_hashes(raw, starts, ends)
    wide = textops.rolling(h, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(wide[a : b - shingle + 1]))
        elif b > a:
            out.append(textops.rolling(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def samples(own: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    best = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(own), 4096):
        np.minimum(best, (own[a : a + 4096, None] * _A + _B).min(0), out=best)
    return best


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of each row of samples."""
    rows = found.reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        h = textops.mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return h


def odd_sketches(found: np.ndarray) -> np.ndarray:
    """Parity bitmaps (bytes) of rows of samples."""
    n, k = found.shape
    bit = (textops.mix(found + np.arange(k, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(SKETCH_BITS)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bit.astype(np.int64)).reshape(-1), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(bool).reshape(n, SKETCH_BITS), axis=1)


def most_flips(least: float) -> int:
    """The XOR's population count up to which the estimated similarity is at least ``least``."""
    k = BANDS * ROWS
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * k * (1 - least) / SKETCH_BITS)))


def _vertex(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands, sketch); an empty set has null node, bands and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                sets = shingle_sets(*textops.text_buffers(piece.column("text")), shingle)
                size = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(size)
                found = np.stack([samples(sets[i]) for i in full]) if len(full) else np.zeros((0, BANDS * ROWS), np.uint64)
                keys, sketches = bands(found), odd_sketches(found) if len(full) else np.zeros((0, SKETCH_BITS // 8), np.uint8)
                place = {int(i): n for n, i in enumerate(full)}
                node = [_vertex(sets[i]) if i in place else None for i in range(len(sets))]
                key_lists = [keys[place[i]].view(np.int64) if i in place else None for i in range(len(sets))]
                sketch = [sketches[place[i]].tobytes() if i in place else None for i in range(len(sets))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), piece.column("text_hash"), pa.array(size), pa.array(node, pa.int64()), pa.array(key_lists, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, bands array<bigint>, sketch binary")


def connect(labels: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join what ``near`` links and ``labels`` doesn't join yet: a spanning forest.

    ``near(x, others)`` gives a mask of the others that are linked with x.  Each pair that ends in different
    components has been asked for."""
    label = np.unique(labels, return_inverse=True)[1]
    done, edges, main = np.zeros(len(label), bool), [], -1

    def ask(x: int) -> np.ndarray:
        done[x] = True
        others = np.flatnonzero(label != label[x])
        found = others[near(x, others)] if len(others) else others
        if len(found):
            joined, first = np.unique(label[found], return_index=True)
            edges.extend((x, int(found[f])) for f in first)
            joined = np.append(joined, label[x])
            label[np.isin(label, joined)] = main if main in joined else label[x]
        return found

    count = np.bincount(label)
    seen = label == count.argmax() if count.max() > 1 else np.zeros(len(label), bool)
    for x in range(len(label)):  # stars; in a group of near copies the first one reaches nearly all
        if not seen[x]:
            seen[x] = True
            seen[ask(x)] = True
    main = int(np.bincount(label).argmax())
    for x in np.flatnonzero(label != main).tolist():
        if not done[x] and label[x] != main:
            ask(x)
    return edges


def by_sketch(values: np.ndarray, at: np.ndarray, size: np.ndarray, most: int, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Plausible pairs: by the sets' sizes, exactly, and by the XORs' population counts."""
    sketches = values.reshape(len(size), -1)

    def near(x: int, others: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(size[x], size[others]) >= percent * np.maximum(size[x], size[others])
        fits[fits] = np.bitwise_count(sketches[others[fits]] ^ sketches[x]).sum(1, dtype=np.int64) <= most
        return fits

    return near


def by_set(values: np.ndarray, at: np.ndarray, size: np.ndarray, _: int, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Links, from the full sets.

    A partner of x holds ``percent`` of x's shingles at least, so it holds one of any 100 - ``percent`` of them and one more.  If
    that many stand in x alone, nothing is linked with it."""
    least = size - -(-percent * size // 100) + 1  # so many shingles of a set hold one of each partner
    if len(size) > FEW:
        code, frequency = np.unique(values, return_inverse=True, return_counts=True)[1:]
        order = np.argsort(code, kind="stable")
        owner = np.repeat(np.arange(len(size)), size)[order]
        posting = np.cumsum(frequency) - frequency

    def near(x: int, others: np.ndarray) -> np.ndarray:
        linked = 100 * np.minimum(size[x], size[others]) >= percent * np.maximum(size[x], size[others])
        if not linked.any():
            return linked
        fit = others[linked]
        if len(size) > FEW:
            own = code[at[x] : at[x + 1]]
            if np.partition(frequency[own], least[x] - 1)[least[x] - 1] == 1:
                return np.zeros(len(others), bool)
            own = own[frequency[own] > 1]
            common = np.bincount(owner[textops.spread(posting[own], frequency[own])], minlength=len(size))[fit]
        else:
            common = np.array([len(np.intersect1d(values[at[x] : at[x + 1]], values[at[y] : at[y + 1]], assume_unique=True)) for y in fit.tolist()])
        linked[linked] = 100 * common >= percent * (size[x] + size[fit] - common)
        return linked

    return near


_DEALT = ("grp", "a", "b", "node", "label", "n", "held")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(node, label, size, values, at) of each group of two members or more, from sorted rows; one group is held at a time."""
    held: tuple[np.ndarray, ...] | None = None

    def cut(x: tuple[np.ndarray, ...], a: int, b: int) -> tuple[np.ndarray, ...]:
        keys, node, label, size, values, at = x
        return keys[a:b], node[a:b], label[a:b], size[a:b], values[at[a] : at[b]], at[a : b + 1] - at[a]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _DEALT[:3]], axis=1)
        own = (keys, *(batch.column(c).to_numpy() for c in _DEALT[3:6]), *textops.numbers(batch.column("held"), np.uint64))
        if held is not None:
            own = (*(np.concatenate(x) for x in zip(held[:5], own[:5], strict=True)), np.append(held[5], held[5][-1] + own[5][1:]))
        cuts = [0, *(np.flatnonzero((own[0][1:] != own[0][:-1]).any(1)) + 1).tolist(), len(own[0])]
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            if b - a > 1:
                yield cut(own, a, b)[1:]
        held = cut(own, *cuts[-2:])
    if held is not None and len(held[0]) > 1:
        yield held[1:]


def judge(dealt: DataFrame, by: Callable, most: int, percent: int) -> DataFrame:
    """(u, v), u > v: spanning forests of the groups in rows of ``_DEALT``, joining different labels; ``held`` is what ``by`` reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        for node, label, size, values, at in _groups(batches):
            near = by(values, at, size, most, percent)
            if len(node) == 2:
                edges = [(0, 1)] if label[0] != label[1] and near(0, np.array([1]))[0] else []
            else:
                edges = connect(label, near)
            for x, y in ((int(node[x]), int(node[y])) for x, y in edges):
                if x != y:
                    pairs.add((max(x, y), min(x, y)))
            if len(pairs) >= 1 << 16:
                yield _edges(pairs)
                pairs = set()
        if pairs:
            yield _edges(pairs)

    keys = ("grp", "a", "b")
    return dealt.select(*_DEALT).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u bigint, v bigint")


def _edges(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*sorted(pairs), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _part(parts: Column | str, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), parts if isinstance(parts, Column) else F.col(parts)).cast("int")


def first_round(rows: DataFrame) -> DataFrame:
    """Deals (grp, parts, node, n, held): each member to its part, the group's sample to all parts."""
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pivot = (F.col("parts") > 1) & (_part(F.col("parts") * PIVOTS, 4) == 0)
    return rows.withColumn("a", F.explode(F.when(pivot, every).otherwise(F.array(_part("parts", 3))))).withColumns({"b": F.lit(0), "label": F.col("node")})


def second_round(rows: DataFrame, linked: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Deals the groups that the first round judged in parts: members outside the largest component meet all
    parts of that component, and each other."""
    labels = linked.select(F.col("u").alias("node"), F.col("v").alias("to"))
    rows = rows.filter("parts > 1").join(labels, "node", "left").withColumn("label", F.coalesce("to", "node")).drop("to")
    sums = rows.groupBy("grp", "label").agg(F.sum(weight).alias("w"))
    sums = sums.groupBy("grp").agg(F.max(F.struct("w", "label")).alias("core"), F.sum("w").alias("all"))
    parts = lambda w: F.ceil(w / F.lit(limit)).cast("int")
    sums = sums.filter(F.col("all") > F.col("core.w")).select("grp", F.col("core.label").alias("core"), parts(F.col("core.w")).alias("cores"), parts(F.col("all") - F.col("core.w")).alias("rests"))
    rows = rows.join(sums, "grp")
    at = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    core, rest = _part("cores", 5), _part("rests", 6)
    to_rests = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: at(core, j))
    to_cores = F.transform(F.sequence(F.lit(0), F.col("cores") - 1), lambda i: at(i, rest))
    among = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: at(F.col("cores") + F.least(rest, j), F.greatest(rest, j)))
    places = F.when(F.col("label") == F.col("core"), to_rests).otherwise(F.when(F.col("rests") > 1, F.concat(to_cores, among)).otherwise(to_cores))
    return rows.withColumn("place", F.explode(places)).withColumns({"a": F.col("place.a"), "b": F.col("place.b")})


def joined(rows: DataFrame, weight: Column, limit: int, large: bool, by: Callable, most: int, percent: int) -> tuple[DataFrame, str]:
    """The components of all groups' spanning forests, as from ``graph.components``.

    ``rows``: (grp, total, node, n, held); ``total`` is the sum of the group's weights, and ``large`` tells
    whether any is above the limit."""
    spark = rows.sparkSession
    rows = rows.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(limit))).cast("int"))
    edges, edges_path = store.materialise(judge(first_round(rows), by, most, percent), "forest")
    linked, path = graph.components(edges)
    store.release(spark, edges_path)
    if not large:
        return linked, path
    more, more_path = store.materialise(judge(second_round(rows, linked, weight, limit), by, most, percent), "forest")
    if more.isEmpty():
        store.release(spark, more_path)
        return linked, path
    whole, whole_path = graph.components(linked.unionByName(more))
    store.release(spark, path, more_path)
    return whole, whole_path


def shingle_table(docs: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """(node, grp, total, n, held) of the documents in ``chosen`` (doc_id, text_hash, node, grp, total, n); ``held`` are the sets."""
    own = with_text_hash(docs).join(chosen.hint("shuffle_hash"), ["doc_id", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                sets = shingle_sets(*textops.text_buffers(piece.column("text")), shingle)
                size = np.array([len(x) for x in sets], np.int64)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("node", "grp", "total", "n")), textops.binaries(np.concatenate(sets) if sets else np.zeros(0, np.uint64), size)], names=["node", "grp", "total", "n", "held"])

    return own.select("node", "grp", "total", "n", "text").mapInArrow(run, "node bigint, grp bigint, total bigint, n bigint, held binary")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    most, percent = most_flips(threshold - MARGIN), round(100 * threshold)
    found, _ = store.materialise(signatures(with_text_hash(docs), shingle), "signatures")
    vertices = found.filter("doc_id is not null and node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    vertices, _ = store.materialise(vertices, "vertices")
    keys = vertices.select("node", F.explode("bands").alias("grp"))
    shared = keys.groupBy("grp").agg(F.count(F.lit(1)).alias("total")).filter("total > 1")
    buckets, buckets_path = store.materialise(keys.join(shared, "grp"), "buckets")
    store.release(spark)
    rows = buckets.join(vertices.select("node", "n", F.col("sketch").alias("held")), "node")
    large = not buckets.filter(F.col("total") > block).isEmpty()
    clusters, clusters_path = joined(rows, F.lit(1), block, large, by_sketch, most, percent)
    del rows, buckets
    store.release(spark, buckets_path)

    heads = clusters.select(F.col("v").alias("node"), F.col("v").alias("grp")).distinct()
    members = clusters.select(F.col("u").alias("node"), F.col("v").alias("grp")).unionByName(heads)
    members, members_path = store.materialise(members.join(vertices.select("node", "n", "row.doc_id", "row.text_hash"), "node"), "members")
    totals = members.groupBy("grp").agg(F.sum("n").alias("total"))
    large = not totals.filter(F.col("total") > block_shingles).isEmpty()
    sets, sets_path = store.materialise(shingle_table(docs, members.join(totals, "grp"), shingle), "shingle-sets")
    del members, totals
    store.release(spark, members_path, clusters_path)
    linked, _ = joined(sets, F.col("n"), block_shingles, large, by_set, most, percent)
    del sets
    store.release(spark, sets_path)

    to = linked.select(F.col("u").alias("node"), F.col("v").alias("to"))
    named = vertices.select("node", "row.doc_id").join(to, "node", "left").select("node", F.coalesce("to", "node").alias("to"), "doc_id")
    names = named.groupBy("to").agg(F.min("doc_id").alias("component"))
    out = found.select("doc_id", "text_hash", "n_shingles", "node").join(named.join(names, "to").select("node", "component"), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
