"""Conversation repair, nearest neighbours and importance resampling against brute force, on hard cases and on the small tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import conversation_repair, importance, neighbours, queries, topk  # noqa: F401

TABLES = "documents embeddings pages benchmark labels conversations".split()
BLANK = " \t\n\x0b\x0c\r"


def plain(frame):
    """Rows as sorted tuples of strings, columns by name."""
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple("null" if x is None else str(round(x, 6)) if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_importance_resampling"])
def test_queries_against_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert plain(got) == plain(want)


# -- conversations -------------------------------------------------------------------------------------


def cheapest(turns):
    """(cost, audit, lines) by search over all edits: nothing is known of gaps or states but the pattern itself."""
    seen, faults = set(), []
    for role, text in turns:
        core = text.strip(BLANK)
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, pattern, lines = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", pattern):
            return cost, audit, "\n".join(lines), faults
        tail = pattern[-1:] or "^"
        if (i, tail) in done:
            continue
        done.add((i, tail))
        legal = {"^": "su", "s": "u", "u": "a", "a": "u"}[tail]
        for name in ("user", "assistant"):
            if name[0] in legal:
                heapq.heappush(heap, (cost + 5, audit + "I", i, pattern + name[0], (*lines, f"{name}:")))
        if i == len(turns):
            continue
        role, text = turns[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, pattern, lines))
        if faults[i] in ("b", "d"):
            continue
        extra = 5 if faults[i] == "t" else 0
        if role[:1] and role[:1] in legal:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, pattern + role[0], (*lines, f"{role}:{text}")))
        for name in ("user", "assistant"):
            if name[0] in legal:
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, pattern + name[0], (*lines, f"{name}:{text}")))
    raise AssertionError


def repaired(rows):
    """What ``repair`` must return for (conv_id, turn, role, text)."""
    out, convs = [], {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        convs.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for conv, turns in convs.items():
        turns.sort()
        own = [t for known, t, *_ in turns if known]
        roles = [t[3] for t in turns]
        cost, audit, lines, faults = cheapest([t[3:] for t in turns])
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(own) - min(own) + 1 - len(set(own)) if own else 0
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


def hard_conversations():
    r = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "One. two", "é.", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "sys", "", None, "User"]
    rows = [(conv, r.choice([None, *range(6)]) if conv % 3 else i, r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"{conv} {i} {r.choice('.!? x')}") for conv in range(120) for i in range(r.randrange(1, 9))]
    rows += [(None, None, "user", "a."), (None, 3, None, None), (500, None, None, None), (501, 4, "user", "Hi."), (501, 4, "user", "Hi."), (502, 1, "system", "S."), (503, 9, "assistant", "A.")]
    return rows


TURNS = "conv_id bigint, turn bigint, role string, text string, chunk int, digest string, first string"


@pytest.fixture(scope="module")
def conversations(spark):
    rows = hard_conversations()
    return rows, spark.createDataFrame([(*x, 1, "d", "f") for x in rows], TURNS).repartition(5)


@pytest.mark.parametrize("sizes", [(4096, 4 << 20), (7, 4 << 20), (1, 1), (40, 2000)])
def test_repair_against_search(conversations, sizes):
    rows, turns = conversations
    got = sorted((tuple(x) for x in conversation_repair.repair(turns, *sizes).collect()), key=str)
    assert got == repaired(rows)


def test_repair_of_one_conversation_over_many_chunks(spark):
    r = random.Random(8)
    rows = [(1, i, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "cut", f"{i}.", f"{i}?", f"{i}"])) for i in range(600)] + [(2, 1, "user", "a.")]
    turns = spark.createDataFrame([(*x, 1, "d", "f") for x in rows], TURNS).repartition(3)
    got = sorted((tuple(x) for x in conversation_repair.repair(turns, 16).collect()), key=str)
    assert got == repaired(rows)
    lines = {}
    for x in sorted(conversation_repair.repaired_turns(turns, 16).collect(), key=lambda x: (x.chunk, x.piece, x.place)):
        lines.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in lines.items()} == {x[0]: x[-1] for x in got if "K" in x[7]}


def test_repair_of_nothing_and_lost_conversations(spark, tmp_path):
    none = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair(none).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "Hi.", 1, "", "")], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(x) for x in queries.op11_conversation_repair(spark, str(tmp_path)).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = {1: "", 2: text.replace(".", "").replace("!", "")}.get(kind, text)
        want[(c, t, "user" if kind == 4 else role, text)] += {0: 0, 3: 2}.get(kind, 1)
    got = Counter(tuple(x) for x in conversation_repair.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect())
    assert got == +want


# -- neighbours ----------------------------------------------------------------------------------------


def exact(rows, k):
    """Each query row's k nearest rows, by brute force, from (vec_id, vector)."""
    width = max(len(v) for _, v in rows)
    m = np.array([[*v, *[0.0] * (width - len(v))] for _, v in rows])
    ids, size = np.array([i for i, _ in rows]), np.sqrt((m * m).sum(axis=1))
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        c = (m[q] * m).sum(axis=1) / (size[q] * size)
        order = [j for j in np.lexsort((ids, -c)) if j != q][:k]
        out.append((int(ids[q]), [(int(ids[j]), float(c[j])) for j in order]))
    return out


def clustered(n, width, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, width))
    return [(i, (centres[i % 20] + 0.4 * r.normal(size=width)).astype(np.float32).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows", [clustered(4000, 16, 1), [(i, np.random.default_rng(i).normal(size=32).astype(np.float32).astype(float).tolist()) for i in range(3000)]], ids=["clustered", "random"])
def test_recall_and_scores(spark, rows):
    frame = spark.createDataFrame([(*x, "n", 3) for x in rows], "vec_id bigint, embedding array<float>, uid string, v int").repartition(4)
    got = {}
    for x in neighbours.nearest(frame, F.col("vec_id") % 50 == 0, 5, leaf_rows=64, part_bytes=8000, block_bytes=4000).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    vectors, hit, total = dict(rows), 0, 0
    for q, near in exact(rows, 5):
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and len({i for _, i, _ in found}) == 5 and q not in {i for _, i, _ in found}
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            a, b = np.array(vectors[q]), np.array(vectors[i])
            assert s == pytest.approx(float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())), abs=1e-12)
        hit += len({i for i, _ in near} & {i for _, i, _ in found})
        total += len(near)
    assert hit >= 0.9 * total


def test_neighbours_on_hard_rows(spark):
    """Copies that a third of the rows are, nulls, zeros, repeated ids, other lengths, huge and tiny numbers: few rows, so all are met."""
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [3.0, -1.0]), (100, [1e-160, 1e-160, 1e-160]), (7, [1e160, 0.0, 1e160]), (8, [2.0, 4.0]), *((20 + i, [1.0, 1.0]) for i in range(6)), (9, [0.0, 0.0, -1.0]), (9, [0.0, 0.0, -1.0])]
    bad = [(200, None), (250, []), (300, [0.0, 0.0]), (350, [nan, 1.0]), (400, [1.0, inf]), (450, [None, 1.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").repartition(3)
    got = [tuple(x) for x in neighbours.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect()]
    scaled = [(i, [x * 1e160 for x in v] if i == 100 else [x / 1e160 for x in v] if i == 7 else v) for i, v in good]
    want = [(q, r + 1, i, round(s, 9)) for q, near in exact(scaled, 5) for r, (i, s) in enumerate(near)]
    assert sorted((q, r, i, round(s, 9)) for q, r, i, s in got) == sorted(want)
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (3, [-1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(x) for x in neighbours.nearest(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 3, -1.0)]


def test_neighbours_of_many_copies(spark):
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else np.random.default_rng(i).normal(size=3).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = neighbours.nearest(frame, F.col("vec_id") % 50 == 0, 5, part_bytes=2000, block_bytes=400).collect()
    for q in (0, 150, 300):  # copies: the smallest ids of their kind
        assert [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == [i for i in range(0, 21, 3) if i != q][:5]


def test_neighbours_query(spark, sf):
    got = queries.op12_nearest_neighbours(spark, sf).collect()
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, 5)
    hit = sum(len({i for i, _ in near} & {x.vec_id for x in got if x.query_id == q}) for q, near in want)
    assert len(got) == 5 * len(want) and hit >= 0.9 * 5 * len(want)


# -- resampling ----------------------------------------------------------------------------------------


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())


def grams(text, shortest, longest):
    w = words(text)
    return [b" ".join(w[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]


def drawn(docs, target, percent, least, shortest, longest, buckets):
    bucket = lambda x: zlib.crc32(x) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams(text, shortest, longest)) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * float(n_s) / ((s[k] + 1) * float(n_t)))) for k in range(buckets)}
    rows = []
    for i, text in docs:
        own = grams(text, shortest, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in own)
        rows.append((i, len(words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = Counter()
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks[(*r, place)] += 1
    for r in [*able[percent * len(able) // 100 :], *(r for r in rows if r[1] < least)]:
        ranks[(*r, None)] += 1
    return ranks


def hard_texts():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(50)] + ["Über", "É", "x" * 200, "A1", "\U0001f600", "naïve"]
    docs = [(i, " ".join(r.choice(vocab) + r.choice(["", ",", " -", "\n"]) for _ in range(r.randrange(60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,;"), (None, docs[3][1]), (None, None), (5, docs[7][1]), *[(300, "same words " * 30)] * 60, (400, "q" * 70_000 + " end"), (401, " ".join(["long"] * 30_000))]
    return docs


@pytest.mark.parametrize(("shortest", "longest", "buckets", "percent"), [(1, 1, 10_000, 10), (1, 3, 97, 40), (2, 2, 5, 100)])
def test_resampling_against_brute_force(spark, shortest, longest, buckets, percent):
    docs, target = hard_texts(), ["w1 w2 w3 Über naïve", None, "", "w7 " * 20]
    frame = spark.createDataFrame([(*d, "n", 1, 2.0) for d in docs], "doc_id bigint, text string, n string, bucket int, score double").repartition(3)
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(frame, wanted, percent, 2024, 20, shortest, longest, buckets)
    assert Counter(tuple(x) for x in got.collect()) == drawn(docs, target, percent, 20, shortest, longest, buckets)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    none = docs.limit(0)
    assert importance.resample(none, docs).count() == 0
    assert sorted(tuple(x) for x in importance.resample(docs, none).select("doc_id", "n_features", "rank").collect()) == [(1, 3, None), (2, 0, None)]


def test_crcs_of_joined_strings():
    r = np.random.default_rng(2)
    a, b = (bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (37, 1_000_003))
    moved = importance.moved(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
    assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
    crc, of, n = importance.features(pa.array(["One two", None, "drei"]), 1, 2)
    assert sorted(crc.tolist()) == sorted(map(zlib.crc32, (b"one", b"two", b"drei", b"one two"))) and n.tolist() == [2, 0, 1] and sorted(of.tolist()) == [0, 0, 0, 2]
