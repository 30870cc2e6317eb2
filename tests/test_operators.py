"""Operators against plain Python on small tables, and properties of the packers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import images, scalar, stats
from corpusmill.operators import answers, corpus, evaluation, mixture, packing, sampling
from corpusmill.sources import sinks, text, tokbin
from corpusmill.streaming import streams


def encode(texts):
    return [list(t.encode()) for t in texts]


# -- packing ---------------------------------------------------------------------------------------


def pack_by_hand(lengths, per_rank, longest, ranks):
    out, i, n = [], 0, len(lengths)
    while True:
        step = []
        for _ in range(ranks):
            cur, taken = 0, []
            while cur <= per_rank:
                if i >= n:
                    return out
                k = min(lengths[i], longest, per_rank - cur + 1)
                taken.append((i, k))
                i, cur = i + 1, cur + k
            step.append(taken)
        out += step


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 50), st.integers(1, 30), st.integers(1, 3))
def test_document_packing(lengths, per_rank, longest, ranks):
    found = packing.pack_documents(np.array(lengths, np.int64), per_rank, longest, ranks)
    assert found == pack_by_hand(lengths, per_rank, longest, ranks)
    assert all(sum(t for _, t in b) == per_rank + 1 and max(t for _, t in b) <= longest for b in found)


def test_pack_shards(spark):
    r = random.Random(3)
    stream = [7, 8] + [x for _ in range(60) for x in [corpus.START_ID, *(r.randrange(256) for _ in range(r.randrange(1, 30)))]]
    rows = spark.createDataFrame([(0, 0, stream[:500]), (0, 500, stream[500:])], "shard bigint, position bigint, tokens array<int>")
    out = packing.pack_shards(rows, 64, 20, 2, buckets=1000).orderBy("step", "rank").collect()
    starts = [i for i, x in enumerate(stream) if x == corpus.START_ID]
    lengths = [b - a for a, b in zip(starts, [*starts[1:], len(stream)])]
    want = pack_by_hand(lengths, 64, 20, 2)
    assert len(out) == len(want)
    for row, docs in zip(out, want):
        buffer = [x for d, k in docs for x in stream[starts[d] : starts[d] + k]]
        assert row.inputs == buffer[:-1] and row.targets == buffer[1:]
        assert row.offsets[0] == 0 and row.offsets[-1] == 64 and len(row.offsets) == packing.max_docs(64)
        assert row.bigrams[0] == 999
        assert row.bigrams[1:] == [(36313 * b ^ 27191 * a) % 999 for a, b in zip(row.inputs, row.inputs[1:])]


def test_bigrams_of_batches(spark):
    rows = spark.createDataFrame([(1, [5, 6, 70000]), (2, []), (3, None), (4, [9])], "id int, inputs array<int>")
    got = packing.with_bigrams(rows, 1000).withColumn("want", packing.array_bigrams(F.col("inputs"), 1000)).collect()
    assert [(r.id, r.bigrams) for r in got] == [(r.id, r.want) for r in got] and got[0].bigrams[0] == 999


def test_windows(spark):
    sizes = [(0, 1), (1, 10), (2, 41), (3, 42), (4, 100)]
    got = {(r.shard, r.step, r["rank"], r.begin) for r in packing.windows(spark.createDataFrame(sizes, "shard int, n_tokens bigint"), 20, 2).collect()}
    want = {(s, k, r, k * 20 + r * 10) for s, n in sizes for k in range(max(0, (n - 2) // 20)) for r in (0, 1)}
    assert got == want


def simulate_ranks(sizes, steps, batch, ranks):
    """Cursor by cursor."""
    out = []
    for rank in range(ranks):
        shard, at = 0, rank * batch
        for step in range(steps):
            out.append((step, rank, shard, at))
            at += batch * ranks
            if at + batch * ranks + 1 > sizes[shard]:
                shard, at = (shard + 1) % len(sizes), rank * batch
    return sorted(out)


def test_rank_cursors(spark):
    sizes = [41, 65, 100, 58]
    shards = spark.createDataFrame(list(enumerate(sizes)), "shard int, n_tokens bigint")
    got = sorted((r.step, r["rank"], r.shard, r.begin) for r in packing.rank_cyclic_windows(shards, 25, 5, 3).collect())
    assert got == simulate_ranks(sizes, 25, 5, 3)
    assert len({s for _, r, s, _ in got if r == 0}) == 4
    streams = spark.createDataFrame([("a", 50)], "stream string, n_tokens bigint")
    got = [(r.step, r["rank"], r.begin) for r in packing.rank_stride_windows(streams, 5, 8, 2).orderBy("rank", "step").collect()]
    assert got == [(0, 0, 0), (1, 0, 16), (2, 0, 32), (3, 0, 0), (4, 0, 16), (0, 1, 8), (1, 1, 24), (2, 1, 40), (3, 1, 8), (4, 1, 24)]
    with pytest.raises(Exception, match="shorter than a window"):
        packing.rank_stride_windows(streams, 2, 30, 2).collect()


def simulate_pool(sizes, draws, block):
    """(shard, begin, tokens) of each draw, on token arrays."""
    arrays = [[(s, i) for i in range(n)] for s, n in enumerate(sizes)]
    shard, tokens, at, out = 0, arrays[0], 0, []
    for _ in range(draws):
        tries = 0
        while at + block + 1 > len(tokens):
            shard, at, tries = (shard + 1) % len(sizes), 0, tries + 1
            tokens = arrays[shard]
            if tries > len(sizes) + 1:
                tokens = [tokens[i % len(tokens)] for i in range(block + 2)]
        out.append(tokens[at : at + block + 1])
        at += block
    return out


@pytest.mark.parametrize("sizes", [[25, 8, 40], [7, 3, 5], [11], [4]])
def test_pool_blocks(spark, sizes):
    draws = spark.createDataFrame([(10 * k, "p", k) for k in range(12)], "step int, pool string, k bigint")
    shards = spark.createDataFrame([("p", s, n) for s, n in enumerate(sizes)], "pool string, shard int, n_tokens bigint")
    got = packing.pool_blocks(draws, shards, 10).orderBy("step").collect()
    read = [[(r.shard, (r.begin + i) % sizes[r.shard] if r.tiled else r.begin + i) for i in range(r.length)] for r in got]
    assert read == simulate_pool(sizes, 12, 10)


def test_stream_documents(spark):
    shards = spark.createDataFrame([(0, 10), (1, 7), (2, 30)], "shard int, n_tokens bigint")
    got = [(r.shard, r.begin, r.length) for r in packing.stream_documents(shards, 22, 4).orderBy("shard", "begin").collect()]
    assert got == [(0, 0, 4), (0, 4, 4), (0, 8, 2), (1, 0, 4), (1, 4, 3), (2, 0, 4), (2, 4, 1)]


def plain_choices(tasks, seq_len):
    """Token by token: (tokens, targets, task ids, spans) of each sequence."""
    out, pairs, ids, spans = [], [], [], []

    def close():
        nonlocal pairs, ids, spans
        pairs += [(0, 0)] * (seq_len - len(pairs))
        out.append(([x for x, _ in pairs], [y for _, y in pairs], ids, spans))
        pairs, ids, spans = [], [], []

    for _, task, ctx, four, _ in tasks:
        texts = [[*ctx.encode(), *f" {e}".encode()] for e in four]
        if pairs and len(pairs) + sum(map(len, texts)) >= seq_len:
            close()
        ids.append(task)
        for whole in texts:
            if pairs:
                pairs.append((corpus.START_ID, corpus.START_ID))
            spans.append([len(pairs) + len(ctx) - 1, len(pairs) + len(whole) - 1])
            pairs += zip(whole[:-1], whole[1:], strict=True)
    close()
    return out


def test_choice_packing(spark):
    tasks = [(0, i, "context" * (i % 3 + 1), ["a", "bb", "ccc", "dddd"], i % 4) for i in range(12)]
    df = spark.createDataFrame(tasks, "part int, task_id bigint, ctx string, endings array<string>, label int")
    out = packing.pack_choices(df, lambda t: list(t.encode()), 200).orderBy("sequence").collect()
    assert [(r.tokens, r.targets, r.task_ids, r.spans) for r in out] == plain_choices(tasks, 200) and len(out) > 3
    assert [x for r in out for x in r.labels] == [t[4] for t in tasks]
    for r in out:
        ends = [i + 1 for i, t in enumerate(r.tokens) if t == corpus.START_ID]
        assert r.offsets == [0, *ends, *[200] * (127 - len(ends))]
        for k, (a, b) in enumerate(r.spans):
            assert bytes(r.targets[a:b]).decode() == " " + ["a", "bb", "ccc", "dddd"][k % 4]
    one = packing.pack_choices(spark.createDataFrame([(0, 1, "c", ["w", "xx", "y", "z"], 2)], df.schema), lambda t: list(t.encode()), 40).collect()[0]
    assert one.spans == [[0, 2], [3, 6], [7, 9], [10, 12]] and one.tokens[:12] == [*b"c ", corpus.START_ID, *b"c x", corpus.START_ID, *b"c ", corpus.START_ID, *b"c "]
    with pytest.raises(Exception, match="four endings"):
        packing.pack_choices(spark.createDataFrame([(0, 1, "c", ["a"], 0)], df.schema), lambda t: list(t.encode()), 200).collect()
    with pytest.raises(Exception, match="longer than a sequence"):
        packing.pack_choices(df, lambda t: list(t.encode()), 20).collect()


def test_turns_and_collate(spark):
    rows = spark.createDataFrame([(1, ["q", "an answer", "more", "yes", "left over"], 2.0, 4, [50259, 50257]), (2, ["q", "a"], 1.0, 0, None), (3, ["alone"], 1.0, 1, None)], "id bigint, turns array<string>, message_weight double, n_sub int, image_ids array<int>")
    got = {r.id: r for r in packing.encode_turns(rows, encode, 100).collect()}
    said = [("\nUser: q\nAssistant:", 0), (" an answer", 1), ("\nUser: more\nAssistant:", 0), (" yes", 1)]
    ids, weights = [50259, 50257], [0.0, 0.0]
    for piece, answer in said:
        own = [*piece.encode(), *[corpus.START_ID] * answer]
        ids, weights = ids + own, weights + [2 / math.sqrt(len(own)) / 2 if answer else 0.0] * len(own)
    assert (got[1].inputs, got[1].targets, got[1].weights) == (ids[:-1], ids[1:], pytest.approx(weights[1:]))
    assert got[1].weights[-1] == pytest.approx(1 / math.sqrt(5)) and got[3].inputs == []
    short = {r.id: r for r in packing.encode_turns(rows, encode, 30).collect()}
    assert short[1].inputs == ids[:29] and short[1].targets == ids[1:30]
    batch = packing.collate(packing.encode_turns(rows, encode, 100).withColumn("batch", F.lit(0))).collect()[0]
    n = sum(len(r.inputs) for r in got.values())
    assert len(batch.inputs) % 16 == 0 == batch.offsets[0] and batch.offsets[-1] == len(batch.inputs)
    assert set(batch.inputs[n:]) == {corpus.START_ID} and set(batch.targets[n:]) == {0} == set(batch.weights[n:])


def test_collated_images(spark):
    p = packing.PATCH_ID
    rows = [
        (0, 1, [5, p, p, 7], [6, 7, 8, 9], [0.0] * 4, 2, [[0, 1, -1, -1], [2, 3, 4, 9]]),
        (0, 2, [p, 1], [1, 2], [0.0] * 2, 3, [[1, 2, -1, -1], [11, 12, -1, -1], [13, -1, -1, -1]]),
        (0, 3, [p, 4], [4, 4], [0.0] * 2, 1, [[0, 1, 2, 3]]),
    ]
    df = spark.createDataFrame(rows, "batch int, id int, inputs array<int>, targets array<int>, weights array<double>, crops int, pooled array<array<bigint>>")
    got = packing.collate_images(df, 10).first()
    assert got.crops == [2, 1, 1]
    assert got.pooled == [[0, 1, -1, -1], [2, 3, 4, 9], [21, 22, -1, -1], [30, 31, 32, 33]]
    assert got.inputs[:8] == [5, p, p, 7, p, 1, p, 4] and got.offsets == [0, 4, 6, 8, 16]


# -- corpus -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 7, 50])
def test_shards_hold_the_stream(spark, size):
    r = random.Random(size)
    docs = [(i, [r.randrange(100) for _ in range(r.choice([0, 1, 5, 30, 120]))]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, ids array<int>").withColumn("n_tokens", F.size("ids"))
    pieces = corpus.take_slices(corpus.shard_slices(df, size)).orderBy("shard", "position").collect()
    assert [x for p in pieces for x in p.tokens] == [x for _, ids in docs for x in ids]
    for p in pieces:
        assert p.position + len(p.tokens) <= size


def test_tokbin_round_trip(spark, tmp_path):
    docs = [(s, 10 * k, [(s * 999 + k * 7 + j) % 65536 for j in range(10)]) for s in range(3) for k in range(4)]
    df = spark.createDataFrame(docs, "shard bigint, position bigint, tokens array<int>")
    tokbin.write_shards(df, str(tmp_path / "a"))
    got = tokbin.read_shards(spark, str(tmp_path / "a")).orderBy("shard", "position").collect()
    assert [r.token for r in got] == [x for _, _, t in docs for x in t]
    chunks = tokbin.read_shards(spark, str(tmp_path / "a"), layout="chunks").collect()
    assert sorted(len(c.tokens) for c in chunks) == [40, 40, 40]
    tokbin.write_shards(df, str(tmp_path / "b"), bits=32)
    paths = spark.createDataFrame([(p,) for p in tokbin.list_shards(str(tmp_path / "b"))], "path string")
    assert {(r.bits, r.tokens) for r in tokbin.count_tokens(spark, paths).collect()} == {(32, 40)}
    with pytest.raises(Exception, match="not of 16 bits"):
        tokbin.read_shards(spark, str(tmp_path / "b")).collect()
    (tmp_path / "bad.bin").write_bytes(b"\0" * 2000)
    with pytest.raises(tokbin.BadShard):
        tokbin.read_header(str(tmp_path / "bad.bin"))
    (tmp_path / "short.bin").write_bytes(tokbin.encode_shard(np.arange(5))[:-1])
    with pytest.raises(tokbin.BadShard):
        tokbin.read_header(str(tmp_path / "short.bin"))
    with pytest.raises(tokbin.BadShard):
        tokbin.encode_shard(np.array([70000]))


def test_marked_text(spark):
    markers = {"<a>": 1000, "</a>": 1001, "<end>": 1002}
    df = spark.createDataFrame([("hi <a>xy</a> yo<end>",), ("<a>x",), (None,)], "text string")
    got = [r.ids for r in corpus.encode_marked(df, markers, "<a>", "</a>", {"x": 500, "y": 501}, encode).collect()]
    assert got == [[*b"hi ", 1000, 500, 501, 1001, *b" yo", 1002], [1000, 500], []]
    with pytest.raises(Exception, match="unknown character"):
        corpus.encode_marked(spark.createDataFrame([("<a>z",)], "text string"), markers, "<a>", "</a>", {"x": 1}, encode).collect()


def test_tokenise(spark):
    df = spark.createDataFrame([("aé",), ("",), (None,)], "text string")
    want = [[corpus.START_ID, 97, 195, 169], [corpus.START_ID], [corpus.START_ID]]
    assert [r.ids for r in corpus.tokenise(df, encode).collect()] == want
    assert [r.ids for r in corpus.byte_tokenise(df).collect()] == want
    with pytest.raises(Exception, match="not below"):
        corpus.tokenise(df, lambda t: [[70000]] * len(t)).collect()


def test_library_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello, world", "", "naïve  text\n"]
    got = corpus.tokenise(spark.createDataFrame([(t,) for t in texts], "text string"), corpus.library_encoder(path)).collect()
    library = Tokenizer.from_file(path)
    assert [r.ids for r in got] == [[corpus.START_ID, *library.encode(t, add_special_tokens=False).ids] for t in texts]


def test_bins_and_duplicates(spark):
    assert corpus.balanced_bins([5, 4, 3, 3, 3], 2) == [0, 1, 1, 0, 1]
    with pytest.raises(ValueError, match="same name"):
        corpus.pool_table(spark, [{"name": "a"}, {"name": "a"}], "name string")


# -- sources and sinks --------------------------------------------------------------------------------


def test_jsonl(spark, tmp_path):
    import zstandard

    lines = '{"text": "one"}\n\n{"body": "two", "text": "x"}\nnot json\n{"text": ""}\n{"other": 1}\n'
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(lines.encode()))
    good, bad = text.read_jsonl(spark, str(tmp_path / "a.jsonl.zst"), "body")
    assert sorted(r.text for r in good.collect()) == ["one", "two"]
    assert sorted(r.reason for r in bad.collect()) == ["no text", "no text", "not JSON"]


def test_parquet_text_column(spark, tmp_path):
    df = spark.sql("select 1 as n, 'hello' as body, named_struct('set', 'a') as meta union all select 2, '', named_struct('set', 'a') union all select 3, 'no', named_struct('set', 'b')")
    df.write.parquet(str(tmp_path / "p"))
    assert [r.text for r in text.read_parquet_texts(spark, str(tmp_path / "p"), "missing", "meta.set", "a").collect()] == ["hello"]


def test_logs(spark, tmp_path):
    (tmp_path / "run.log").write_text("x\nstep:0/9 val_loss:4.5 train_time:0ms step_avg:nanms\nstep:9/9 val_loss:3.25 train_time:12.500s step_avg:1.00ms\nstep:5/9 train_loss:1\ns:3 tel:2.5\n")
    rows = text.parse_log(text.read_log_lines(spark, str(tmp_path / "run.log"))).orderBy("line_no").collect()
    assert [(r.step, r.val_loss, r.train_ms) for r in rows] == [(0, 4.5, 0.0), (9, 3.25, 12500.0), (3, 2.5, None)]
    with pytest.raises(Exception, match="bad table row"):
        text.markdown_rows(spark.createDataFrame([("f", 0, "| 1 | a |")], "file string, line_no int, value string")).collect()
    kv = spark.createDataFrame([("f", "seed=0"), ("f", "started_at=a=b"), ("f", "noise")], "file string, value string")
    assert text.key_values(kv, ["seed", "started_at"]).collect()[0].asDict() == {"file": "f", "seed": "0", "started_at": "a=b"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", 1), ("a", "val", 2), ("b", "train", 3)], "source string, split string, x int")
    sinks.push_partitioned(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("source = 'a' and split = 'val'").first().x == 2
    spec = spark.createDataFrame([("g", 1.0, "n", "a", None, 1.0), ("g", 1.0, "m", "zzz", 5.0, 1.0)], "grp string, grp_weight double, name string, source string, size double, message_weight double")
    made = sinks.mixture_json(spec, rows.groupBy("source").agg(F.count("*").alias("n")), "sqrt").first().value
    assert '"size":2.0' in made and "zzz" not in made


# -- functions ------------------------------------------------------------------------------------------


def test_student_t():
    assert stats.t_lower(0, 5) == pytest.approx(0.5)
    assert stats.t_lower(-2.0, 1) == pytest.approx(0.5 + math.atan(-2) / math.pi)
    assert stats.t_lower(-1.5, 2) == pytest.approx(0.5 - 1.5 / (2 * math.sqrt(2 + 2.25)))
    assert math.isnan(stats.t_lower(float("nan"), 3))


def test_answers(spark):
    rows = spark.createDataFrame([("B", ["x", "y"]), ("c", ["x", "y"]), ("1", ["x", "y"]), (" free text ", []), (None, ["x"])], "a string, c array<string>")
    assert [r[0] for r in rows.select(scalar.resolve_answer("a", "c")).collect()] == ["y", "c", "y", "free text", None]
    pairs = spark.createDataFrame([(1, (["a", "", "c"], ["1", "2"]))], "id int, qa_pairs struct<question: array<string>, answer: array<string>>")
    assert [(r.q, r.a) for r in answers.paired_lists(pairs).collect()] == [("a", "1")]


def test_statistics_queries(spark):
    rows = spark.createDataFrame([("a", 3.27), ("a", 3.28), ("a", 3.26), ("b", 3.3), ("b", 3.29)], "arm string, loss double")
    one = {r.arm: r for r in stats.one_sample_less(rows, ["arm"], "loss", 3.28).collect()}
    assert one["a"].p == pytest.approx(stats.t_lower(-0.01 / (0.01 / math.sqrt(3)), 2)) and one["b"].p > 0.5
    w = stats.welch(rows, "arm", "loss", "a", "b").first()
    assert w.p < 0.1 and w.t < 0


def test_perplexity(spark):
    rows = spark.createDataFrame([("a", [1, 2, 3], 0, 3, [1.0, 1.0]), ("b", [1, 2], 5, 9, [float("nan")]), ("c", [1], 0, 1, [])], "set string, ids array<int>, cont_start int, n_bytes bigint, nats array<double>")
    got = evaluation.bits_per_byte(rows).first()
    assert got.bpb == pytest.approx(2 / math.log(2) / 3) and got.ppl == pytest.approx(math.e) and got.tokens == 2
    empty = evaluation.bits_per_byte(rows.filter("set = 'c'")).first()
    assert math.isnan(empty.bpb) and math.isnan(empty.ppl)
    docs = spark.createDataFrame([("hello world", [[6, 11]]), ("é", None)], "text string, spans array<array<int>>")
    out = evaluation.prepare_spans(docs, encode, len, 4).collect()
    assert (out[0].ids, out[0].cont_start, out[0].n_bytes) == (list(b"orld"), 0, 4)
    assert (out[1].cont_start, out[1].n_bytes) == (0, 2)


def test_images(spark):
    def tiling(h, w, most, tile):
        c = sorted((i * j, i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most)
        s = [min(i * tile / h, j * tile / w) for _, i, j in c]
        ok = [k for k in range(len(c)) if s[k] >= 1]
        return c[min(ok, key=lambda k: s[k])][1:] if ok else c[max(range(len(c)), key=lambda k: s[k])][1:]

    sizes = [(i, h, w) for i, (h, w) in enumerate([(10, 10), (100, 50), (900, 300), (5000, 4000), (20, 700)])]
    got = {r.image_id: (r.rows, r.cols) for r in images.choose_tiling(spark.createDataFrame(sizes, "image_id int, height int, width int"), 8, 100).collect()}
    assert got == {i: tiling(h, w, 8, 100) for i, h, w in sizes}
    ids, patches, pooled = images.multi_crop(np.random.default_rng(0).integers(0, 256, (500, 700, 3), dtype=np.uint8), 4)
    assert ids.count(images.PATCH_ID) == len(pooled) and ids[0] == images.IMAGE_START_ID and ids[-2:] == [images.ROW_END_ID, images.IMAGE_END_ID] and ids.count(images.IMAGE_START_ID) == 2
    assert patches.shape[1:] == (729, 588) and pooled.max() < patches.shape[0] * 729 and abs(patches).max() <= 1.0001
    used = pooled[pooled >= 0]
    assert len(used) == len(set(used.tolist()))
    assert images.preprocess(images.synthetic_images(spark, 3, 1).filter("height is not null"), 2).count() <= 3


def plain_resize(image, height, width):
    """Pixel by pixel."""
    h, w, _ = image.shape
    out = np.zeros((height, width, 3))
    for y in range(height):
        for x in range(width):
            v, u = max((y + 0.5) * h / height - 0.5, 0), max((x + 0.5) * w / width - 0.5, 0)
            i, j = int(v), int(u)
            a, b, k, m = v - i, u - j, min(i + 1, h - 1), min(j + 1, w - 1)
            out[y, x] = (1 - a) * ((1 - b) * image[i, j] + b * image[i, m].astype(float)) + a * ((1 - b) * image[k, j] + b * image[k, m].astype(float))
    return out / 255 * 2 - 1


@pytest.mark.parametrize("size", [(7, 5), (30, 3), (4, 40), (1, 1), (20, 20)])
def test_resize_reads_the_nearest_pixels_only(size):
    image = np.random.default_rng(1).integers(0, 256, (20, 20, 3), dtype=np.uint8)
    assert np.allclose(images.resize(image, *size), plain_resize(image.astype(float), *size), atol=1e-4)


def test_image_segments(spark):
    prepared = spark.createDataFrame([("a", 2, [1, 2], [[0, 5, -1, -1]]), ("b", 1, [3], [[0, 1, 2, -1]])], "image string, crops int, ids array<int>, pooled array<array<bigint>>")
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "a", "b"]), (3, [])], "id int, images array<string>")
    got = {r.id: r for r in images.image_segments(rows, prepared, lambda t: list(t.encode()), 10, most=3).collect()}
    assert (got[1].image_ids, got[1].crops, got[1].pooled) == ([1, 2], 2, [[0, 5, -1, -1]])
    assert got[2].image_ids == [1, 2, *b" Image 2: ", 3, *b" Image 3: ", 1, 2] and got[2].crops == 5
    assert got[2].pooled == [[0, 5, -1, -1], [20, 21, 22, -1], [30, 35, -1, -1]]
    assert (got[3].image_ids, got[3].crops, got[3].pooled) == ([], 0, [])


@pytest.mark.parametrize("by", [None, "g"])
def test_prefix_sums_with_nulls_and_far_off_keys(spark, by):
    r = random.Random(6)
    keys = [None, None, *(r.randrange(50) for _ in range(300)), 10**15, -(10**15), *range(10**6, 10**6 + 200)]
    rows = [(k, r.choice(["a", "b", None]), r.choice([None, 1, 5, 9]), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k bigint, g string, v bigint, i int")
    got = corpus.prefix_sums(df, "k", "v", by=by, rows_per_bucket=8, then=("i",)).collect()
    want, totals = {}, {}
    for k, g, v, i in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[3])):
        want[i] = totals.get(g if by else 0, 0)
        totals[g if by else 0] = want[i] + (v or 0)
    assert {x.i: x.start for x in got} == want
    assert sorted(x.n for x in corpus.numbered(df.limit(0), "k", "n").collect()) == []


def test_weights_maps_and_results(spark):
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    weights = spark.createDataFrame([("r1", "a", 0.25), ("r1", "b", 0.75)], "run_id string, pool string, w double")
    got = mixture.runs_with_weights(runs, weights)
    assert {x.run_id: x.weights for x in got.collect()} == {"r1": {"a": 0.25, "b": 0.75}, "r2": {}}
    pools = spark.createDataFrame([("a", "x")], "pool string, grp string")
    table = mixture.collect_results(got.withColumn("bpb", F.lit(1.5)), pools, ["bpb"], ["?", "x"])
    assert {x.run_id: (x["w_?"], x.w_x) for x in table.collect()} == {"r1": (0.75, 0.25), "r2": (0.0, 0.0)}
    steps = evaluation.warm_up_steps(spark.createDataFrame([(2,), (9,), (10,)], "step int"))
    assert sorted(x.step for x in steps.collect()) == [0, 1, 2, 3, 7, 8, 9, 10, 11]


def test_mixture(spark):
    designs = mixture.sparse_designs(spark, ["a", "b", "c"], ["x", "x", "y"], 5, 0)
    sums = designs.groupBy("run_id").agg(F.sum("w").alias("s")).collect()
    assert len(sums) == 8 and all(r.s == pytest.approx(1) for r in sums)
    draws = mixture.weighted_draws(spark.range(2000).withColumnRenamed("id", "step"), spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, rate double"), "source", 1)
    assert 1700 < draws.filter("source = 'a'").count() < 1900


def test_batches_and_windows(spark):
    rows = spark.createDataFrame([("g", i) for i in range(5)], "g string, x int")
    assert sorted(tuple(r["items"]) for r in sampling.batches(rows, "g", "x", 2, "x").collect()) == [(0, 1), (2, 3), (4,)]
    with pytest.raises(ValueError):
        sampling.batches(rows, "g", "x", 0, "x")
    with pytest.raises(ValueError):
        evaluation.moving_means(rows, ["g"], ["x"], "x", 0)


# -- streaming --------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"event": "val", "step": 1}\n{"event": "train", "step": 2, "train_loss": 2.0}\n')
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    streams.ingest(streams.metric_events(spark, str(src)), out, check)
    (src / "b.json").write_text('{"event": "train", "step": 3, "train_loss": 4.0}\n')
    streams.ingest(streams.metric_events(spark, str(src)), out, check)
    got = {r.event: (r.n, r.last_step, r.mean_loss) for r in streams.event_totals(spark.read.parquet(out)).collect()}
    assert got == {"val": (1, 1, None), "train": (2, 3, 3.0)}


def test_stateful_packer(spark, tmp_path):
    src = tmp_path / "tokens"
    schema = "stream string, position bigint, ids array<int>"
    spark.createDataFrame([("s", 0, list(range(10))), ("s", 10, list(range(10, 17)))], schema).coalesce(1).write.parquet(str(src))
    query = streams.pack_stream(spark.readStream.schema(schema).parquet(str(src)), 4).writeStream.format("memory").queryName("packed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("select * from packed order by step").collect()
    query = streams.pack_stream(spark.readStream.schema(schema).parquet(str(src)), 4, [(1, 2), (3, 5)]).writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "d")).start()
    query.processAllAvailable()
    query.stop()
    changed = spark.sql("select * from changed order by step").collect()
    assert [r.inputs for r in changed] == [[0, 1, 2, 3], [4, 5], [6, 7], [8, 9, 10, 11, 12]]
    assert [r.inputs for r in rows] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15]]
    assert rows[0].targets == [1, 2, 3, 4]


def test_bootstrap_means(spark):
    rows = spark.createDataFrame([(4, 2.0), (None, 1.0), (4, 3.0), (9, None), (-5, 0.0)], "run long, loss double")
    got = {r.sample: r["mean"] for r in sampling.bootstrap_means(rows, "run", "loss", 5, 3, seed=2).collect()}
    values = [1.0, 0.0, 2.0, 3.0]  # by key, the null one first, then by value
    draw = lambda s, i: values[int(int(hashlib.md5(f"2|{s}|{i}".encode()).hexdigest()[:12], 16) / 16**12 * 4)]
    assert got == pytest.approx({s: sum(draw(s, i) for i in range(3)) / 3 for s in range(5)})
    assert sampling.bootstrap_means(rows.filter("loss is null"), "run", "loss", 5, 3).count() == 0


def test_vocabulary_pools_hold_the_librarys_ids(spark, sf):
    """What the shards hold is, id by id, what the library gives for the pool's documents in order."""
    import __spark_entry__ as entry
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pools = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 0").orderBy("doc_id").collect():
        own = pools.setdefault(r.source, [])
        if len(own) < 40_000:
            own += [50256, *library.encode(r.text, add_special_tokens=False).ids]
    want = {(p, k): (len(x), sum(x), sum(t * (i % 1009) for i, t in enumerate(x))) for p, ids in pools.items() for k in range(-(-len(ids) // 16_384)) for x in [ids[k * 16_384 : (k + 1) * 16_384]]}
    assert {(r.pool, r.shard): (r.n, r.tokens, r.placed) for r in entry.queries()["vocabulary_pools"](spark, sf).collect()} == want
