"""What a task holds at a time is bounded, whatever an Arrow batch or a group holds; results stay the same."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import html
from corpusmill.operators import corpus, evaluation, packing
from corpusmill.sources import tokbin
from corpusmill.streaming import stateful


def bounded(texts):
    """An encoder that refuses more than it should get in one call."""
    if len(texts) > 1 and sum(len(t.encode()) for t in texts) > corpus.AT_ONCE:
        raise ValueError("too many texts at a time")
    return [list(t.encode()) for t in texts]


def long_texts(spark):
    """One partition, one Arrow batch: many texts, an empty one, a null, one longer than a piece."""
    return spark.range(400).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "").when(F.col("id") != 9, F.repeat(F.lit("añ "), F.when(F.col("id") == 5, 90_000).otherwise(F.col("id") * 3).cast("int"))).alias("text"))


def test_pieces():
    batch = pa.RecordBatch.from_pydict({"a": ["xx", None, "", "yyyyyyy", "z"], "b": [["u", "vv"], [], None, ["w"], ["x" * 9]], "c": [[1, 2], [], [3], [4], [5, 6, 7]]})
    sizes = lambda *x: [p.num_rows for p in corpus.pieces(*x)]
    assert sizes(batch, "a", 3) == [3, 1, 1] and sizes(batch, "b", 4) == [4, 1] and sum(sizes(batch, "c", 16)) == 5
    assert pa.Table.from_batches(corpus.pieces(batch.slice(1), "b", 4)).equals(pa.Table.from_batches([batch.slice(1)]))
    assert sizes(batch.slice(2), "b", 4) == [2, 1] and sizes(batch.slice(0, 0), "a", 4) == []


def test_texts_are_encoded_in_pieces(spark):
    docs = long_texts(spark)
    want = {r.doc_id: [corpus.START_ID, *(r.text or "").encode()] for r in docs.collect()}
    assert {r.doc_id: r.ids for r in corpus.tokenise(docs, bounded).collect()} == want


def packed_by_hand(tasks, seq_len):
    """Plain version: (part, sequence) -> ids of its tasks and tokens."""
    out, at, part, number = {}, 0, None, 0
    for p, key, ctx, endings in sorted(tasks):
        need = sum(len(f"{ctx} {e}".encode()) for e in endings)
        if p != part:
            part, number, at = p, 0, 0
        elif at + need >= seq_len:
            number, at = number + 1, 0
        ids, tokens = out.setdefault((p, number), ([], []))
        ids.append(key)
        for e in endings:
            tokens += ([corpus.START_ID] if tokens else []) + list(f"{ctx} {e}".encode())[:-1]
        at = len(tokens)
    return {k: (ids, tokens + [0] * (seq_len - len(tokens))) for k, (ids, tokens) in out.items()}


def test_choices_of_a_part_are_packed_in_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_TASKS", 7)
    tasks = [(i % 3, i * 37 % 401, "c" * (i * i % 23), ["a", "bb", "c" * (i % 5), "é"]) for i in range(200)]
    tasks += [(3, 1, "x" * 45, ["a"] * 4), (3, 2, "", ["b"] * 4), (4, 9, "only", ["a"] * 4)]  # 188 tokens; the next one fits, and one alone
    rows = spark.createDataFrame([(*t, 1) for t in tasks], "part int, task_id bigint, ctx string, endings array<string>, label int").repartition(5)
    got = {(r.part, r.sequence): (r.task_ids, r.tokens) for r in packing.pack_choices(rows, lambda t: list(t.encode()), 200).collect()}
    assert got == packed_by_hand(tasks, 200)


def test_no_task_packs_a_whole_part(spark, monkeypatch):
    """The largest group that Python gets is a cell, not a part."""
    monkeypatch.setattr(packing, "CELL_TASKS", 50)
    sizes = spark.range(1000).select(F.lit(0).alias("part"), F.col("id").alias("_i"), (F.col("id") % 9 + 4).alias("_n"))
    cells = [n for n in re.findall(r"FlatMapGroupsInPandas \[(.*?)\]", packing._choice_places(sizes, 64, "part")._jdf.queryExecution().optimizedPlan().toString())]
    assert len(cells) == 3 and sum("_cell" in n for n in cells) == 2  # the third sees a row for each cell


def test_bytes_in_pieces(spark):
    docs = long_texts(spark)
    want = {r.doc_id: [corpus.START_ID, *(r.text or "").encode()] for r in docs.collect()}
    assert {r.doc_id: r.ids for r in corpus.byte_tokenise(docs).collect()} == want
    cut = corpus.byte_ids(corpus.byte_pieces(docs, 1000)).collect()
    assert [t for r in sorted(cut, key=lambda r: (r.shard, r.position)) for t in r.tokens] == [t for k in sorted(want) if k != 9 for t in want[k]]
    assert sum(len(r.tokens) for r in cut) == sum(len(v) for k, v in want.items() if k != 9) and all(len(r.text) + r.starts == len(r.tokens) for r in cut)  # a null text has no length, so no piece


def test_tasks_follow_tokens_not_files(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"x{i:03d}.bin").write_bytes(tokbin.encode_shard(np.arange(i, i + 50)))
    for options in ({}, {"layout": "chunks"}):
        parts = tokbin.TokenReader({"path": str(tmp_path)} | options).partitions()
        assert len(parts) <= 2 * tokbin.FEW and [r[0][-7:-4] for p in parts for r in p.ranges] == [f"{i:03d}" for i in range(200)]
    assert len(tokbin.TokenStream({"path": str(tmp_path)}).partitions({}, {f"{tmp_path}/x{i:03d}.bin": 50 for i in range(200)})) <= 2 * tokbin.FEW
    rows = tokbin.read_shards(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= 2 * tokbin.FEW
    assert sorted((int(r.shard[-7:-4]), r.position, r.token) for r in rows.collect()) == [(i, k, i + k) for i in range(200) for k in range(50)]
    assert rows.filter("position = 9").agg(F.sum("token")).first()[0] == sum(i + 9 for i in range(200))


def test_turns_are_encoded_in_pieces(spark):
    rows = long_texts(spark).select(F.col("doc_id").alias("id"), F.array(F.coalesce("text", F.lit("q")), F.lit("yes")).alias("turns"), F.lit(1.0).alias("message_weight"), F.lit(1).alias("n_sub"))

    def encode(texts):
        if len(texts) > 2 and sum(len(t.encode()) - 18 for t in texts) > corpus.AT_ONCE:
            raise ValueError("too many turns at a time")
        return [list(t.encode()) for t in texts]

    got = {r.id: [*r.inputs, r.targets[-1]] for r in packing.encode_turns(rows, encode, 1 << 20).collect()}
    assert got == {r.id: [*f"\nUser: {r.turns[0]}\nAssistant: yes".encode(), corpus.START_ID] for r in rows.collect()}


def test_bigrams_are_hashed_in_pieces(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "pieces", lambda batch, column: (seen.append(x.num_rows) or x for x in corpus.pieces(batch, column, 40)))
    rows = spark.createDataFrame([(i, list(range(i))) for i in range(30)], "step bigint, inputs array<int>")
    ((run, _),) = _python_functions(monkeypatch, rows)
    batch = pa.RecordBatch.from_pylist([{"step": i, "inputs": list(range(i))} for i in range(30)], pa.schema([("step", pa.int64()), ("inputs", pa.list_(pa.int32()))]))
    got = [(r["step"], r["bigrams"]) for b in run(iter([batch])) for r in b.to_pylist()]
    assert got == [(i, packing.hash_bigrams(np.arange(i), 97).tolist()) for i in range(30)] and max(seen) == 5 and sum(seen) == 30


def _python_functions(monkeypatch, rows):
    found = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: found.append((f, schema)) or self)
    packing.with_bigrams(rows, 97)
    return found


def test_a_stream_s_lot_is_held_as_plain_numbers(monkeypatch):
    """No frame of all rows is made, and windows are given out a few at a time; order by position, stable."""
    monkeypatch.setattr(stateful, "WINDOWS", 3)
    monkeypatch.setattr(stateful.pd, "concat", None)

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, x):
            self.held = x

    packer = stateful._Packer(4)
    packer.rest, packer.place = Value(), Value()
    lot = pd.DataFrame({"position": [5, 1, 9, 3, 1, 2, 1], "ids": [np.arange(20), np.array([70, 71]), None, None, np.array([72]), np.array([], np.int32), None], "length": [None, None, 7.0, 6.0, None, None, 5.0]})
    out = list(packer.handleInputRows(("s",), iter([lot[:2], lot[2:]]), None))
    ids = [70, 71, 72, *range(20)]
    assert [len(x) for x in out] == [3, 2] and [list(x) for f in out for x in f["inputs"]] == [ids[i : i + 4] for i in range(0, 20, 4)]
    assert [list(x) for f in out for x in f["targets"]] == [ids[i + 1 : i + 5] for i in range(0, 20, 4)] and [s for f in out for s in f["step"]] == list(range(5))
    assert packer.place.held == (5, 7) and list(np.frombuffer(packer.rest.held[0], np.int32)) == ids[20:]
    assert list(packer.handleInputRows(("s",), iter([lot[2:4]]), None)) == []


def test_pools_of_a_table_have_one_description(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, None)], "name string, topic string")
    assert sorted((r.name or "", r.topic or "") for r in corpus.distinct_pools(rows).collect()) == [("", ""), ("a", "x"), ("b", "y")]
    with pytest.raises(Exception, match="two pools have the same name"):
        corpus.distinct_pools(rows.union(spark.createDataFrame([("b", "z")], rows.schema))).collect()


def test_a_reference_that_is_cut_off_stays():
    """The SQL of pages replaces references with their semicolon only; browsers take some without."""
    assert html.decoded("&amp &lt;&eacute;&#39;&#x41;&notit; &nosuch; &amp;lt; a&am", closed=True) == "&amp <é'A&notit; &nosuch; &lt; a&am"
    assert html.decoded("&amp &lt;") == "& <"
    cut = "<title>a &amp</title><a href='?x=1&copy=2'>b &amp</a><p>c &amp</p>"
    found = html.page(cut, closed=True)
    assert found["title"] == "a &amp" and found["links"] == [{"href": "?x=1&copy=2", "text": "b &amp"}] and [b["text"] for b in found["blocks"]] == ["b &amp", "c &amp"]
    assert html.page(cut)["title"] == "a &"


def test_spans_are_prepared_in_pieces(spark):
    docs = long_texts(spark).withColumn("spans", F.array(F.array(F.lit(4), F.lit(6))))
    got = {r.doc_id: (r.ids, r.cont_start, r.n_bytes) for r in evaluation.prepare_spans(docs, bounded, len, 50).collect()}
    for r in docs.collect():
        n, start = len((r.text or "").encode()), max(0, min(len((r.text or "")[:4].encode()), len((r.text or "").encode()) - 1))
        assert got[r.doc_id] == (list((r.text or "").encode())[-50:], max(0, start - max(0, n - 50)), n - max(start, n - 50))
