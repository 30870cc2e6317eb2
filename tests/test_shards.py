"""Token shards: filters that reach the files, streams that read each token once."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from corpusmill.sources import tokbin
from corpusmill.streaming import stateful


def put(folder, name, tokens):
    folder.mkdir(exist_ok=True)
    (folder / f"_{name}").write_bytes(tokbin.encode_shard(np.asarray(tokens)))
    (folder / f"_{name}").rename(folder / f"{name}.bin")


@pytest.fixture
def shards(tmp_path):
    for i in range(3):
        put(tmp_path / "s", f"x{i}", np.arange(i * 1000, i * 1000 + 900))
    put(tmp_path / "s", "x3", [])
    return str(tmp_path / "s")


def ranges(path, *filters, **options):
    reader = tokbin.FilteredReader({"path": path, "chunkTokens": "100", "rangeTokens": "300"} | options)
    assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them to the rows once more
    return [(r.path[-6:-4], r.begin, r.end) for r in reader.partitions()]


def test_filters_choose_files_and_ranges(shards):
    position, shard = ("position",), ("shard",)
    assert ranges(shards)[:4] == [("x0", 0, 300), ("x0", 300, 600), ("x0", 600, 900), ("x1", 0, 300)]
    assert ranges(shards, EqualTo(shard, f"{shards}/x1.bin"), GreaterThan(position, 649), LessThanOrEqual(position, 650)) == [("x1", 600, 651)]
    assert ranges(shards, LessThanOrEqual(position, 150), In(shard, (f"{shards}/x0.bin", "no")), layout="chunks") == [("x0", 0, 200)]
    assert ranges(shards, EqualTo(shard, "none")) == [("", 0, 0)]
    assert ranges(shards, EqualTo(position, -5)) == [("x3", 0, 0)]


def test_filtered_reads_give_the_same_rows(spark, shards):
    for layout in ("tokens", "chunks"):
        rows = tokbin.read_shards(spark, shards, layout=layout)
        every = rows.collect()
        for condition, keep in [("position >= 300 AND position < 420", lambda r: 300 <= r.position < 420), (f"shard = '{shards}/x2.bin' AND position > 5", lambda r: r.shard.endswith("x2.bin") and r.position > 5), ("position = 0", lambda r: r.position == 0), ("position <= 1000 OR shard = 'no'", lambda r: True)]:
            assert sorted(map(tuple, rows.filter(condition).collect()), key=str) == sorted((tuple(r) for r in every if keep(r)), key=str)
        assert rows.count() == len(every)  # nothing of the filters stays
        both = rows.filter("position < 100").unionByName(rows.filter("position >= 800")).unionByName(rows)
        assert both.count() == len(every) + sum(r.position < 100 or r.position >= 800 for r in every)
    assert tokbin.read_shards(spark, shards).filter("position >= 890").rdd.getNumPartitions() <= 4


def test_a_stream_reads_each_shard_once(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "b", np.arange(250))
    stream = tokbin.stream_shards(spark, str(folder))
    run = lambda: stateful.run_lot(stream.select("shard", "position", F.col("token").alias("t")), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    read = lambda: sorted((r.shard[-5], r.position, r.t) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert sum(x["rows"] for x in run()) == 250
    put(folder, "a", np.arange(40) + 7)  # before the first by name
    put(folder, "c", [])
    assert sum(x["rows"] for x in run()) == 40
    assert sum(x["rows"] for x in run()) == 0
    assert read() == [("a", i, i + 7) for i in range(40)] + [("b", i, i) for i in range(250)]


def test_batches_are_bounded(tmp_path):
    put(tmp_path / "s", "a", np.arange(250))
    put(tmp_path / "s", "b", np.arange(120))
    stream, offsets = tokbin.TokenStream({"path": str(tmp_path / "s"), "chunkTokens": "100", "tokensPerBatch": "200"}), []
    start = stream.initialOffset()
    while (end := stream.latestOffset()) != start:
        offsets.append([(r.path[-5], r.begin, r.end) for r in stream.partitions(start, end)])
        start = end
    assert offsets == [[("a", 0, 200)], [("a", 200, 250), ("b", 0, 120)]]
    again = tokbin.TokenStream({"path": str(tmp_path / "s"), "chunkTokens": "100", "tokensPerBatch": "200"})  # from a checkpoint: all that has come
    assert {k[-5]: n for k, n in again.latestOffset().items()} == {"a": 250, "b": 120}
