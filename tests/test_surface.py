"""Loads of workers, manifests with many writers, table functions."""

import random
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmill.functions import tables
from corpusmill.operators import balancing
from corpusmill.sources.manifest_log import Conflict, ManifestLog


@pytest.mark.parametrize("sizes", [[random.Random(1).randrange(1, 1000) for _ in range(3000)], [int(1e6 / (i + 1)) for i in range(2000)], [5] * 700, [10**6, *[1] * 500], [0] * 300, [7, 3]], ids=["even", "long tail", "ties", "one huge", "nothing", "few"])
def test_loads_are_alike(spark, sizes):
    items = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "i bigint, n bigint, other string").repartition(4)
    got = balancing.balanced(items, "i", "n", 7, head=14).collect()
    assert sorted((r.i, r.n) for r in got) == list(enumerate(sizes)) and {r.worker for r in got} <= set(range(7))
    loads = [sum(r.n for r in got if r.worker == w) for w in range(7)]
    tail = sorted(sizes, reverse=True)[14:]
    assert max(loads) - min(loads) <= max(2 * max(tail, default=0), max(sizes)) if max(sizes) * 7 > sum(sizes) or not tail else max(loads) - min(loads) <= 2 * max(tail)


def test_least_loaded_and_room():
    assert balancing.least_loaded([5, 4, 3, 3, 1], 2) == ([0, 1, 1, 0, 1], [8, 8])
    r = random.Random(2)
    for _ in range(300):
        loads, rest = [r.randrange(50) for _ in range(r.randrange(1, 9))], r.randrange(200)
        given = balancing.room(loads, rest)
        assert sum(given) >= rest and sum(max(0, g - 1) for g in given) <= rest
        filled = [a + b for a, b in zip(loads, given, strict=True)]
        levels = {f for f, g in zip(filled, given, strict=True) if g}  # one level, and nobody without a share is below it
        assert len(levels) <= 1 and all(f >= max(levels, default=0) for f in filled)


SCHEMA = "name string, n bigint, note string"


def table(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_versions_and_conflicts(spark, tmp_path):
    log = ManifestLog(spark, f"file://{tmp_path}/m", "name", SCHEMA)
    rows = lambda *x: spark.createDataFrame(x, SCHEMA)
    assert table(log.snapshot()) == [] and log.versions() == []
    assert log.commit(rows(("a", 1, "first"), ("b", 1, None)), 0) == 1
    other = ManifestLog(spark, f"file://{tmp_path}/m", "name", SCHEMA)
    assert other.commit(rows(("a", 2, "second")), 1) == 2
    with pytest.raises(Conflict):
        log.commit(rows(("a", 9, "lost")), 1)
    assert log.update(lambda seen: seen.filter("name = 'a'").withColumn("n", F.col("n") + 10)) == 3
    assert table(log.snapshot()) == [("a", 12, "second"), ("b", 1, None)]
    assert table(log.snapshot(1)) == [("a", 1, "first"), ("b", 1, None)] and table(log.snapshot(2))[0] == ("a", 2, "second")


def test_no_update_is_lost(spark, tmp_path):
    """Two writers that read the same version: one of them has to look again."""
    log, both, looked = ManifestLog(spark, f"file://{tmp_path}/m", "name", SCHEMA), Barrier(2), []
    log.commit(spark.createDataFrame([("a", 0, "")], SCHEMA), 0)

    def add(writer):
        def change(seen):
            looked.append(writer)
            if looked.count(writer) == 1:
                both.wait(60)
            return seen.withColumns({"n": F.col("n") + 1, "note": F.concat("note", F.lit(writer))})

        return log.update(change)

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(add, "xy")) == [2, 3]
    assert len(looked) == 3 and table(log.snapshot())[0][1] == 2 and sorted(table(log.snapshot())[0][2]) == ["x", "y"]


def test_chunks(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, "a  b c d e", 0.5), (2, "", 1.0), (3, None, 2.0), (4, "x", 3.0)], "i int, body string, w double")
    got = spark.sql("SELECT * FROM text_chunks(TABLE({docs}), 'body', 3, 1)", docs=docs)
    assert got.columns == ["i", "w", "chunk", "n_words", "words"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0.5, 0, 3, "a b c"), (1, 0.5, 1, 3, "c d e"), (4, 3.0, 0, 1, "x")]
    for bad in ("'nobody', 3, 1", "'body', 3, 3"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM text_chunks(TABLE({{docs}}), {bad})", docs=docs).collect()


def test_pairs(spark):
    tables.register(spark)
    turns = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c"), (2, 1, "assistant", "no"), (2, 2, "user", "q"), (2, 3, "user", "q2"), (2, 4, "assistant", None), (3, 1, "user", "alone")], "conv_id int, turn int, role string, text string")
    got = spark.sql("SELECT * FROM turn_pairs(TABLE({turns}) PARTITION BY conv_id ORDER BY turn)", turns=turns.repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1, "a", "b"), (2, 0, 3, "q2", None)]
