"""Stateful streams: joins in a bound of time with late rows, packing that is steered while it runs."""

import datetime as dt

from pyspark.sql import functions as F

from corpusmill.streaming import stateful

START = dt.datetime(2024, 5, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def test_join_drops_late_rows_and_forgets_old_ones(spark, tmp_path):
    a_schema, b_schema = "k bigint, i bigint, t timestamp", "k bigint, j bigint, u timestamp"
    a, b = stateful.file_stream(spark, f"file://{tmp_path}/a", a_schema), stateful.file_stream(spark, f"file://{tmp_path}/b", b_schema)
    met = stateful.joined_within(a, b, ["k"], ("t", "u"), "30 MINUTES", "10 minutes")
    run = lambda: stateful.run_lot(met, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    put(spark, [(1, 1, at(40)), (1, 2, at(100)), (None, 3, at(100))], a_schema, f"file://{tmp_path}/a")
    put(spark, [(1, 1, at(10)), (1, 2, at(40)), (1, 3, at(41)), (1, 4, at(9)), (2, 5, at(100)), (None, 6, at(100))], b_schema, f"file://{tmp_path}/b")
    first = run()
    assert sum(x["dropped"] for x in first) == 0 and first[-1]["state"] < first[0]["state"]  # the watermark is 90
    put(spark, [(1, 7, at(89)), (1, 8, at(95))], a_schema, f"file://{tmp_path}/a")
    put(spark, [(1, 7, at(70)), (1, 8, at(94))], b_schema, f"file://{tmp_path}/b")
    assert sum(x["dropped"] for x in run()) == 2
    got = sorted((x.i, x.j) for x in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [(1, 1), (1, 2), (2, 8), (8, 8)]
    table = stateful.joined_within(spark.createDataFrame([(1, 1, at(40))], a_schema), spark.createDataFrame([(1, 1, at(10)), (1, 2, at(9))], b_schema), ["k"], ("t", "u"), "30 MINUTES", "0 seconds")
    assert [(x.k, x.i, x.j) for x in table.collect()] == [(1, 1, 1)]


def test_orders_hold_from_the_next_batch_on(spark, tmp_path):
    tokens_schema, order_schema = "stream string, position bigint, ids array<int>", "stream string, position bigint, length int"
    tokens, orders = stateful.file_stream(spark, f"file://{tmp_path}/t", tokens_schema), stateful.file_stream(spark, f"file://{tmp_path}/o", order_schema)
    expected, held, length = {"a": [], "b": []}, {"a": [], "b": []}, {"a": 3, "b": 3}
    for lot in range(4):
        rows = [(s, lot * 100 + i, [lot * 1000 + i * 10 + x for x in range((i + lot) % 4)]) for s in "ab" for i in range(9)] + [("a", lot * 100 + 50, None)]
        put(spark, rows[::-1], tokens_schema, f"file://{tmp_path}/t")
        sent = {1: [("a", 1, 9), ("a", 2, 5)], 2: [("b", 1, 1), ("new", 1, 2)]}.get(lot, [])
        if sent:
            put(spark, sent, order_schema, f"file://{tmp_path}/o")
        stateful.run_lot(stateful.steered_packing(tokens, orders, 3), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")  # a restart each time
        for s in "ab":
            held[s] += [x for name, _, ids in sorted(rows[:18]) if name == s for x in ids]
            while len(held[s]) > length[s]:
                n = length[s]
                expected[s].append((held[s][:n], held[s][1 : n + 1]))
                held[s] = held[s][n:]
        for s, _, n in sorted(sent):
            length[s] = n
    got = {"a": [], "b": []}
    for x in spark.read.parquet(f"file://{tmp_path}/out").orderBy("stream", "step").collect():
        assert x.step == len(got[x.stream])
        got[x.stream].append((x.inputs, x.targets))
    assert got == expected


def test_late_means_behind_the_slower_stream(spark, tmp_path):
    schema = "k bigint, i bigint, t timestamp"
    a, b = stateful.file_stream(spark, f"file://{tmp_path}/a", schema), stateful.file_stream(spark, f"file://{tmp_path}/b", schema)
    met = stateful.joined_within(a, b.select("k", F.col("i").alias("j"), F.col("t").alias("u")), ["k"], ("t", "u"), "5 MINUTES", "1 minute")
    for lot, (left, right) in enumerate([([(1, 1, at(500))], [(1, 1, at(10))]), ([(1, 2, at(12))], [(1, 2, at(11))])]):
        put(spark, left, schema, f"file://{tmp_path}/a")
        put(spark, right, schema, f"file://{tmp_path}/b")
        assert sum(x["dropped"] for x in stateful.run_lot(met, f"file://{tmp_path}/out", f"file://{tmp_path}/c")) == 0, lot
    assert [(x.i, x.j) for x in spark.read.parquet(f"file://{tmp_path}/out").orderBy("j").collect()] == [(2, 1), (2, 2)]
