"""Queries that run as streams: the table arrives in lots, some rows late, and each lot is taken to its end by a run that goes on from the checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import corpus
from corpusmill.plans.corpus_queries import SHARD, table
from corpusmill.plans.registry import query
from corpusmill.sources import tokbin
from corpusmill.sources.scratch import new_folder
from corpusmill.streaming import stateful, streams

LOTS, LATE = 4, "12 hours"
_EVENT = "event_id bigint, user_id bigint, event_type string, ts timestamp"


def lot_of(ts: Column, event_id: Column) -> Column:
    """Eight days a lot; an event in twenty comes two lots late, another one lot late."""
    own = F.floor((F.dayofmonth(ts) - 1) / 8)
    return F.least(own + F.when(event_id % 20 == 0, 2).when(event_id % 20 == 1, 1).otherwise(0), F.lit(LOTS - 1))


#: SQL: events with their lot, and for each lot the time up to which rows are late (in microseconds; Spark's watermarks are whole milliseconds): of
#: all events, and of the slower of clicks and purchases.
_LOTS = f"""e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, least((day(ts) - 1) // 8 + CASE event_id % 20 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, {LOTS - 1}) AS lot FROM events),
    l AS (SELECT unnest(range({LOTS + 1})) AS lot),
    m AS (SELECT l.lot, max(t) // 1000 * 1000 AS seen, least(max(t) FILTER (event_type = 'click'), max(t) FILTER (event_type = 'purchase')) // 1000 * 1000 AS slower FROM l LEFT JOIN e ON e.lot < l.lot GROUP BY l.lot),
    w AS (SELECT lot, coalesce(seen - 43200000000, 0) AS seen, coalesce(slower - 43200000000, 0) AS slower FROM m)"""


def _matching(spark: SparkSession, sf_dir: str) -> tuple[str, list[tuple[int, int, int]]]:
    """Runs the join over all lots; the folder of its results, and (lot, rows, dropped)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = new_folder(spark, "matches")
    stream = stateful.file_stream(spark, f"{path}/in", _EVENT)
    purchases = stream.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("bought"))
    clicks = stream.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("clicked"))
    met = stateful.joined_within(purchases, clicks, ["user_id"], ("bought", "clicked"), "1 DAY", LATE)
    found = []
    for lot in range(LOTS):
        events.filter(lot_of(F.col("ts"), F.col("event_id")) == lot).write.mode("append").parquet(f"{path}/in")
        done = stateful.run_lot(met, f"{path}/out", f"{path}/checkpoint")
        found.append((lot, sum(x["rows"] for x in done) // 2, sum(x["dropped"] for x in done)))  # both sides read the files
    return f"{path}/out", found


@query(f"""WITH {_LOTS}, k AS (SELECT e.* FROM e JOIN w USING (lot) WHERE t > w.slower)
    SELECT p.user_id, p.event_id AS purchase, c.event_id AS click, p.t - c.t AS micros FROM k p JOIN k c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click' AND c.t <= p.t AND c.t >= p.t - 86400000000""")
def streamed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and the user's clicks of the day before, joined as two streams; late rows are dropped."""
    out, _ = _matching(spark, sf_dir)
    return spark.read.parquet(out).select("user_id", "purchase", "click", (F.unix_micros("bought") - F.unix_micros("clicked")).alias("micros"))


@query(f"""WITH {_LOTS} SELECT lot, count(*) AS n, count(*) FILTER (event_type IN ('click', 'purchase') AND t <= slower) AS dropped FROM e JOIN w USING (lot) GROUP BY lot""")
def streamed_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each lot of the streamed join had, and how many of them came too late, by the query's own count."""
    return spark.createDataFrame(_matching(spark, sf_dir)[1], "lot bigint, n bigint, dropped bigint")


_DAY = 86_400_000_000


@query(f"""WITH {_LOTS}, k AS (SELECT event_type, t // {_DAY} * {_DAY} AS start FROM e JOIN w USING (lot) WHERE t // {_DAY} * {_DAY} + {_DAY} > w.seen)
    SELECT start, event_type, count(*) AS n FROM k WHERE start + {_DAY} <= (SELECT seen FROM w WHERE lot = {LOTS}) GROUP BY start, event_type""")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind as a stream: a day is given out when no row of it can come any more, and rows of days given out are dropped."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = new_folder(spark, "windows")
    counts = streams.windowed_counts(stateful.file_stream(spark, f"{path}/in", _EVENT), "ts", "event_type", "1 day", late=LATE)
    for lot in range(LOTS):
        events.filter(lot_of(F.col("ts"), F.col("event_id")) == lot).write.mode("append").parquet(f"{path}/in")
        stateful.run_lot(counts, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select(F.unix_micros("start").alias("start"), "event_type", "n")


#: Lengths of a window before and after the order.
SHORT, LONG = 48, 80


@query(f"""WITH e AS (SELECT event_type AS stream, event_id, floor((day(ts) - 1) / 11) AS lot, event_id % 7 + 1 AS n FROM events),
    t AS (SELECT stream, lot, event_id, unnest(range(n)) AS x FROM e),
    p AS (SELECT stream, lot, (event_id * 7 + x) % 50257 AS id, row_number() OVER (PARTITION BY stream ORDER BY lot, event_id, x) - 1 AS place FROM t),
    s AS (SELECT stream, count(*) AS n, count(*) FILTER (lot < 2) AS early FROM p GROUP BY stream),
    k AS (SELECT *, greatest(0, (early - 1) // {SHORT}) AS short FROM s),
    z AS (SELECT *, short + CASE WHEN n > early THEN greatest(0, (n - short * {SHORT} - 1) // {LONG}) ELSE 0 END AS steps FROM k),
    a AS (SELECT p.stream, id, place, steps, CASE WHEN place < short * {SHORT} THEN place // {SHORT} ELSE short + (place - short * {SHORT}) // {LONG} END AS step FROM p JOIN z USING (stream))
    SELECT stream, step, count(*) AS n, CAST(sum(id) AS BIGINT) AS inputs, CAST(arg_min(id, place) AS BIGINT) AS first, CAST(arg_max(id, place) AS BIGINT) AS last FROM a WHERE step < steps GROUP BY stream, step""")
def steered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens made from events, packed as streams by kind; with the second of three lots comes an order for longer windows, which holds from the third on."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("stream"), F.floor((F.dayofmonth("ts") - 1) / 11).alias("lot"))
    ids = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 7).cast("int")), lambda x: ((F.col("event_id") * 7 + x) % 50257).cast("int"))
    tokens = events.select("stream", "lot", F.col("event_id").alias("position"), ids.alias("ids"))
    path = new_folder(spark, "steered")
    arriving = stateful.file_stream(spark, f"{path}/tokens", "stream string, position bigint, ids array<int>")
    orders = stateful.file_stream(spark, f"{path}/orders", "stream string, position bigint, length int")
    packed = stateful.steered_packing(arriving, orders, SHORT)
    for lot in range(3):
        tokens.filter(F.col("lot") == lot).drop("lot").write.mode("append").parquet(f"{path}/tokens")
        if lot == 1:
            tokens.select("stream").distinct().select("stream", F.lit(0).cast("bigint").alias("position"), F.lit(LONG).alias("length")).write.mode("append").parquet(f"{path}/orders")
        stateful.run_lot(packed, f"{path}/out", f"{path}/checkpoint")
    found = spark.read.parquet(f"{path}/out")
    total = F.aggregate("inputs", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.select("stream", "step", F.size("inputs").cast("bigint").alias("n"), total.alias("inputs"), F.get("inputs", F.lit(0)).cast("bigint").alias("first"), F.element_at("inputs", -1).cast("bigint").alias("last"))


@query(f"""WITH d AS (SELECT doc_id, doc_id % 2 AS lot, text, CAST(strlen(text) + 1 AS BIGINT) AS n FROM documents WHERE length(text) > 0),
    b AS (SELECT lot, coalesce(sum(n) OVER (PARTITION BY lot ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, hex(encode(text)) AS h FROM d),
    k AS (SELECT lot, start AS place, 50256 AS token FROM b UNION ALL SELECT lot, start + 1 + i, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FROM (SELECT lot, start, h, unnest(range(0, strlen(h) // 2)) AS i FROM b))
    SELECT 'lot' || CAST(lot AS VARCHAR) AS lot, CAST(place // {SHARD} AS BIGINT) AS shard, count(*) AS n, CAST(sum(token) AS BIGINT) AS tokens, CAST(sum(token * (place % {SHARD} % 1009)) AS BIGINT) AS placed FROM k GROUP BY ALL""")
def streamed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards read as a stream: those of odd documents are added after the first run, and the second reads only these."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", "text")
    path = new_folder(spark, "arriving")
    for lot in (0, 1):
        own = docs.filter(F.col("doc_id") % 2 == lot)
        tokbin.write_shards(corpus.byte_pieces(own, SHARD), f"{path}/in", prefix=f"lot{lot}", tokens=corpus.byte_ids)
        stateful.run_lot(tokbin.stream_shards(spark, f"{path}/in", layout="chunks"), f"{path}/out", f"{path}/checkpoint")
    rows = spark.read.parquet(f"{path}/out").select("shard", "position", F.posexplode("tokens").alias("i", "token"))
    token, at = F.col("token").cast("bigint"), F.col("position") + F.col("i")
    sums = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(token).alias("tokens"), F.sum(token * (at % 1009)).alias("placed"))
    lot, number = F.regexp_extract("shard", "(lot[0-9]+)_", 1), F.regexp_extract("shard", "_([0-9]+)[.]bin", 1).cast("bigint")
    return sums.select(lot.alias("lot"), number.alias("shard"), "n", "tokens", "placed")  # a file is a shard; its name is parsed once
