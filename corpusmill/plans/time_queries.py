"""Queries by time: latest earlier rows, overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import corpus, time_joins
from corpusmill.plans.corpus_queries import table
from corpusmill.plans.registry import query

#: Sessions end after so long without an event.
GAP_HOURS = 6


@query("""SELECT p.event_id, p.user_id, m.ts IS NOT NULL AS found, coalesce(m.id, -1) AS click_id, CAST(coalesce(epoch_us(p.ts) - epoch_us(m.ts), -1) AS BIGINT) AS micros
    FROM (SELECT p.event_id, max({'ts': c.ts, 'id': c.event_id}) AS m FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 DAY
          WHERE p.event_type = 'purchase' GROUP BY p.event_id) x JOIN events p USING (event_id)""".replace("max({'ts': c.ts, 'id': c.event_id}) AS m", "max({'ts': c.ts, 'id': c.event_id}) FILTER (c.ts IS NOT NULL) AS m"))
def clicks_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest click of the day before."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    found = time_joins.as_of_join(purchases, clicks, ["user_id"], "ts", "click_ts", ["click_id"], F.expr("INTERVAL 1 DAY"))
    return found.select("event_id", "user_id", F.col("click_ts").isNotNull().alias("found"), *(F.coalesce(c, F.lit(-1)).alias(n) for n, c in (("click_id", F.col("click_id")), ("micros", F.unix_micros("ts") - F.unix_micros("click_ts")))))


@query("""SELECT o.o_orderkey, o.o_custkey, coalesce(m.id, -1) AS previous_order, CAST(coalesce(date_diff('day', m.d, o.o_orderdate), -1) AS INTEGER) AS days_since, round(o.o_totalprice - m.price, 2) AS price_change
    FROM (SELECT o.o_orderkey, max({'d': p.o_orderdate, 'id': p.o_orderkey, 'price': p.o_totalprice}) FILTER (p.o_orderkey IS NOT NULL) AS m FROM orders o LEFT JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate GROUP BY o.o_orderkey) x
    JOIN orders o USING (o_orderkey)""")
def previous_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the customer's latest order of an earlier day."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    earlier = orders.select("o_custkey", F.col("o_orderdate").alias("previous_date"), F.col("o_orderkey").alias("previous_order"), F.col("o_totalprice").alias("previous_price"))
    found = time_joins.as_of_join(orders, earlier, ["o_custkey"], "o_orderdate", "previous_date", ["previous_order"], strict=True)
    return found.select("o_orderkey", "o_custkey", F.coalesce("previous_order", F.lit(-1)).alias("previous_order"), F.coalesce(F.datediff("o_orderdate", "previous_date"), F.lit(-1)).alias("days_since"), F.round(F.col("o_totalprice") - F.col("previous_price"), 2).alias("price_change"))


@query("""WITH spans AS (SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS first_day, CAST(epoch(max(l_shipdate)) / 86400 AS BIGINT) + 1 AS last_day FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT a.o_custkey, a.o_orderkey AS one, b.o_orderkey AS other, least(a.last_day, b.last_day) - greatest(a.first_day, b.first_day) AS days
    FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.first_day < b.last_day AND b.first_day < a.last_day AND a.first_day < a.last_day AND b.first_day < b.last_day""")
def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders that were open on the same days: from the order to its last shipment."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")
    spans = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("o_orderkey").alias("one"), day("o_orderdate").alias("begin"), (day("shipped") + 1).alias("end"))
    others = spans.select("o_custkey", F.col("one").alias("other"), F.col("begin").alias("other_begin"), F.col("end").alias("other_end"))
    pairs = time_joins.overlap_join(spans, others, ["o_custkey"], ("begin", "end"), ("other_begin", "other_end")).filter("one < other")
    return pairs.select("o_custkey", "one", "other", (F.least("end", "other_end") - F.greatest("begin", "other_begin")).alias("days"))


def sessions(events: DataFrame, kind: str, name: str) -> DataFrame:
    """(user_id, name, name_begin, name_end): a user's sessions of one kind of event, in microseconds; the first event's id names one."""
    own = events.filter(F.col("event_type") == kind).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    cut = own.groupBy("user_id", F.session_window("ts", f"{GAP_HOURS} hours").alias("w")).agg(F.min("event_id").alias(name))
    return cut.select("user_id", name, F.unix_micros("w.start").alias(f"{name}_begin"), F.unix_micros("w.end").alias(f"{name}_end"))


_GAP = GAP_HOURS * 3_600_000_000


@query(f"""WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events WHERE event_type IN ('view', 'click')),
    m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {_GAP} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM m),
    s AS (SELECT user_id, event_type, min(event_id) AS id, min(t) AS b, max(t) + {_GAP} AS e FROM n GROUP BY user_id, event_type, s)
    SELECT v.user_id, v.id AS views, c.id AS clicks, CAST(least(v.e, c.e) - greatest(v.b, c.b) AS BIGINT) AS micros FROM s v JOIN s c ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click' AND v.b < c.e AND c.b < v.e""")
def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's sessions of views and of clicks that share a moment."""
    events = table(spark, sf_dir, "events")
    pairs = time_joins.overlap_join(sessions(events, "view", "views"), sessions(events, "click", "clicks"), ["user_id"], ("views_begin", "views_end"), ("clicks_begin", "clicks_end"))
    return pairs.select("user_id", "views", "clicks", (F.least("views_end", "clicks_end") - F.greatest("views_begin", "clicks_begin")).alias("micros"))


@query("""SELECT d.doc_id, d.source, coalesce(max(e.doc_id), -1) AS previous FROM documents d LEFT JOIN documents e ON e.source = d.source AND e.doc_id < d.doc_id AND strlen(e.text) >= 2000 WHERE d.source IS NOT NULL GROUP BY d.doc_id, d.source""")
def previous_long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the last one of its source before it that has 2000 bytes or more; one source has a third of all rows."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    long = docs.filter(F.octet_length("text") >= 2000).select("source", F.col("doc_id").alias("previous"))
    found = time_joins.as_of_join(docs.select("doc_id", "source"), long, ["source"], "doc_id", "previous", strict=True)
    return found.select("doc_id", "source", F.coalesce("previous", F.lit(-1)).alias("previous"))


#: Windows over a source's stream, and how far one begins after the other.
WINDOW, STRIDE = 65_536, 49_152


@query(f"""WITH d AS (SELECT doc_id, source, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE source IS NOT NULL AND length(text) > 0),
    s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS e FROM d), z AS (SELECT source, max(e) AS size FROM s GROUP BY source),
    w AS (SELECT source, k AS win, k * {STRIDE} AS b FROM (SELECT source, unnest(range((size - 1) // {STRIDE} + 1)) AS k FROM z))
    SELECT w.source, w.win, s.doc_id, least(s.e, w.b + {WINDOW}) - greatest(s.e - s.n, w.b) AS shared FROM s JOIN w ON s.source = w.source AND s.e - s.n < w.b + {WINDOW} AND w.b < s.e""")
def documents_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents each of the overlapping windows over a source's stream of texts holds, and how many bytes of them."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND length(text) > 0").select("doc_id", "source", F.octet_length("text").cast("bigint").alias("n"))
    spans = corpus.prefix_sums(docs, "doc_id", "n", "begin", "source").withColumn("end", F.col("begin") + F.col("n"))
    last = F.max("end").alias("size")
    windows = spans.groupBy("source").agg(last).select("source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / STRIDE))).alias("win"))
    windows = windows.withColumns({"win_begin": F.col("win") * STRIDE, "win_end": F.col("win") * STRIDE + WINDOW})
    pairs = time_joins.overlap_join(spans, windows, ["source"], ("begin", "end"), ("win_begin", "win_end"))
    return pairs.select("source", "win", "doc_id", (F.least("end", "win_end") - F.greatest("begin", "win_begin")).alias("shared"))
