"""Queries over metric events and logs: runs, averages, significance, schedules, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import scalar, stats
from corpusmill.operators import evaluation, mixture, sampling
from corpusmill.plans.corpus_queries import table
from corpusmill.plans.registry import query
from corpusmill.sources import text
from corpusmill.streaming import streams


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: a file for each user, lines by event, a run begins at each "purchase"-like step 0."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), (F.col("event_id") % 7).cast("int").alias("step"), F.col("value").alias("val_loss"))


_STEPS = "s AS (SELECT user_id AS file, event_id AS line_no, CAST(event_id % 7 AS INTEGER) AS step, value AS val_loss FROM events)"
_RUNS = f"{_STEPS}, z AS (SELECT *, sum(CASE WHEN step = 0 THEN 1 ELSE 0 END) OVER w - first_value(CASE WHEN step = 0 THEN 1 ELSE 0 END) OVER w AS run FROM s WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query(f"WITH {_RUNS} SELECT file, line_no, step, CAST(run AS BIGINT) AS run FROM z")
def run_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.segment_runs(steps(spark, sf_dir)).select("file", "line_no", "step", "run")


@query(f"WITH {_STEPS} SELECT step, round(avg(val_loss), 6) AS loss, count(*) AS runs FROM s GROUP BY step")
def mean_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_runs(steps(spark, sf_dir), []).select("step", F.round("loss", 6).alias("loss"), "runs")


@query(f"WITH {_STEPS}, c AS (SELECT file % 5 AS result, step, avg(val_loss) AS loss, count(*) AS runs FROM s GROUP BY ALL) SELECT result, step, round(loss, 6) AS loss, runs FROM c WHERE step <= result + 1")
def curves_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).withColumn("result", F.col("file") % 5)
    results = rows.select("result").distinct().withColumn("steps_to_target", F.col("result") + 1)
    return evaluation.result_curves(results, rows).select("result", "step", F.round("loss", 6).alias("loss"), "runs")


@query(f"WITH {_STEPS} SELECT file, arg_max(val_loss, line_no) AS val_loss FROM s GROUP BY file")
def last_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.last_match(steps(spark, sf_dir))


@query("WITH n AS (SELECT count(DISTINCT user_id % 5) AS n FROM events) SELECT event_type, CAST(event_id % 7 AS INTEGER) AS step FROM events GROUP BY ALL HAVING count(DISTINCT user_id % 5) = (SELECT n FROM n)")
def cells_in_all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 7).cast("int").alias("step"), (F.col("user_id") % 5).alias("file"))
    return evaluation.common_cells(e, ["event_type", "step"])


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS moving,
    round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-9, 6) AS lifetime FROM events""")
def moving_and_lifetime_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.moving_means(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], ["event_id"], "value", 5)
    return rows.select("event_id", F.round(F.col("moving") + 1e-9, 6).alias("moving"), F.round(F.col("lifetime") + 1e-9, 6).alias("lifetime"))


@query("""SELECT event_id, stage, weight FROM events JOIN (VALUES (0, 30, 'warm', 0.1), (30, 100, 'main', 1.0), (100, 1000000, 'late', 0.5)) AS t(low, high, stage, weight) ON event_id % 150 >= low AND event_id % 150 < high""")
def stage_of_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = spark.createDataFrame([(0, 30, "warm", 0.1), (30, 100, "main", 1.0), (100, 1_000_000, "late", 0.5)], "low bigint, high bigint, stage string, weight double")
    points = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 150).alias("at"))
    return sampling.interval_lookup(points, stages, "at", "low", "high", 1_000).select("event_id", "stage", "weight")


@query("""SELECT event_id, round(CASE WHEN s < 50 THEN (s + 1) / 50.0 WHEN s >= 700 THEN 0.1 + 0.9 * greatest(1000 - s, 0) / 300.0 ELSE 1.0 END, 9) AS rate,
    round(0.5 * (1 + cos(pi() * least(s / 1000.0, 1))), 9) AS cosine, CASE WHEN s < 100 THEN 8.0 WHEN s < 400 THEN 16.0 ELSE 24.0 END AS batch, round(0.85 + 0.1 * least(s / 300.0, 1.0), 9) AS momentum
    FROM (SELECT event_id, event_id % 1000 AS s FROM events)""")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000).alias("s"))
    return rows.select("event_id", F.round(scalar.warmup_cooldown("s", 1000, 50, 300, 0.1), 9).alias("rate"), F.round(scalar.cosine_decay("s", 1000), 9).alias("cosine"), scalar.stage_value("s", [(100, 8.0), (400, 16.0), (1000, 24.0)]).alias("batch"), F.round(scalar.linear_ramp("s", 300, 0.85, 0.95), 9).alias("momentum"))


@query("SELECT event_type, count(*) AS n, max(CAST(event_id % 100 AS INTEGER)) AS last_step, round(avg(value), 6) AS mean_loss FROM events GROUP BY event_type")
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), (F.col("event_id") % 100).cast("int").alias("step"), F.col("value").alias("train_loss"))
    return streams.event_totals(rows).select(F.col("event").alias("event_type"), "n", "last_step", F.round("mean_loss", 6).alias("mean_loss"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.session_counts(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("""WITH t AS (SELECT n_chars + doc_id % 11 AS nats, source, strlen(text) AS bytes, n_chars FROM documents WHERE n_chars >= 2)
    SELECT source, round(sum(CAST(nats AS DOUBLE)) / ln(2) / sum(bytes), 9) AS bpb, round(exp(sum(CAST(nats AS DOUBLE)) / 100 / sum(n_chars)), 9) AS ppl FROM t GROUP BY source""")
def bits_per_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-averaged from given losses; a document's loss stands in for the model."""
    docs = table(spark, sf_dir, "documents").filter("n_chars >= 2")
    nats = (F.col("n_chars") + F.col("doc_id") % 11).cast("double")
    scored = docs.select("source", F.sequence(F.lit(1), F.lit(2)).alias("ids"), F.lit(0).alias("cont_start"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.array(nats).alias("nats"), "n_chars")
    out = evaluation.bits_per_byte(scored, ["source"]).select("source", "bpb")
    ppl = scored.groupBy("source").agg(scalar.perplexity(F.sum(F.col("nats")[0]) / 100 / F.sum("n_chars")).alias("ppl"))
    return out.join(ppl, "source").select("source", F.round("bpb", 9).alias("bpb"), F.round("ppl", 9).alias("ppl"))


@query("""WITH b AS (SELECT event_type, event_id // 64 AS batch, sum(value * (event_id % 3)) / greatest(sum(event_id % 3), 1) AS m FROM events GROUP BY ALL), s AS (SELECT event_type, avg(m) AS loss FROM b GROUP BY event_type)
    SELECT event_type AS source, round(loss, 6) AS loss, round((SELECT avg(loss) FROM s), 6) AS macro FROM s""")
def per_source_and_macro_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.floor(F.col("event_id") / 64).alias("batch"), F.col("value").alias("loss"), (F.col("event_id") % 3).cast("double").alias("weight"))
    by_source, macro = evaluation.macro_loss(rows)
    return by_source.join(F.broadcast(macro)).select("source", F.round("loss", 6).alias("loss"), F.round("macro", 6).alias("macro"))  # one row


@query("""WITH l AS (SELECT event_id // 4 AS task, event_id % 4 AS ending, value AS loss, 1 + event_id % 5 AS n FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY loss / n, ending) AS k FROM l)
    SELECT CAST(sum(CASE WHEN ending = task % 4 THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS tasks, round(avg(CASE WHEN ending = task % 4 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM r WHERE k = 1""")
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.floor(F.col("event_id") / 4).alias("task_id"), (F.col("event_id") % 4).alias("ending"), F.col("value").alias("loss"), (1 + F.col("event_id") % 5).alias("n_tokens"), F.pmod(F.floor(F.col("event_id") / 4), F.lit(4)).alias("label"))
    return evaluation.choice_accuracy(rows).select("correct", "tasks", F.round("accuracy", 9).alias("accuracy"))


@query("""WITH a AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY event_type)
    SELECT event_type, n, round(mean, 6) AS mean, round(std, 6) AS std, round(std / sqrt(n), 6) AS stderr, min, max, round((60 - mean) * sqrt(n), 4) AS statistic, (60 - mean) * sqrt(n) >= 0.004 AS passed,
    CASE WHEN 60 - mean > 0 THEN CAST(ceil(power(0.004 / (60 - mean), 2)) AS BIGINT) END AS needed FROM a""")
def precision_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.summarise(table(spark, sf_dir, "events"), ["event_type"], "value", 60.0)
    statistic, passed, needed = stats.precision_rule(F.col("mean"), F.col("n"), 60.0)
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("stderr", 6).alias("stderr"), "min", "max", F.round(statistic, 4).alias("statistic"), passed.alias("passed"), needed.alias("needed"))


@query("""WITH a AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY event_type)
    SELECT x.event_type AS a, y.event_type AS b, round((y.m - x.m + 25 * 0.0045 / 100) / sqrt(1.0 / x.n + 1.0 / y.n), 5) AS statistic, (y.m - x.m + 25 * 0.0045 / 100) / sqrt(1.0 / x.n + 1.0 / y.n) >= 0.004 AS better
    FROM a x JOIN a y ON x.event_type < y.event_type""")
def pairwise_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event against each later one: a few results, as in a table of results."""
    arms = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    x, y = arms.select(F.col("event_type").alias("a"), F.col("n").alias("n1"), F.col("m").alias("m1")), arms.select(F.col("event_type").alias("b"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    statistic, better = stats.pairwise_rule(F.col("m2") - F.col("m1"), F.lit(25), F.col("n1"), F.col("n2"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(statistic, 5).alias("statistic"), better.alias("better"))


def rounded(rows: DataFrame, **places: int) -> DataFrame:
    """Floating columns to 6 places, or to those that are named."""
    return rows.select(*(F.round(c, places.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


#: Simpson's rule over 20,000 pieces: weights of the points i = 0 .. 20000 of ``range(20001)``.
_WEIGHT = "CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def _lower_t(rows: str, keys: str) -> str:
    """CTEs that give P(T <= t) of ``rows`` (keys, t, df): with t = sqrt(df) tan(a) the density is a power of a cosine."""
    return f"""a AS (SELECT {keys}, t, df, atan(abs(t) / sqrt(df)) / 20000 AS h, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) AS c FROM {rows}),
    p AS (SELECT {keys}, round(0.5 + sign(t) * c * h / 3 * sum({_WEIGHT} * pow(cos(h * i), df - 1)), 8) AS p FROM a, range(20001) r(i) GROUP BY {keys}, t, c, h)"""


@query(f"""WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY event_type),
    o AS (SELECT *, std / sqrt(n) AS stderr, (mean - 50) / (std / sqrt(n)) AS t, n - 1 AS df FROM s), {_lower_t("o", "event_type")}
    SELECT event_type, n, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(stderr, 6) AS stderr, round(o.t, 6) AS t, df, p FROM o JOIN p USING (event_type)""")
def one_sample_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.one_sample_less(table(spark, sf_dir, "events"), ["event_type"], "value", 50.0), p=8)


@query(f"""WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS mean FROM events GROUP BY event_type), z AS (SELECT *, (mean - 50) / (30 / sqrt(n)) AS z FROM s),
    h AS (SELECT *, least(abs(z), 9) / 20000 AS h FROM z)
    SELECT event_type, n, round(mean, 6) AS mean, round(z, 6) AS z, round(0.5 + sign(z) * h / 3 * sum({_WEIGHT} * exp(-pow(h * i, 2) / 2)) / sqrt(2 * pi()), 8) AS p FROM h, range(20001) r(i) GROUP BY event_type, n, mean, z, h""")
def z_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.z_test_less(table(spark, sf_dir, "events"), ["event_type"], "value", 50.0, 30.0), p=8)


@query(f"""WITH s AS (SELECT count(value) FILTER (event_id % 2 = 0) AS n_a, avg(value) FILTER (event_id % 2 = 0) AS mean_a, var_samp(value) FILTER (event_id % 2 = 0) AS var_a,
        count(value) FILTER (event_id % 2 = 1) AS n_b, avg(value) FILTER (event_id % 2 = 1) AS mean_b, var_samp(value) FILTER (event_id % 2 = 1) AS var_b FROM events),
    o AS (SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t, pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df FROM s), {_lower_t("o", "n_a")}
    SELECT n_a, round(mean_a, 6) AS mean_a, round(var_a, 6) AS var_a, n_b, round(mean_b, 6) AS mean_b, round(var_b, 6) AS var_b, round(o.t, 6) AS t, round(df, 6) AS df, p FROM o JOIN p USING (n_a)""")
def welch_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.welch(table(spark, sf_dir, "events").withColumn("arm", F.col("event_id") % 2), "arm", "value", 0, 1), p=8)


@query("""WITH v AS (SELECT avg(value) AS v, row_number() OVER (ORDER BY user_id % 50) - 1 AS k FROM events GROUP BY user_id % 50), n AS (SELECT count(*) AS n FROM v),
    d AS (SELECT s AS sample, CAST(floor(CAST('0x' || substr(md5('0|' || CAST(s AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * n) AS BIGINT) AS k FROM range(1000) a(s), range(40) b(i), n),
    m AS (SELECT sample, avg(v) AS m FROM d JOIN v USING (k) GROUP BY sample)
    SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.005), 6) AS low, round(quantile_cont(m, 0.995), 6) AS high FROM m""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean over results' means, from 1000 resamples of 40."""
    means = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("result")).agg(F.avg("value").alias("m"))
    return rounded(stats.bootstrap_interval(sampling.bootstrap_means(means, "result", "m", 1000, 40)))


@query("""WITH e AS (SELECT CAST(event_id % 400 AS INTEGER) AS step, value * 1000 AS tps, value / 100 AS mfu FROM events) SELECT round(median(tps), 4) AS median_tokens_per_s, round(avg(tps), 4) AS mean_tokens_per_s, round(median(mfu), 6) AS median_mfu, round(avg(mfu), 6) AS mean_mfu FROM e WHERE step >= 5""")
def steady_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 400).cast("int").alias("step"), (F.col("value") * 1000).alias("tokens_per_s"), (F.col("value") / 100).alias("mfu"))
    out = evaluation.steady_state(rows)
    return out.select(*(F.round(c, 4 if "tokens" in c else 6).alias(c) for c in out.columns))


@query("""WITH l AS (SELECT event_id, user_id, 'step:' || CAST(event_id % 9 AS VARCHAR) || '/9 val_loss:' || printf('%.4f', abs(value)) || ' train_time:' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN 'ms' ELSE '.500s' END || ' step_avg:1.5ms' AS v FROM events WHERE event_type <> 'click')
    SELECT user_id AS file, event_id AS line_no, CAST(event_id % 9 AS INTEGER) AS step, 9 AS steps, CAST(printf('%.4f', abs(value)) AS DOUBLE) AS val_loss, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) ELSE event_id * 1000.0 + 500 END AS train_ms FROM l JOIN events USING (event_id, user_id)""")
def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of both forms made from events; clicks give lines that don't match."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("step:"), (F.col("event_id") % 9).cast("string"), F.lit("/9 val_loss:"), F.format_string("%.4f", F.abs("value")), F.lit(" train_time:"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "ms").otherwise(".500s"), F.lit(" step_avg:1.5ms"))
    lines = e.select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") != "click", line).otherwise(F.lit("loading ...")).alias("value"))
    return text.parse_log(lines)


@query("SELECT doc_id % 40 AS run_id, count(*) AS k FROM documents GROUP BY 1 HAVING doc_id % 40 NOT IN (SELECT DISTINCT doc_id % 40 FROM labels WHERE quality = 0)")
def runs_without_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 40).alias("run_id")).agg(F.count(F.lit(1)).alias("k"))
    results = table(spark, sf_dir, "labels").filter("quality = 0").select((F.col("doc_id") % 40).alias("run_id"))
    return mixture.pending_runs(runs, results)


@query("WITH r AS (SELECT DISTINCT doc_id % 40 AS id FROM documents), d AS (SELECT DISTINCT doc_id % 40 AS id FROM labels WHERE quality = 0) SELECT count(*) AS runs, count(d.id) AS done, count(*) - count(d.id) AS \"left\" FROM r LEFT JOIN d ON r.id = d.id")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("run_id")).distinct()
    return mixture.status(runs, table(spark, sf_dir, "labels").filter("quality = 0").select((F.col("doc_id") % 40).alias("run_id")))


@query("WITH k AS (SELECT lang AS run_id, count(DISTINCT source) AS k FROM documents GROUP BY lang) SELECT min(k) AS smallest, CAST(floor(median(k)) AS BIGINT) AS median, max(k) AS largest FROM k")
def design_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "documents").select(F.col("lang").alias("run_id"), "source").distinct().withColumn("w", F.lit(1.0))
    return mixture.support_summary(weights)


_DRAW = "CAST('0x' || substr(md5('0|{}|' || run_id{}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


@query(f"""WITH p AS (SELECT DISTINCT source AS pool, right(source, 1) AS grp FROM documents), n AS (SELECT count(*) AS n FROM p),
    r AS (SELECT 'uniform' AS run_id, 'uniform' AS kind UNION ALL SELECT DISTINCT 'group_' || grp, 'group' FROM p UNION ALL SELECT printf('mix_%04d', i), 'sparse' FROM range(64) t(i)),
    c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_DRAW.format("place", " || '|' || pool")}, pool) AS place, least(2, n) + floor({_DRAW.format("size", "")} * (n + 1 - least(2, n))) AS size,
        -ln(1 - {_DRAW.format("weight", " || '|' || pool")}) AS e FROM r, p, n),
    w AS (SELECT *, CASE kind WHEN 'uniform' THEN 1.0::DOUBLE WHEN 'group' THEN CAST(run_id = 'group_' || grp AS DOUBLE) ELSE CASE WHEN place <= size THEN e ELSE 0 END END AS part FROM c)
    SELECT run_id, kind, pool, round(part / total, 9) AS w FROM (SELECT *, sum(part) OVER (PARTITION BY run_id) AS total FROM w) WHERE part > 0""")
def sparse_mixture_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every run of a design over the corpus' sources."""
    pools = [r.source for r in table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").collect()]  # a dimension
    return rounded(mixture.sparse_designs(spark, pools, [p[-1] for p in pools], 64, 0), w=9)


@query(r"""WITH t AS (SELECT doc_id, '| ' || CAST(doc_id AS VARCHAR) || ' | 3250 | ' || source || ' | ' || lang || ' | 2026-01-01 | x | [`log` ' || source || '](a/' || lang || '.txt) |' AS line FROM documents)
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS number, source AS who, 'log ' || source AS evidence FROM t JOIN documents USING (doc_id)""")
def result_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("| %d | 3250 | %s | %s | 2026-01-01 | x | [`log` %s](a/%s.txt) |", "doc_id", "source", "lang", "source", "lang")
    rows = table(spark, sf_dir, "documents").select(F.lit("README").alias("file"), F.col("doc_id").alias("line_no"), line.alias("value"))
    cells = text.markdown_rows(rows)
    return cells.select(F.col("line_no").alias("doc_id"), F.col("cells")[0].alias("number"), F.col("cells")[2].alias("who"), scalar.evidence(F.col("cells")[6]).alias("evidence"))
