"""Queries that write files and read them back, and queries over loaders, images, spans and forms of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import images, scalar
from corpusmill.operators import answers, corpus, evaluation, mixture, packing
from corpusmill.plans.corpus_queries import _SIZES, _STREAM, SHARD, shard_sizes, table
from corpusmill.plans.dialogue_queries import _CONV, conversations
from corpusmill.plans.registry import query
from corpusmill.sources import scratch, sinks, text, tokbin
from corpusmill.streaming import streams


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.length("text") > 0)


# -- texts -----------------------------------------------------------------------------------------------


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE length(text) > 0 AND doc_id % 5 > 1 GROUP BY 1")
def jsonl_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of JSON lines, written compressed and read back; two of five lines are spoilt."""
    return text.read_jsonl(spark, _spoilt_lines(spark, sf_dir), "body")[0].groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'not JSON' ELSE 'no text' END AS reason, count(*) AS n FROM documents WHERE doc_id % 5 < 2 OR length(coalesce(text, '')) = 0 GROUP BY 1""")
def jsonl_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_jsonl(spark, _spoilt_lines(spark, sf_dir), "body")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _spoilt_lines(spark: SparkSession, sf_dir: str) -> str:
    path = scratch.new_folder(spark, "jsonl")
    kind = F.col("doc_id") % 5
    line = F.when(kind == 0, F.concat(F.lit("no JSON "), F.col("doc_id"))).when(kind == 1, F.lit('{"other": 1}')).when(kind == 2, F.to_json(F.struct(F.col("text").alias("body")))).otherwise(F.to_json(F.struct("text")))
    table(spark, sf_dir, "documents").select(line.alias("value")).write.option("compression", "gzip").text(path)
    return path


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE lang = 'de' AND length(text) > 0 GROUP BY 1")
def parquet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first string column of Parquet files, filtered by a nested field."""
    path = scratch.new_folder(spark, "parquet")
    table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.struct("lang", "source").alias("meta")).write.parquet(path)
    return text.read_parquet_texts(spark, path, "text", "meta.lang", "de").groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) > 0 ORDER BY doc_id LIMIT 150) SELECT md5(text) AS text_md5, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(doc_id % 7 AS INTEGER) END AS "begin", count(*) AS n FROM d GROUP BY ALL""")
def perplexity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 documents of a span file; the rest isn't scored (the reader's own limit)."""
    path = scratch.new_folder(spark, "spans")
    begin = (F.col("doc_id") % 7).cast("int")
    spans = F.when(F.col("doc_id") % 3 != 0, F.array(F.array(begin, begin + 5)))
    lines = table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")  # files in the order of ids
    lines.select(F.to_json(F.struct("text", spans.alias("spans"))).alias("value")).write.text(path)
    return text.read_spans(spark, path, 150).groupBy(F.md5("text").alias("text_md5"), "begin").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) AS image, substr(text, 1, 40) AS question, lang AS answer FROM documents WHERE length(text) > 0)
    SELECT image, md5(question) AS question, answer, row_number() OVER (ORDER BY md5('5|' || image || '|' || question || '|' || answer)) - 1 AS place FROM p""")
def local_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a local folder in their seeded order."""
    path = scratch.new_folder(spark, "pairs")
    rows = texts(spark, sf_dir).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("image"), F.substring("text", 1, 40).alias("question"), F.col("lang").alias("answer"))
    sinks.write_jsonl(rows, f"{path}/train.jsonl")
    found = text.read_pairs(spark, path, "train", 5).withColumn("key", F.conv(F.substring("place", 1, 15), 16, 10).cast("bigint"))
    return corpus.numbered(found, "key", "n", then=("place",)).select("image", F.md5("question").alias("question"), "answer", F.col("n").alias("place"))


@query("SELECT DISTINCT lang AS name, 'sets/' || lang || '_span_ppl.jsonl' AS path FROM documents")
def set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.format_string("sets/%s_span_ppl.jsonl", "lang").alias("path")).distinct()
    return rows.select(text.set_name(F.col("path")).alias("name"), "path")


@query("""WITH w AS (SELECT 'val_000000.bin' AS name UNION ALL SELECT 'train_' || lpad(CAST(i AS VARCHAR), 6, '0') || '.bin' FROM range(1, 104) AS t(i))
    SELECT name FROM w WHERE name NOT IN (SELECT 'train_' || lpad(CAST(doc_id % 90 AS VARCHAR), 6, '0') || '.bin' FROM documents)""")
def shards_left_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "documents").select(F.format_string("train_%06d.bin", F.col("doc_id") % 90).alias("name"))
    return text.shards_to_fetch(spark, 103, present)


@query("SELECT DISTINCT source || '_' || lang AS folder FROM documents WHERE source LIKE 'src1%'")
def listed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.format_string("data/%s_%s/%d.jsonl", "source", "lang", "doc_id").alias("path")).union(docs.select(F.format_string("other/%s/%d", "source", "doc_id")))
    return text.folders_with_prefix(files, "src1")


@query("SELECT source, count(DISTINCT lang) AS folders FROM documents GROUP BY source")
def cached_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a listing that is kept as a table and read from it the second time."""
    path = scratch.new_folder(spark, "listed")
    table(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("v")).write.partitionBy("source", "lang").text(f"{path}/files")
    text.cached_listing(spark, f"{path}/files", f"{path}/listing", "*.txt")
    again = text.cached_listing(spark, f"{path}/nowhere", f"{path}/listing", "*.txt")
    parts = F.split("path", "/")
    named = again.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), F.element_at(parts, -2).alias("folder")).distinct()
    return named.groupBy("source").agg(F.count(F.lit(1)).alias("folders"))


# -- token shards ----------------------------------------------------------------------------------------

_TOKENS = f"""{_STREAM}, b AS (SELECT s.doc_id, s.start, hex(encode(t.text)) AS h FROM s JOIN documents t ON s.doc_id = t.doc_id),
    k AS (SELECT start AS place, 50256 AS token FROM b UNION ALL SELECT start + 1 + i, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FROM (SELECT start, h, unnest(range(0, strlen(h) // 2)) AS i FROM b))"""


def _written_shards(spark: SparkSession, sf_dir: str, bits: int) -> str:
    path = scratch.new_folder(spark, "shards")
    tokbin.write_shards(corpus.byte_pieces(texts(spark, sf_dir), SHARD), path, bits, tokens=corpus.byte_ids)
    return path


def _sums(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    rows = tokbin.read_shards(spark, _written_shards(spark, sf_dir, bits), bits)
    token, at = F.col("token").cast("bigint"), F.col("position")
    sums = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(token).alias("tokens"), F.sum(token * (at % 1009)).alias("placed"))
    return sums.withColumn("shard", F.regexp_extract("shard", "shard_([0-9]+)", 1).cast("bigint"))  # a file is a shard


_SUMS = f"WITH {_TOKENS} SELECT place // {SHARD} AS shard, count(*) AS n, CAST(sum(token) AS BIGINT) AS tokens, CAST(sum(token * (place % {SHARD} % 1009)) AS BIGINT) AS placed FROM k GROUP BY 1"


@query(_SUMS)
def shards_of_16_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards, written and read back token by token."""
    return _sums(spark, sf_dir, 16)


@query(_SUMS)
def shards_of_32_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir, 32)


@query(f"WITH {_TOKENS} SELECT place // {SHARD} AS shard, place % {SHARD} AS position, token FROM k WHERE place % {SHARD} BETWEEN 6000 AND 6007")
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few tokens from the middle of each shard; the filter leaves out all other ranges before they are read."""
    rows = tokbin.read_shards(spark, _written_shards(spark, sf_dir, 16)).filter("position >= 6000 AND position < 6008")
    return rows.select(F.regexp_extract("shard", "shard_([0-9]+)", 1).cast("bigint").alias("shard"), "position", F.col("token").cast("bigint").alias("token"))


@query(f"WITH {_SIZES} SELECT 'shard_' || lpad(CAST(shard AS VARCHAR), 6, '0') || '.bin' AS name, 16 AS bits, n_tokens AS tokens FROM z")
def shard_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from the shards' headers alone, files in order."""
    files = tokbin.list_shards(_written_shards(spark, sf_dir, 16))
    counted = tokbin.count_tokens(spark, spark.createDataFrame([(f,) for f in files], "path string"))
    return counted.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bits", "tokens")


@query("""WITH d AS (SELECT doc_id, source, CAST(strlen(text) + 1 AS BIGINT) AS n FROM documents WHERE length(text) > 0),
    b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM d),
    m AS (SELECT source, sum(n) AS t FROM b WHERE spent < 30000 GROUP BY source)
    SELECT source AS pool, i AS shard, CAST(least(t - i * 8192, 8192) AS BIGINT) AS tokens, t >= 30000 AS done FROM (SELECT *, unnest(range(0, CAST(ceil(t / 8192.0) AS BIGINT))) AS i FROM m)""")
def built_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools, tokenised, capped, cut into shards and written; what the files and the manifest say."""
    docs = corpus.byte_tokenise(texts(spark, sf_dir).select("doc_id", F.col("source").alias("pool"), "text")).select("pool", "doc_id", "ids")
    path = scratch.new_folder(spark, "pools")
    manifest = tokbin.build_pools(docs, path, 30_000, 8_192)
    files = text.list_files(spark, path, "*.bin").select("path")
    found = tokbin.count_tokens(spark, files.select(F.regexp_replace("path", "^file:/+", "/").alias("path")))
    named = found.select(F.regexp_extract("path", "/([^/]+)/shard_", 1).alias("pool"), F.regexp_extract("path", "shard_([0-9]+)", 1).cast("bigint").alias("shard"), "tokens")
    return named.join(manifest.select(F.col("name").alias("pool"), "done"), "pool")


@query("""WITH d AS (SELECT CAST(doc_id % 6 AS INTEGER) AS shard, CAST(sum(strlen(text)) AS BIGINT) AS n FROM documents WHERE length(text) > 0 GROUP BY 1),
    b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
    t AS (SELECT shard, least(n, 150000 - before) AS take FROM b WHERE before < 150000)
    SELECT shard, CAST(i * 2048 AS BIGINT) AS "begin", CAST(least(2048, take - i * 2048) AS BIGINT) AS length FROM (SELECT *, unnest(range(0, CAST(ceil(take / 2048.0) AS BIGINT))) AS i FROM t)""")
def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 2048 tokens from token shards, for the text part of a mixture."""
    sizes = texts(spark, sf_dir).groupBy((F.col("doc_id") % 6).cast("int").alias("shard")).agg(F.sum(F.octet_length("text")).cast("bigint").alias("n_tokens"))
    return packing.stream_documents(sizes, 150_000, 2_048).select("shard", "begin", F.col("length").cast("bigint").alias("length"))


# -- loaders ---------------------------------------------------------------------------------------------


@query(f"""WITH {_SIZES}, r AS (SELECT shard, n_tokens AS n, rank FROM z, range(0, 3) AS t(rank)),
    c AS (SELECT shard, rank, j, rank * 700 + j * 2100 AS p FROM (SELECT *, unnest(range(0, n // 2100 + 1)) AS j FROM r) WHERE j = 0 OR rank * 700 + j * 2100 + 2101 <= n),
    o AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY shard, j) - 1 AS n, count(*) OVER (PARTITION BY rank) AS lap FROM c),
    g AS (SELECT s AS step, rank FROM range(0, 400) AS t(s), range(0, 3) AS u(rank))
    SELECT g.step, CAST(g.rank AS INTEGER) AS rank, o.shard, CAST(o.p AS BIGINT) AS "begin" FROM g JOIN o ON g.rank = o.rank AND g.step % o.lap = o.n""")
def rank_cursor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rank's own cursor over all shards, again and again."""
    return packing.rank_cyclic_windows(shard_sizes(spark, sf_dir), 400, 700, 3).select("step", "rank", "shard", F.col("begin").cast("bigint").alias("begin"))


@query("""WITH d AS (SELECT lang AS stream, CAST(sum(strlen(text)) AS BIGINT) AS n FROM documents WHERE length(text) > 0 GROUP BY lang),
    c AS (SELECT stream, rank, rank * 512 + k * 2048 AS p, k, count(*) OVER (PARTITION BY stream, rank) AS lap FROM (SELECT stream, n, rank, unnest(range(0, n // 2048 + 1)) AS k FROM d, range(0, 4) AS t(rank)) WHERE rank * 512 + k * 2048 + 513 <= n)
    SELECT stream, s AS step, CAST(rank AS INTEGER) AS rank, CAST(p AS BIGINT) AS "begin" FROM c, range(0, 200) AS t(s) WHERE s % lap = k""")
def rank_stride_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = texts(spark, sf_dir).groupBy(F.col("lang").alias("stream")).agg(F.sum(F.octet_length("text")).cast("bigint").alias("n_tokens"))
    return packing.rank_stride_windows(sizes, 200, 512, 4).select("stream", "step", "rank", F.col("begin").cast("bigint").alias("begin"))


@query("""WITH s AS (SELECT source AS pool, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS shard, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0),
    c AS (SELECT pool, shard, unnest(range(0, (n - 1) // 1500)) AS j FROM s WHERE n > 1500), o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY shard, j) - 1 AS at, count(*) OVER (PARTITION BY pool) AS lap FROM c),
    k AS (SELECT event_id AS step, 'src' || CAST(user_id % 23 AS VARCHAR) AS pool, row_number() OVER (PARTITION BY user_id % 23 ORDER BY event_id) - 1 AS k FROM events),
    z AS (SELECT pool, count(*) AS shards FROM s GROUP BY pool)
    SELECT k.step, k.pool, coalesce(o.shard, (2 * (k.k + 1)) % z.shards) AS shard, CAST(coalesce(o.j * 1500, 0) AS BIGINT) AS "begin", l.lap IS NULL AS tiled
    FROM k JOIN z ON k.pool = z.pool LEFT JOIN (SELECT DISTINCT pool, lap FROM o) l ON k.pool = l.pool LEFT JOIN o ON k.pool = o.pool AND k.k % l.lap = o.at""")
def pool_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block each draw of a pool reads at the pool's cursor; each document is a shard here."""
    shards = corpus.numbered(texts(spark, sf_dir).select("doc_id", F.col("source").alias("pool"), F.octet_length("text").cast("bigint").alias("n_tokens")), "doc_id", "shard", "pool")
    draws = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.concat(F.lit("src"), (F.col("user_id") % 23).cast("string")).alias("pool"))
    draws = corpus.numbered(draws, "step", "k", "pool")
    return packing.pool_blocks(draws, shards.drop("doc_id"), 1_500).select("step", "pool", "shard", F.col("begin").cast("bigint").alias("begin"), "tiled")


@query("WITH t AS (SELECT DISTINCT CAST(floor(value * 10) AS INTEGER) AS s FROM events) SELECT DISTINCT s + o AS step FROM t, (VALUES (-2), (-1), (0), (1)) AS x(o) WHERE s + o >= 2 UNION SELECT * FROM (VALUES (0), (1)) AS y(step)")
def warm_up_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    transitions = table(spark, sf_dir, "events").select(F.floor(F.col("value") * 10).cast("int").alias("step"))
    return evaluation.warm_up_steps(transitions.distinct())


# -- sinks -----------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_folder(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars")), path)
    return spark.read.schema("source string, docs bigint, chars bigint").option("header", True).csv(path)


@query("SELECT source, lang AS split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def pushed_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a folder for each source and split, read back."""
    path = scratch.new_folder(spark, "pushed")
    sinks.push_partitioned(table(spark, sf_dir, "documents").withColumnRenamed("lang", "split"), path)
    return spark.read.parquet(path).groupBy(F.col("source").cast("string").alias("source"), F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT lang AS grp, source, CASE WHEN source < 'src5' THEN 9.5 ELSE CAST(count(*) AS DOUBLE) END AS size FROM documents GROUP BY lang, source""")
def mixture_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture's JSON file: groups of the sources that have rows, with their sizes."""
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy(F.concat_ws("/", "lang", "source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    spec = docs.select("lang", F.col("source").alias("s")).distinct()
    spec = spec.select(F.col("lang").alias("grp"), F.lit(0.25).alias("grp_weight"), F.col("s").alias("name"), F.concat_ws("/", "lang", "s").alias("source"), F.when(F.col("s") < "src5", 9.5).alias("size"), F.lit(1.0).alias("message_weight"))
    nothing = spec.limit(1).withColumn("source", F.lit("not there"))
    path = scratch.new_folder(spark, "mixture")
    sinks.mixture_json(spec.unionByName(nothing), counts, "sqrt").write.text(path)
    kind = "loss_token_weighting string, groups map<string, struct<weight: double, datasets: array<struct<name: string, source: string, size: double, message_weight: double>>>>"
    rows = spark.read.text(path).select(F.from_json("value", kind).alias("x")).select(F.explode("x.groups").alias("grp", "g")).select("grp", F.explode("g.datasets").alias("d"))
    return rows.select("grp", F.col("d.name").alias("source"), "d.size")


@query("SELECT source || '/' || lang AS name, count(*) AS n, 50257 AS vocab FROM documents GROUP BY ALL")
def metadata_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_folder(spark, "meta")
    sinks.metadata_json(table(spark, sf_dir, "documents").withColumnRenamed("lang", "split"), "source", 50_257).write.text(path)
    rows = spark.read.text(path).select(F.from_json("value", "counts map<string, bigint>, vocab int").alias("x"))
    return rows.select(F.explode("x.counts").alias("name", "n"), "x.vocab")


@query("SELECT event_type AS event, count(*) AS n, CAST(max(event_id) AS INTEGER) AS last_step, round(avg(value), 6) AS mean_loss FROM events GROUP BY event_type")
def streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in two lots, ingested by two runs of a stream; the second goes on after the first."""
    path = scratch.new_folder(spark, "metrics")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("event_id").cast("int").alias("step"), F.col("value").alias("train_loss"))
    for lot in (0, 1):
        sinks.write_jsonl(rows.filter(F.col("step") % 2 == lot), f"{path}/in")
        streams.ingest(streams.metric_events(spark, f"{path}/in"), f"{path}/out", f"{path}/checkpoint")
    return streams.event_totals(spark.read.parquet(f"{path}/out")).withColumn("mean_loss", F.round("mean_loss", 6))


@query("""WITH w AS (SELECT source AS run_id, lang, CAST(count(*) AS DOUBLE) / 8 AS w FROM documents GROUP BY ALL), m AS (SELECT source AS run_id, CAST(sum(n_chars) AS DOUBLE) / count(*) AS bpb FROM documents GROUP BY source)
    SELECT m.run_id, round(bpb, 6) AS bpb, round(coalesce(sum(w) FILTER (lang = 'en'), 0), 5) AS w_a, round(coalesce(sum(w) FILTER (lang = 'de' OR lang = 'fr'), 0), 5) AS w_b, round(coalesce(sum(w) FILTER (lang = 'es'), 0), 5) AS "w_?" FROM m LEFT JOIN w ON m.run_id = w.run_id GROUP BY ALL""")
def collected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, a JSON file each, with the weights of groups; a pool that nobody knows is in the group "?"."""
    docs = table(spark, sf_dir, "documents")
    weights = docs.groupBy(F.col("source").alias("run_id"), F.col("lang").alias("pool")).agg((F.count(F.lit(1)).cast("double") / 8).alias("w"))
    runs = mixture.runs_with_weights(docs.groupBy(F.col("source").alias("run_id")).agg((F.sum("n_chars").cast("double") / F.count(F.lit(1))).alias("bpb")), weights)
    path = scratch.new_folder(spark, "results")
    runs.withColumn("file", F.col("run_id")).repartition("file").write.partitionBy("file").json(path)
    read = text.read_results(spark, path, "run_id string, bpb double, weights map<string, double>")
    pools = spark.createDataFrame([("en", "a"), ("de", "b"), ("fr", "b")], "pool string, grp string")
    return mixture.collect_results(read, pools, ["bpb"], ["a", "b", "?"]).withColumn("bpb", F.round("bpb", 6))


@query("""WITH r AS (SELECT DISTINCT source AS run_id FROM documents), w AS (SELECT source AS run_id, lang AS pool, CAST(count(*) AS DOUBLE) AS w FROM documents WHERE source < 'src5' GROUP BY ALL)
    SELECT r.run_id, count(pool) AS pools, coalesce(sum(w), 0) AS total FROM r LEFT JOIN w ON r.run_id = w.run_id GROUP BY r.run_id""")
def run_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each run; a run without any has an empty map."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("lang").alias("pool"))
    weights = docs.filter("run_id < 'src5'").groupBy("run_id", "pool").agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = mixture.runs_with_weights(docs.select("run_id").distinct(), weights)
    return rows.select("run_id", F.size("weights").cast("bigint").alias("pools"), F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""SELECT lang AS file, CAST(doc_id AS INTEGER) AS step, CAST(n_chars AS DOUBLE) / 4 AS val_loss, CAST(doc_id * 3 AS DOUBLE) * CASE WHEN doc_id % 2 = 0 THEN 1000 ELSE 1 END AS train_ms FROM documents WHERE doc_id % 3 < 2""")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses from log files, one for each language, among other lines."""
    unit = F.when(F.col("doc_id") % 2 == 0, "s").otherwise("ms")
    line = F.concat(F.lit("step:"), F.col("doc_id"), F.lit("/9 val_loss:"), (F.col("n_chars") / 4).cast("decimal(20,2)"), F.lit(" train_time:"), F.col("doc_id") * 3, unit, F.lit(" step_avg:1.5ms"))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("file"), F.when(F.col("doc_id") % 3 < 2, line).otherwise(F.lit("step:1/9 train_loss:2")).alias("value"))
    path = scratch.new_folder(spark, "logs")
    rows.repartition("file").write.partitionBy("file").text(path)
    found = text.parse_log(text.read_log_lines(spark, path))
    return found.select(F.regexp_extract("file", "file=([^/]+)", 1).alias("file"), "step", "val_loss", "train_ms")


# -- forms of answers ------------------------------------------------------------------------------------

_VALIDATION = f"""WITH {_CONV}, f AS (SELECT 'conv' || CAST(conv_id % 3 AS VARCHAR) AS source, len(texts) AS turns, strlen(texts[1]) AS first, CAST(len(texts) AS INTEGER) AS n_subsegments, 0.5 AS w FROM c),
    s AS (SELECT source, 2 AS turns, strlen(lang) AS first, 1 AS n_subsegments, 1.0 AS w FROM documents)
    SELECT source, count(*) AS n, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(first) AS BIGINT) AS first_bytes, CAST(sum(n_subsegments) AS BIGINT) AS subsegments, CAST(sum(w) AS DOUBLE) AS weight FROM (SELECT * FROM f UNION ALL SELECT * FROM s) GROUP BY source"""


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = conversations(spark, sf_dir).select(F.concat(F.lit("conv"), (F.col("conv_id") % 3).cast("string")).alias("source"), F.lit("val").alias("split"), F.array(F.lit("a.png")).alias("images"), F.array("texts").alias("convos"), F.size("texts").alias("n_subsegments"), F.lit(0.5).alias("message_weight"), F.lit("chat").alias("style"))
    simple = table(spark, sf_dir, "documents").select("source", F.lit("val").alias("split"), F.lit("b.png").alias("image"), F.col("lang").alias("q"), F.col("source").alias("a"))
    return answers.unify_validation(full, simple)


def _validation_sums(rows: DataFrame) -> DataFrame:
    turns = F.flatten("convos")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(turns)).alias("turns"), F.sum(F.octet_length(F.get(turns, F.lit(0)))).cast("bigint").alias("first_bytes"), F.sum("n_subsegments").alias("subsegments"), F.sum(F.col("message_weight").cast("double")).alias("weight"))


@query(_VALIDATION)
def unified_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and pairs in one form, parsed back."""
    return _validation_sums(answers.parse_validation(_validation(spark, sf_dir)))


@query(_VALIDATION)
def exported_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through JSON files in a folder for each source."""
    path = scratch.new_folder(spark, "validation")
    sinks.export_validation(_validation(spark, sf_dir), path)
    return _validation_sums(sinks.import_validation(spark, path))


@query("""WITH l AS (SELECT 'cosyn' || CAST(doc_id % 4 AS VARCHAR) AS source, doc_id, 0 AS pair, lang AS q, source AS a FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'cosyn' || CAST(doc_id % 4 AS VARCHAR), doc_id, 1, source, lang FROM documents WHERE doc_id % 3 = 0),
    s AS (SELECT source, doc_id, 0 AS pair, lang AS q, 'beta' AS a FROM documents WHERE doc_id % 3 <> 0), u AS (SELECT * FROM l UNION ALL SELECT * FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pair) AS k FROM u WHERE doc_id % 5 <> 0)
    SELECT source, doc_id, CAST(pair AS INTEGER) AS pair, CASE WHEN source LIKE 'cosyn%' THEN q ELSE q || chr(10) || 'Options: alpha; beta' END AS q, a FROM k WHERE k <= 40""")
def ingested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows with an image, by the source's form, the first 40 of each source (the operator's cap)."""
    listed = F.col("doc_id") % 3 == 0
    pairs = F.array(F.struct(F.col("lang").alias("question"), F.col("source").alias("answer")), F.struct(F.col("source").alias("question"), F.col("lang").alias("answer")), F.struct(F.lit(" ").alias("question"), F.lit("x").alias("answer")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(listed, F.concat(F.lit("cosyn"), (F.col("doc_id") % 4).cast("string"))).otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 5 != 0, F.lit("x.png")).alias("image"), F.when(listed, pairs).alias("qa_pairs"), F.col("lang").alias("question"), F.when(~listed, F.lit("B")).alias("answer"), F.array(F.lit("alpha"), F.lit("beta")).alias("choices"))
    return answers.ingest_source(rows, "doc_id", 40).select("source", "doc_id", "pair", "q", "a")


@query(f"""WITH {_CONV}, k AS (SELECT conv_id, conv_id % 4 AS source, len(texts) AS turns, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id) AS k FROM c WHERE len(texts) >= 2 AND conv_id % 7 <> 0)
    SELECT conv_id, source, CAST(2 * turns AS BIGINT) AS turns, CAST(2 AS BIGINT) AS conversations FROM k WHERE k <= 30""")
def formatted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that an outside formatter makes, usable ones only, 30 of each source (the operator's cap), flattened."""

    def formatter(row: dict) -> list[list[str]] | None:
        if row["conv_id"] % 7 == 0:
            raise ValueError("spoilt")
        return [row["texts"], row["texts"]]

    rows = conversations(spark, sf_dir).withColumn("source", F.col("conv_id") % 4)
    made = answers.ingest_formatted(rows, formatter, 30, "conv_id")
    turns, n = answers.flattened(F.col("convos"))
    return made.select("conv_id", "source", F.size(turns).cast("bigint").alias("turns"), n.cast("bigint").alias("conversations"))


@query("SELECT DISTINCT source || '_' || lang AS name, lang AS topic FROM documents")
def listed_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools that documents name, each with its topic; a name must not have two topics."""
    docs = table(spark, sf_dir, "documents")
    return corpus.distinct_pools(docs.select(F.concat("source", F.lit("_"), "lang").alias("name"), F.col("lang").alias("topic")))


@query("SELECT doc_id, source FROM documents WHERE lang IN (SELECT lang FROM documents WHERE doc_id < 40 AND doc_id % 2 = 0)")
def rows_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.filter("doc_id < 40 and doc_id % 2 = 0").select(F.col("lang").alias("path"))
    return answers.existing_images(docs.select("doc_id", "source", F.col("lang").alias("image")), files).select("doc_id", "source")


@query("""SELECT conv_id, turn, CAST(strlen(text) + length(role) + 4 AS BIGINT) AS n, CAST(list_sum([ascii(x) - 96 FOR x IN string_split(role, '')]) AS BIGINT) AS inside, CAST(500 AS BIGINT) AS marks FROM conversations""")
def marked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of texts with a marked span, in which each letter has an id of its own."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<a>"), "role", F.lit("</a>"), "text", F.lit(" <end>")).alias("text"))
    letters = {chr(97 + i): 100_001 + i for i in range(26)}
    coded = corpus.encode_marked(rows, {"<a>": 200, "</a>": 201, "<end>": 300_099}, "<a>", "</a>", letters, lambda t: [list(x.encode()) for x in t])
    inside = F.aggregate(F.filter("ids", lambda t: (t > 100_000) & (t < 200_000)), F.lit(0).cast("bigint"), lambda a, t: a + t - 100_000)
    marks = F.get("ids", F.lit(0)) + F.element_at("ids", -1) - 300_099 + 300
    return coded.select("conv_id", "turn", F.size("ids").cast("bigint").alias("n"), inside.alias("inside"), marks.cast("bigint").alias("marks"))


# -- spans, metrics, images ------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, strlen(text) AS n, strlen(substr(text, 1, CAST(doc_id % 900 AS INTEGER))) AS b FROM documents WHERE length(text) > 0),
    s AS (SELECT *, greatest(0, least(b, n - 1)) AS start, greatest(0, n - 1024) AS cut FROM d)
    SELECT doc_id, CAST(n - cut AS BIGINT) AS n, CAST(greatest(0, start - cut) AS BIGINT) AS cont_start, CAST(n - greatest(start, cut) AS BIGINT) AS n_bytes FROM s""")
def prepared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as token positions, cut from the left, and the bytes of what is scored."""
    begin = (F.col("doc_id") % 900).cast("int")
    rows = texts(spark, sf_dir).select("doc_id", "text", F.array(F.array(begin, begin + 9)).alias("spans"))
    out = evaluation.prepare_spans(rows, lambda t: [list(x.encode()) for x in t], len, 1_024)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.col("cont_start").cast("bigint").alias("cont_start"), "n_bytes")


@query("""WITH m AS (SELECT source, lang, sum(n_chars) / 100.0 / ln(2) / greatest(sum(CASE WHEN source = 'src3' THEN 0 ELSE n_chars END), 1) AS bpb, exp(sum(n_chars) / 100.0 / sum(n_chars)) AS ppl FROM documents WHERE n_chars > 0 GROUP BY ALL)
    SELECT source, round(max(bpb) FILTER (lang = 'en'), 6) AS en_bpb, round(max(ppl) FILTER (lang = 'en'), 6) AS en_ppl, round(max(bpb) FILTER (lang = 'de'), 6) AS de_bpb, round(max(ppl) FILTER (lang = 'de'), 6) AS de_ppl FROM m GROUP BY source""")
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per byte and perplexity of each set as columns; a source without bytes counts one."""
    docs = table(spark, sf_dir, "documents").filter("n_chars > 0")
    nats = F.array_repeat(F.lit(0.01), F.col("n_chars").cast("int"))
    rows = docs.select("source", F.col("lang").alias("set"), F.array(F.lit(1), F.lit(2)).alias("ids"), F.lit(0).alias("cont_start"), F.when(F.col("source") == "src3", F.lit(0)).otherwise(F.col("n_chars")).cast("bigint").alias("n_bytes"), nats.alias("nats"))
    wide = evaluation.set_columns(evaluation.bits_per_byte(rows, ["source", "set"]), ["en", "de"], "source")
    return wide.select("source", *(F.round(c, 6).alias(c) for c in ("en_bpb", "en_ppl", "de_bpb", "de_ppl")))


@query("""WITH d AS (SELECT doc_id, CAST(n_chars % 3000 + 1 AS INTEGER) AS h, CAST(doc_id % 2000 + 1 AS INTEGER) AS w FROM documents),
    t AS (SELECT i, j FROM range(1, 9) AS a(i), range(1, 9) AS b(j) WHERE i * j <= 8), s AS (SELECT doc_id, i, j, least(i * 266 / h, j * 266 / w) AS s FROM d, t),
    r AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS best FROM s)
    SELECT doc_id, CAST(arg_min(i, o) AS INTEGER) AS rows, CAST(arg_min(j, o) AS INTEGER) AS cols FROM (SELECT doc_id, i, j, struct_pack(a := CASE WHEN best >= 1 THEN CASE WHEN s >= 1 THEN s ELSE 1e9 END ELSE -s END, b := i * j, c := i) AS o FROM r) GROUP BY doc_id""")
def tiling_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 3000 + 1).cast("int").alias("height"), (F.col("doc_id") % 2000 + 1).cast("int").alias("width"))
    return images.choose_tiling(sizes, 8, 266, "doc_id")


@query("""WITH n AS (SELECT n_nationkey AS k, 200 + 23 * n_nationkey AS h, 700 - 17 * n_nationkey AS w FROM nation), t AS (SELECT i, j FROM range(1, 5) AS a(i), range(1, 5) AS b(j) WHERE i * j <= 4),
    s AS (SELECT k, i, j, least(i * 266 / greatest(h - 112, 1), j * 266 / greatest(w - 112, 1)) AS s FROM n, t), r AS (SELECT *, max(s) OVER (PARTITION BY k) AS best FROM s),
    c AS (SELECT k, arg_min(i, o) AS i, arg_min(j, o) AS j FROM (SELECT k, i, j, struct_pack(a := CASE WHEN best >= 1 THEN CASE WHEN s >= 1 THEN s ELSE 1e9 END ELSE -s END, b := i * j, c := i) AS o FROM r) GROUP BY k)
    SELECT CAST(k AS INTEGER) AS n_nationkey, CAST(i * j + 1 AS INTEGER) AS crops, CAST(14 * 14 + ((i * 19 + 9) // 2) * ((j * 19 + 9) // 2) AS BIGINT) AS cells, CAST(14 * 15 + 2 + ((i * 19 + 9) // 2) * ((j * 19 + 9) // 2 + 1) + 2 AS BIGINT) AS ids,
           CAST(729 + (i * 19 + 8) * (j * 19 + 8) AS BIGINT) AS patches FROM c""")
def image_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops, token ids and pooled cells of an image for each nation."""
    key = F.col("n_nationkey")
    made = table(spark, sf_dir, "nation").select("n_nationkey", (200 + 23 * key).cast("int").alias("height"), (700 - 17 * key).cast("int").alias("width"))
    pixels = F.unhex(F.repeat(F.lit("7f00ff"), (F.col("height") * F.col("width")).cast("int")))
    out = images.preprocess(made.withColumn("data", pixels).repartition(8), 4, "n_nationkey")
    seen = F.size(F.filter(F.flatten("pooled"), lambda x: x >= 0))
    return out.select("n_nationkey", "crops", F.size("pooled").cast("bigint").alias("cells"), F.size("ids").cast("bigint").alias("ids"), seen.cast("bigint").alias("patches"))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), p AS (SELECT k, y, x, c, (k * 31 + y * 13 + x * 7 + c * 29 + (x * y) % 11) % 256 AS v FROM s, range(28) AS a(y), range(56) AS b(x), range(3) AS d(c)),
    w AS (SELECT k, y // 14 * 4 + x // 14 AS patch, sum(v) AS total FROM p GROUP BY ALL),
    h AS (SELECT k, y // 28 * 2 + x // 28 AS patch, sum(v) / 4.0 AS half FROM p GROUP BY ALL)
    SELECT w.k AS s_suppkey, CAST(w.patch AS INTEGER) AS patch, CAST(total AS BIGINT) AS total, coalesce(CAST(half AS DOUBLE), -1) AS half FROM w LEFT JOIN h ON w.k = h.k AND w.patch = h.patch""")
def decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files, one for each supplier, each pixel of its own: written, decoded, cut into patches, and resized to half."""
    key = F.col("image_id")
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"))
    value = lambda i: F.pmod(key * 31 + F.floor(i / 168) * 13 + F.floor(i % 168 / 3) * 7 + i % 3 * 29 + (F.floor(i % 168 / 3) * F.floor(i / 168)) % 11, F.lit(256))
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(28 * 56 * 3 - 1)), lambda i: F.lpad(F.hex(value(i)), 2, "0")), ""))
    path = scratch.new_folder(spark, "images")
    images.write_images(made.withColumns({"height": F.lit(28), "width": F.lit(56), "data": pixels}).repartition(8), path)
    found = images.patch_sums(images.read_images(spark, path))
    return found.select(F.regexp_extract("image_id", "([0-9]+)[.]bmp", 1).cast("bigint").alias("s_suppkey"), "patch", "total", F.coalesce("half", F.lit(-1.0)).alias("half"))


@query("SELECT max(lang) AS lang, true AS found FROM documents")
def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the folders that languages are written to, one after the other, the one with the newest file."""
    path = scratch.new_folder(spark, "newest")
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select("lang", "doc_id")
    for r in docs.select("lang").distinct().orderBy("lang").collect():  # a few languages
        docs.filter(F.col("lang") == r.lang).select(F.col("doc_id").cast("string")).write.text(f"{path}/lang={r.lang}")
    last = text.newest(text.list_files(spark, path, "*.txt"))
    return last.select(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"), F.col("path").isNotNull().alias("found"))


@query("SELECT event_type AS event, count(*) AS n, CAST(max(event_id) AS INTEGER) AS last_step, round(avg(value), 6) AS mean_loss FROM events GROUP BY event_type")
def appended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric events of a stream that are appended as JSON lines while it runs, in two lots."""
    path = scratch.new_folder(spark, "sink")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("event_id").cast("int").alias("step"), F.col("value").alias("train_loss"))
    for lot in (0, 1):
        sinks.write_jsonl(rows.filter(F.col("step") % 2 == lot), f"{path}/in")
        streams.append_metrics(streams.metric_events(spark, f"{path}/in"), f"{path}/out", f"{path}/checkpoint")
    return streams.event_totals(spark.read.schema(streams.METRICS).json(f"{path}/out")).withColumn("mean_loss", F.round("mean_loss", 6))


@query("""SELECT event_id, coalesce(round(CASE WHEN event_id % 5 > 0 THEN value * 1000 / (event_id % 5) END, 6), -1) AS tokens_per_s, coalesce(round(CASE WHEN event_id % 5 > 0 THEN value * 1000 / (event_id % 5) * 6e8 / 9.89e14 END, 12), -1) AS mfu FROM events""")
def throughputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a second and utilisation of each event; none without time."""
    rows = table(spark, sf_dir, "events").select("event_id", scalar.throughput(F.col("value") * 1000, F.col("event_id") % 5).alias("t"))
    return rows.select("event_id", F.coalesce(F.round("t", 6), F.lit(-1.0)).alias("tokens_per_s"), F.coalesce(F.round(scalar.utilisation("t", 6e8, 9.89e14), 12), F.lit(-1.0)).alias("mfu"))


@query("""WITH n AS (SELECT n_nationkey AS k, 200 + 23 * n_nationkey AS h, 700 - 17 * n_nationkey AS w FROM nation), l AS (SELECT unnest([4, 2]) AS most), t AS (SELECT most, i, j FROM range(1, 5) AS a(i), range(1, 5) AS b(j), l WHERE i * j <= most),
    s AS (SELECT k, most, i, j, least(i * 266 / greatest(h - 112, 1), j * 266 / greatest(w - 112, 1)) AS s FROM n, t), r AS (SELECT *, max(s) OVER (PARTITION BY k, most) AS best FROM s),
    c AS (SELECT k, most, arg_min(i, o) AS i, arg_min(j, o) AS j FROM (SELECT k, most, i, j, struct_pack(a := CASE WHEN best >= 1 THEN CASE WHEN s >= 1 THEN s ELSE 1e9 END ELSE -s END, b := i * j, c := i) AS o FROM r) GROUP BY k, most),
    z AS (SELECT k, most, i * j + 1 AS crops, 14 * 14 + ((i * 19 + 9) // 2) * ((j * 19 + 9) // 2) AS cells, 14 * 15 + 2 + ((i * 19 + 9) // 2) * ((j * 19 + 9) // 2 + 1) + 2 AS ids FROM c),
    a AS (SELECT n_nationkey AS row_id, unnest(CASE n_nationkey % 3 WHEN 0 THEN [n_nationkey] WHEN 1 THEN [n_nationkey, (n_nationkey + 7) % 25] ELSE [] END) AS image, n_nationkey % 3 AS several FROM nation),
    b AS (SELECT row_id, sum(crops) AS crops, sum(cells) AS cells, sum(ids) + 10 * (count(*) - 1) AS ids FROM a JOIN z ON z.k = a.image AND z.most = CASE WHEN several = 1 THEN 2 ELSE 4 END GROUP BY row_id)
    SELECT n_nationkey AS row_id, CAST(coalesce(crops, 0) AS INTEGER) AS crops, CAST(coalesce(cells, 0) AS BIGINT) AS cells, CAST(coalesce(ids, 0) AS BIGINT) AS ids FROM nation LEFT JOIN b ON b.row_id = n_nationkey""")
def rows_of_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with no, one and two images: those of a row with two are cut into two crops at most, a single one into four."""
    key = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").repartition(8)
    made = nations.select(key.alias("image"), (200 + 23 * key).cast("int").alias("height"), (700 - 17 * key).cast("int").alias("width"))
    made = made.withColumn("data", F.unhex(F.repeat(F.lit("7f00ff"), (F.col("height") * F.col("width")).cast("int"))))
    listed = F.when(key % 3 == 0, F.array(key)).when(key % 3 == 1, F.array(key, (key + 7) % 25)).otherwise(F.array().cast("array<bigint>"))
    out = images.row_segments(nations.select(key.alias("row_id"), listed.alias("images")), made, lambda t: list(t.encode()), 729, 4, 2, key="row_id")
    return out.select("row_id", "crops", F.size("pooled").cast("bigint").alias("cells"), F.size("image_ids").cast("bigint").alias("ids"))


@query("""WITH d AS (SELECT doc_id // 10 AS batch, doc_id, n_chars % 97 AS n FROM documents), s AS (SELECT batch, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY batch)
    SELECT batch, n + (16 - n % 16) % 16 AS n, docs + 1 + CASE WHEN n % 16 > 0 THEN 1 ELSE 0 END AS offsets, CAST(50256 * ((16 - n % 16) % 16) AS BIGINT) AS filler FROM s""")
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten examples in a packed row, filled up to a multiple of 16."""
    n = (F.col("n_chars") % 97).cast("int")
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("batch"), F.col("doc_id").alias("id"), F.array_repeat(F.lit(0), n).alias("inputs"), F.array_repeat(F.lit(1), n).alias("targets"), F.array_repeat(F.lit(0.5).cast("double"), n).alias("weights"))
    out = packing.collate(rows)
    return out.select("batch", F.size("inputs").cast("bigint").alias("n"), F.size("offsets").cast("bigint").alias("offsets"), F.aggregate("inputs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("filler"))


@query("""WITH d AS (SELECT doc_id // 10 AS batch, doc_id, CAST(n_chars % 9 AS BIGINT) AS l, CAST(n_chars % 9 + doc_id % 2 AS BIGINT) AS r FROM documents),
    c AS (SELECT *, CASE WHEN l < r THEN l // 2 + l % 2 ELSE 5 END AS crops FROM d), o AS (SELECT *, coalesce(sum(crops) OVER (PARTITION BY batch ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 AS shift FROM c)
    SELECT batch, CAST(sum(crops) AS BIGINT) AS crops, CAST(sum(l) AS BIGINT) AS cells, CAST(sum(4 * l * (l - 1) / 2 + l * shift) AS BIGINT) AS first FROM o GROUP BY batch""")
def collated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows with images: pooled cells and crops of the place holders that are left, counted through the batch."""
    left = (F.col("n_chars") % 9).cast("int")
    cells = left + (F.col("doc_id") % 2).cast("int")
    pooled = F.when(cells > 0, F.transform(F.sequence(F.lit(0), cells - 1), lambda i: F.array((i * 4).cast("bigint"), F.lit(-1).cast("bigint")))).otherwise(F.array().cast("array<array<bigint>>"))
    ids = F.concat(F.array_repeat(F.lit(packing.PATCH_ID), left), F.array(F.lit(7)))
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("batch"), F.col("doc_id").alias("id"), ids.alias("inputs"), ids.alias("targets"), F.array_repeat(F.lit(0.0), left + 1).alias("weights"), F.lit(5).alias("crops"), pooled.alias("pooled"))
    out = packing.collate_images(rows, 8)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("batch", total("crops").alias("crops"), F.size("pooled").cast("bigint").alias("cells"), total(F.transform("pooled", lambda x: x[0])).alias("first"))


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0), t AS (SELECT doc_id, h, unnest(range(0, strlen(h) // 2)) AS i FROM d), v AS (SELECT doc_id, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS cur FROM t),
    l AS (SELECT *, lag(cur) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM v), b AS (SELECT DISTINCT doc_id, CASE WHEN prev IS NULL THEN 4095 ELSE xor(36313 * cur, 27191 * prev) % 4095 END AS bucket FROM l)
    SELECT doc_id AS step, count(*) AS buckets, CAST(sum(bucket) AS BIGINT) AS bucket_sum FROM b GROUP BY doc_id""")
def touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct bigram buckets of each step; a document is a step here."""
    ids = corpus.byte_tokenise(texts(spark, sf_dir).select("doc_id", "text"), start=False).select(F.col("doc_id").alias("step"), F.col("ids").alias("inputs"))
    return packing.bigram_ids_touched(ids, 4_096).groupBy("step").agg(F.count(F.lit(1)).alias("buckets"), F.sum("bucket").cast("bigint").alias("bucket_sum"))


@query("SELECT lang, CAST(max(CAST(source AS VARCHAR)) AS VARCHAR) AS latest, count(*) AS n FROM documents GROUP BY lang")
def latest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of names that are compared as strings."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.max("source").alias("latest"), F.count(F.lit(1)).alias("n"))


@query()
def library_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents tokenised by a public vocabulary (checked against the library in the tests)."""
    out = corpus.tokenise(texts(spark, sf_dir).select("doc_id", "text"), vocabulary())
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def vocabulary():
    import public_tokenizers

    return corpus.library_encoder(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def vocabulary_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools by source in ids of a public vocabulary, with a start id for each document: tokenised once, capped, cut into shards, written, and
    summed from the files; (pool, shard, n, tokens, placed)."""
    path = scratch.new_folder(spark, "vocabulary")
    corpus.tokenise(texts(spark, sf_dir).select("doc_id", F.col("source").alias("pool"), "text"), vocabulary()).select("pool", "doc_id", "ids").write.parquet(f"{path}/ids")
    tokbin.build_pools(spark.read.parquet(f"{path}/ids"), f"{path}/pools", 40_000, 16_384)
    rows = tokbin.read_shards(spark, f"{path}/pools", layout="chunks", recursive=True).select("shard", F.posexplode("tokens").alias("i", "token"))
    sums = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("token").cast("bigint")).alias("tokens"), F.sum(F.col("token").cast("bigint") * (F.col("i") % 1009)).alias("placed"))
    return sums.select(F.regexp_extract("shard", "/([^/]+)/shard_", 1).alias("pool"), F.regexp_extract("shard", "shard_([0-9]+)", 1).cast("bigint").alias("shard"), "n", "tokens", "placed")  # a file is a shard
