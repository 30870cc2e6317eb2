"""Queries over documents: manifests, budgets, shards, windows, tokens, samples, pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import scalar
from corpusmill.operators import corpus, mixture, packing, sampling
from corpusmill.plans.registry import query
from corpusmill.sources import sinks, text

BUDGET, SHARD, BATCH = 50_000, 20_000, 4_096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty documents with their byte-token counts; no text is carried along."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return docs.select("doc_id", "source", "lang", corpus.byte_token_count("text").alias("n_tokens"))


_COUNTED = "d AS (SELECT doc_id, source, lang, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens FROM documents WHERE length(text) > 0)"
_SPENT = f"{_COUNTED}, b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM d)"
_STREAM = f"{_COUNTED}, s AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d)"


@query(f"""WITH {_SPENT}
    SELECT source AS name, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(ceil(sum(n_tokens) / {SHARD}.0) AS BIGINT) AS shards,
           CAST({BUDGET} AS BIGINT) AS target, sum(n_tokens) >= {BUDGET} AS done
    FROM b WHERE spent < {BUDGET} GROUP BY source""")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = corpus.cap_budget(counted(spark, sf_dir), "source", "doc_id", "n_tokens", BUDGET)
    return sinks.manifest(kept, "source", "n_tokens", SHARD, BUDGET)


@query(f"WITH {_SPENT} SELECT doc_id, source, n_tokens FROM b WHERE spent < {BUDGET}")
def budget_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.cap_budget(counted(spark, sf_dir), "source", "doc_id", "n_tokens", BUDGET).select("doc_id", "source", "n_tokens")


@query(f"""WITH d AS (SELECT doc_id, source, CAST(strlen(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE length(text) > 0),
    b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM d)
    SELECT doc_id AS file_no, source AS pool, size FROM b WHERE spent < CASE WHEN source = 'src0' THEN 20000 ELSE least(60000, 8 * 6000) END AND k <= 30""")
def fetch_within_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select(F.col("doc_id").alias("file_no"), F.col("source").alias("pool"), F.col("source").alias("grp"), F.octet_length("text").cast("bigint").alias("size"))
    return corpus.fetch_plan(files, {"src0": 20_000}, 60_000, 6_000, 30).select("file_no", "pool", "size")


@query(f"WITH {_STREAM} SELECT doc_id, n_tokens, start FROM s")
def stream_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.prefix_sums(counted(spark, sf_dir), "doc_id", "n_tokens").select("doc_id", "n_tokens", "start")


@query(f"""WITH {_STREAM}, p AS (SELECT *, unnest(range(start // {SHARD}, (start + n_tokens - 1) // {SHARD} + 1)) AS shard FROM s)
    SELECT doc_id, shard, greatest(start, shard * {SHARD}) - shard * {SHARD} AS position, greatest(start, shard * {SHARD}) - start AS "begin",
           least(start + n_tokens, (shard + 1) * {SHARD}) - greatest(start, shard * {SHARD}) AS length, CASE WHEN shard = 0 THEN 'val' ELSE 'train' END AS split FROM p""")
def shard_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = corpus.shard_slices(counted(spark, sf_dir), SHARD)
    return pieces.select("doc_id", "shard", "position", "begin", "length", corpus.shard_split(F.col("shard")).alias("split"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shard_slices(counted(spark, sf_dir), SHARD).groupBy("shard").agg(F.sum("length").alias("n_tokens"))


_SIZES = f"{_STREAM}, p AS (SELECT *, unnest(range(start // {SHARD}, (start + n_tokens - 1) // {SHARD} + 1)) AS shard FROM s), z AS (SELECT shard, CAST(sum(least(start + n_tokens, (shard + 1) * {SHARD}) - greatest(start, shard * {SHARD})) AS BIGINT) AS n_tokens FROM p GROUP BY shard)"


@query(f"""WITH {_SIZES}, w AS (SELECT shard, unnest(range(0, greatest(0, (n_tokens - 2) // {BATCH}))) AS step FROM z)
    SELECT shard, step, CAST(r AS INTEGER) AS rank, step * {BATCH} + r * {BATCH // 4} AS "begin", CAST({BATCH // 4 + 1} AS INTEGER) AS length FROM w, range(0, 4) AS t(r)""")
def window_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.windows(shard_sizes(spark, sf_dir), BATCH, 4).select("shard", "step", "rank", "begin", "length")


@query(f"""WITH {_SIZES}, w AS (SELECT shard, unnest(range(2, greatest(2, (n_tokens - 2) // {BATCH}))) AS step FROM z)
    SELECT shard, step, step * {BATCH} AS "begin" FROM w""")
def resumed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.windows(shard_sizes(spark, sf_dir), BATCH, 1, skip=2).select("shard", "step", "begin")


@query(f"""WITH {_SIZES}, k AS (SELECT shard, greatest(0, (n_tokens - 2) // {BATCH}) AS k FROM z),
    o AS (SELECT shard, k, coalesce(sum(k) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(k) OVER () AS n FROM k),
    w AS (SELECT shard, b + i AS at, i, n FROM (SELECT *, unnest(range(0, k)) AS i FROM o)),
    c AS (SELECT s AS step, CAST(s % (SELECT max(n) FROM o) AS BIGINT) AS at FROM range(0, 300) AS t(s))
    SELECT c.step, w.shard, CAST(w.i * {BATCH} AS BIGINT) AS "begin" FROM c JOIN w ON c.at = w.at""")
def cyclic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.cyclic_windows(shard_sizes(spark, sf_dir), 300, BATCH).select(F.col("step").cast("bigint").alias("step"), "shard", F.col("begin").cast("bigint").alias("begin"))


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0),
    t AS (SELECT doc_id, unnest(range(0, strlen(h) // 2)) AS i, h FROM d),
    v AS (SELECT doc_id, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS cur FROM t),
    l AS (SELECT *, lag(cur) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM v)
    SELECT doc_id, CAST(sum(CASE WHEN prev IS NULL THEN 754559 ELSE xor(36313 * cur, 27191 * prev) % 754559 END) AS BIGINT) AS bucket_sum, count(*) AS n FROM l GROUP BY doc_id""")
def bigram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the bigram buckets of each document's byte tokens."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    tokens = corpus.byte_tokenise(docs.select("doc_id", "text"), start=False).select("doc_id", F.col("ids").alias("t"))
    return packing.with_bigrams(tokens, 754560, "t").select("doc_id", F.aggregate("bigrams", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bucket_sum"), F.size("t").cast("bigint").alias("n"))


@query("SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source, lang")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query("""SELECT source, round(coalesce(sum(n_chars) FILTER (lang = 'de'), 0), 5) AS de, round(coalesce(sum(n_chars) FILTER (lang = 'en'), 0), 5) AS en,
    round(coalesce(sum(n_chars) FILTER (lang = 'es'), 0), 5) AS es, round(coalesce(sum(n_chars) FILTER (lang = 'fr'), 0), 5) AS fr
    FROM (SELECT source, lang, CAST(n_chars AS DOUBLE) AS n_chars FROM documents) GROUP BY source""")
def group_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("lang").alias("pool"), F.col("n_chars").cast("double").alias("w"))
    pools = spark.createDataFrame([(x, x) for x in ("de", "en", "es", "fr")], "pool string, grp string")
    return mixture.group_weights(docs, pools, ["de", "en", "es", "fr"]).withColumnRenamed("run_id", "source")


_FOLDERS = "f AS (SELECT 'common_crawl-' || lang || '_' || source || '-' || lpad(CAST(doc_id % 20 AS VARCHAR), 4, '0') AS folder FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'scans-' || source || '-part' || CAST(doc_id % 4 AS VARCHAR) FROM documents WHERE doc_id % 3 = 0)"


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder names made from all documents: two thirds in the web form, one third in parts."""
    docs = table(spark, sf_dir, "documents")
    web = F.concat(F.lit("common_crawl-"), "lang", F.lit("_"), "source", F.lit("-"), F.lpad((F.col("doc_id") % 20).cast("string"), 4, "0"))
    part = F.concat(F.lit("scans-"), "source", F.lit("-part"), (F.col("doc_id") % 4).cast("string"))
    return docs.select(F.when(F.col("doc_id") % 3 != 0, web).otherwise(part).alias("folder"))


@query(rf"""WITH {_FOLDERS} SELECT DISTINCT 'cc_' || regexp_extract(folder, '^common_crawl-(.+)-(\d{{4}})$', 1) || '_' || regexp_extract(folder, '^common_crawl-(.+)-(\d{{4}})$', 2) AS name,
    regexp_extract(folder, '^common_crawl-(.+)-(\d{{4}})$', 1) AS topic, CAST(regexp_extract(folder, '^common_crawl-(.+)-(\d{{4}})$', 2) AS INTEGER) AS vigintile
    FROM f WHERE regexp_matches(folder, '^common_crawl-(.+)-(\d{{4}})$')""")
def pool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.web_pools(folders(spark, sf_dir).distinct())


@query(rf"WITH {_FOLDERS} SELECT DISTINCT regexp_replace(folder, '-part\d+$', '') AS folder FROM f")
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merge_parts(folders(spark, sf_dir))


_POOLS = r"p AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'books' ELSE 'cc' END AS grp, source || '_' || CAST(doc_id % 20 AS VARCHAR) AS name, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 20 AS INTEGER) END AS vigintile FROM documents)"


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    web = F.col("doc_id") % 3 != 0
    return docs.select(F.when(web, "cc").otherwise("books").alias("group"), F.concat_ws("_", "source", (F.col("doc_id") % 20).cast("string")).alias("name"), F.when(web, (F.col("doc_id") % 20).cast("int")).alias("vigintile")).distinct()


@query(f"WITH {_POOLS} SELECT grp, name, coalesce(vigintile, -1) AS vigintile FROM p WHERE grp <> 'cc' OR vigintile = (SELECT max(vigintile) FROM p WHERE grp = 'cc')")
def best_vigintile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.top_vigintile(pools(spark, sf_dir)).select(F.col("group").alias("grp"), "name", F.coalesce("vigintile", F.lit(-1)).alias("vigintile"))


@query(f"WITH {_POOLS}, n AS (SELECT name, grp, row_number() OVER (ORDER BY name || grp) - 1 AS k FROM p) SELECT name, grp FROM n WHERE k % 4 = 1")
def worker_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pools(spark, sf_dir).withColumn("o", F.concat("name", "group"))
    return corpus.every_nth(rows, "o", 1, 4).select("name", F.col("group").alias("grp"))


@query(r"""WITH f AS (SELECT 'data/' || source || '/' || lang || '-' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.jsonl.zst' ELSE '.parquet' END AS path FROM documents)
    SELECT DISTINCT name, path FROM f JOIN (VALUES ('zst', 'data/src1*.jsonl.zst'), ('zst', 'data/src1/en*'), ('de', '*/de-?.parquet')) AS r(name, pattern) ON path GLOB pattern""")
def pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".jsonl.zst").otherwise(".parquet")).alias("path"))
    patterns = spark.createDataFrame([("zst", "data/src1*.jsonl.zst"), ("zst", "data/src1/en*"), ("de", "*/de-?.parquet")], "name string, pattern string")
    return text.match_patterns(files, patterns)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5")
def head_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_by(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 5)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 5")
def sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fixed_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5, 7)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a full shuffle, without sorting everything in one task: prefix counts over buckets of the hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(sampling.seeded_order("doc_id", 3), 1, 15), 16, 10).cast("bigint").alias("h"), F.lit(1).alias("one"))
    return corpus.prefix_sums(rows, "h", "one", "before").select("doc_id", (F.col("before") + 1).alias("place"))


@query(f"""WITH {_COUNTED}, o AS (SELECT *, CAST('0x' || substr(md5('5|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM d),
    c AS (SELECT doc_id, coalesce(sum(n_tokens) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n_tokens) OVER () AS n FROM o)
    SELECT doc_id, CASE WHEN b < n * 0.05 THEN 'val' ELSE 'train' END AS split FROM c""")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_validation(counted(spark, sf_dir), "n_tokens", "doc_id", 5, 0.05).select("doc_id", "split")


@query("""WITH d AS (SELECT source, lang, doc_id, n_chars FROM documents)
    SELECT source, CAST((k - 1) // 8 AS BIGINT) AS batch, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS items FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM d) GROUP BY source, (k - 1) // 8""")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.batches(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 8, "doc_id")
    return out.select("source", "batch", F.array_join("items", ",").alias("items"))


@query("""SELECT doc_id, CAST(('0x' || right(md5('run' || CAST(doc_id AS VARCHAR)), 8)) AS BIGINT) & 2147483647 AS seed FROM documents""")
def run_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.stable_seed(F.concat(F.lit("run"), F.col("doc_id").cast("string"))).alias("seed"))


@query(f"WITH {_COUNTED} SELECT count(*) AS docs, median(n_tokens) AS median, round(avg(n_tokens), 6) AS mean, min(n_tokens) AS min, max(n_tokens) AS max FROM d")
def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_summary(counted(spark, sf_dir), "n_tokens").withColumn("mean", F.round("mean", 6))


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, h, unnest(range(0, (strlen(h) // 2 + 63) // 64)) AS k FROM d)
    SELECT doc_id, k AS chunk, least(64, strlen(h) // 2 - 64 * k) AS n, CAST('0x' || substr(h, 128 * k + 1, 2) AS INTEGER) AS head FROM c""")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks of 64 byte tokens."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    tokens = corpus.byte_tokenise(docs.select("doc_id", "text"), start=False).select("doc_id", F.col("ids").alias("t"))
    return tokens.select("doc_id", F.posexplode(scalar.chunked("t", 64)).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.size("c").cast("bigint").alias("n"), F.col("c")[0].alias("head"))


@query("""WITH x AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) > 1), t AS (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 1)) AS i FROM x)
    SELECT doc_id, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) * CAST('0x' || substr(h, 2 * i + 3, 2) AS BIGINT)) AS BIGINT) AS dot FROM t GROUP BY doc_id""")
def next_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and next-token targets of each document, checked by their inner product."""
    docs = table(spark, sf_dir, "documents").filter(F.octet_length("text") > 1)
    tokens = corpus.byte_tokenise(docs.select("doc_id", "text"), start=False).select("doc_id", F.col("ids").alias("t"))
    a, b = scalar.shift_targets("t")
    rows = tokens.select("doc_id", F.arrays_zip(a.alias("x"), b.alias("y")).alias("z"))
    return rows.select("doc_id", F.size("z").cast("bigint").alias("n"), F.aggregate("z", F.lit(0).cast("bigint"), lambda s, p: s + p["x"].cast("bigint") * p["y"].cast("bigint")).alias("dot"))


@query("""SELECT doc_id, n_chars, CAST(ceil(n_chars / 16.0) * 16 AS BIGINT) AS padded FROM documents""")
def padded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", scalar.round_up("n_chars", 16).alias("padded"))


@query("SELECT CAST(doc_id // 97 AS BIGINT) AS rank, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY doc_id // 97")
def range_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(corpus.owner_of_row(F.col("doc_id"), 97).alias("rank")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("total"))


@query("""WITH u AS (SELECT doc_id % 50 AS row_id, n_chars AS a, doc_id AS b FROM documents) SELECT row_id, CAST(sum(a) AS BIGINT) AS v0, CAST(sum(b) AS BIGINT) AS v1 FROM u GROUP BY row_id""")
def sparse_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("row_id"), F.array("n_chars", "doc_id").alias("values"))
    return corpus.add_rows(rows).select("row_id", F.col("values")[0].alias("v0"), F.col("values")[1].alias("v1"))


@query("""WITH p AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM documents) SELECT doc_id, CAST(e - n_chars AS BIGINT) AS "begin", CAST(e AS BIGINT) AS "end" FROM p""")
def concatenation_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.pairwise_offsets(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars").select("doc_id", "begin", "end")


@query(f"""WITH {_COUNTED}, r AS (SELECT doc_id, source, n_tokens, CASE source WHEN 'src1' THEN 131 WHEN 'src2' THEN 73 WHEN 'src3' THEN 37 END AS w FROM d WHERE source IN ('src1', 'src2', 'src3')),
    b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r),
    x AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM d WHERE source = 'src4'),
    k AS (SELECT doc_id, source, n_tokens FROM b WHERE spent < 60000.0 * (1 - 0.05) * w / 241 UNION ALL SELECT doc_id, 'text', n_tokens FROM x WHERE spent < 60000 * 0.05),
    o AS (SELECT *, CAST('0x' || substr(md5('9|' || source || '/' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM k),
    c AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_tokens) OVER () AS n FROM o)
    SELECT doc_id, source, n_tokens, CASE WHEN before < n * 0.05 THEN 'val' ELSE 'train' END AS split FROM c""")
def speech_text_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counted(spark, sf_dir).withColumn("max_id", F.lit(255))
    speech = rows.filter(F.col("source").isin("src1", "src2", "src3"))
    plain = rows.filter(F.col("source") == "src4").select("doc_id", "n_tokens", "max_id")
    return corpus.speech_mixture(speech.select("doc_id", "source", "n_tokens", "max_id"), plain, 60_000, dict(zip(("src1", "src2", "src3"), corpus.SPEECH_WEIGHTS, strict=True)), 0.05, 9)


@query(f"""WITH {_COUNTED}, r AS (SELECT doc_id, source, n_tokens, CASE source WHEN 'src1' THEN 131 WHEN 'src2' THEN 73 WHEN 'src3' THEN 37 END AS w FROM d WHERE source IN ('src1', 'src2', 'src3')),
    b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r),
    z AS (SELECT doc_id % 6 AS shard, CAST(sum(n_tokens) AS BIGINT) AS n FROM d WHERE source = 'src4' GROUP BY 1),
    y AS (SELECT *, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z),
    t AS (SELECT shard, least(n, 8000 - before) AS take FROM y WHERE before < 8000),
    x AS (SELECT shard, CAST(i * 512 AS BIGINT) AS "begin", CAST(least(512, take - i * 512) AS BIGINT) AS n_tokens FROM (SELECT *, unnest(range(0, CAST(ceil(take / 512.0) AS BIGINT))) AS i FROM t)),
    v AS (SELECT *, row_number() OVER (ORDER BY shard, "begin") - 1 AS doc_id FROM x),
    k AS (SELECT doc_id, source, n_tokens, -1 AS shard, -1 AS "begin" FROM b WHERE spent < 160000.0 * (1 - 0.05) * w / 241 UNION ALL SELECT doc_id, 'text', n_tokens, shard, "begin" FROM v),
    o AS (SELECT *, CAST('0x' || substr(md5('9|' || source || '/' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM k),
    c AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past, sum(n_tokens) OVER () AS n FROM o)
    SELECT doc_id, source, n_tokens, CAST(shard AS BIGINT) AS shard, CAST("begin" AS BIGINT) AS "begin", CASE WHEN past < n * 0.05 THEN 'val' ELSE 'train' END AS split FROM c""")
def speech_and_rechunked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture whose text part is cut anew from token shards, end to end."""
    rows = counted(spark, sf_dir).withColumn("max_id", F.lit(255))
    speech = rows.filter(F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source", "n_tokens", "max_id")
    shards = rows.filter(F.col("source") == "src4").groupBy((F.col("doc_id") % 6).alias("shard")).agg(F.sum("n_tokens").alias("n_tokens"), F.max("max_id").alias("max_id"))
    out = packing.rechunked_mixture(speech, shards, 160_000, dict(zip(("src1", "src2", "src3"), corpus.SPEECH_WEIGHTS, strict=True)), 512, 0.05, 9)
    return out.select("doc_id", "source", "n_tokens", *(F.coalesce(F.col(c).cast("bigint"), F.lit(-1)).alias(c) for c in ("shard", "begin")), "split")


@query("""WITH RECURSIVE d AS (SELECT doc_id, text, strlen(text) + 1 AS n FROM documents WHERE length(text) > 0),
    o AS (SELECT *, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) - n AS start FROM d),
    h AS (SELECT doc_id, text, start // 200000 AS shard, least(n, (start // 200000 + 1) * 200000 - start, 2048) AS size FROM o),
    c AS (SELECT *, row_number() OVER w AS i, CAST(sum(size) OVER w AS BIGINT) AS upto FROM h WINDOW w AS (PARTITION BY shard ORDER BY doc_id)),
    e AS (SELECT a.shard, a.i, a.upto - a.size AS base, min(b.i) AS final FROM c a JOIN c b ON a.shard = b.shard AND b.i >= a.i AND b.upto >= a.upto - a.size + 16385 GROUP BY ALL),
    g AS (SELECT shard, 0 AS bin, i, base, final FROM e WHERE i = 1 UNION ALL SELECT e.shard, bin + 1, e.i, e.base, e.final FROM g JOIN e ON e.shard = g.shard AND e.i = g.final + 1),
    k AS (SELECT *, count(*) OVER (PARTITION BY shard) AS bins FROM g),
    b AS (SELECT k.shard, bin, flatten(list(list_prepend(50256, list_transform(range(least(size, base + 16385 - (upto - size)) - 1), lambda x: CAST('0x' || substr(hex(encode(text)), 2 * x + 1, 2) AS INTEGER))) ORDER BY c.i))[1:16384] AS ids
        FROM k JOIN c ON c.shard = k.shard AND c.i BETWEEN k.i AND k.final WHERE bin < bins // 2 * 2 GROUP BY k.shard, bin)
    SELECT shard, CAST(bin // 2 AS INTEGER) AS step, CAST(bin % 2 AS INTEGER) AS rank, CAST(len(ids) AS INTEGER) AS n, CAST(16384 AS INTEGER) AS last, md5(array_to_string(ids, ',')) AS inputs_md5,
        CAST(754559 + list_sum(list_transform(range(2, 16385), lambda x: xor(36313 * CAST(ids[x] AS BIGINT), 27191 * CAST(ids[x - 1] AS BIGINT)) % 754559)) AS BIGINT) AS bigram_sum FROM b""")
def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document-aligned batches of all byte-token shards."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", "text")
    pieces = corpus.shard_slices(docs.select("doc_id", corpus.byte_token_count("text").alias("n_tokens")), 200_000)  # lengths alone are summed
    tokens = corpus.take_slices(corpus.byte_tokenise(docs).select("doc_id", "ids").join(pieces.hint("shuffle_hash"), "doc_id"))
    packed = packing.pack_shards(tokens, 16_384, 2_048, 2, buckets=754560)
    digest = F.md5(F.array_join("inputs", ","))
    return packed.select("shard", "step", "rank", F.size("inputs").alias("n"), F.array_max("offsets").alias("last"), digest.alias("inputs_md5"), F.aggregate("bigrams", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bigram_sum"))
