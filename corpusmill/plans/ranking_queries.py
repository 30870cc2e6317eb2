"""Ranks of whole tables, and summaries that are rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import ranking, selection, sketches
from corpusmill.plans.corpus_queries import table
from corpusmill.plans.registry import query
from corpusmill.sources.scratch import new_folder


@query("""SELECT l_orderkey, l_linenumber, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 9) AS percent_rank FROM lineitem WINDOW w AS (ORDER BY l_shipdate DESC, l_returnflag)""")
def shipping_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the day of shipment, latest first, with many ties."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    found = ranking.ranks(lines, [("l_shipdate", True), "l_returnflag"])
    return found.select("l_orderkey", "l_linenumber", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS row_number, ntile(100) OVER w AS tile FROM lineitem WINDOW w AS (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey)""")
def price_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    found = ranking.ranks(lines, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], tiles=100)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "row_number", F.col("ntile").alias("tile"))


@query("""SELECT doc_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 9) AS percent_rank FROM documents WHERE text IS NOT NULL WINDOW w AS (ORDER BY strlen(text) DESC)""")
def length_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their bytes, the longest first; copies and short texts tie."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.octet_length("text").alias("size"))
    found = ranking.ranks(docs, [("size", True)])
    return found.select("doc_id", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"))


_SHARES = (0.01, 0.25, 0.5, 0.9, 0.999)


@query(f"""SELECT column_name, p, round(v, 6) AS v FROM (
    SELECT 'l_extendedprice' AS column_name, unnest({list(_SHARES)}::DOUBLE[]) AS p, unnest(quantile_cont(l_extendedprice, {list(_SHARES)})) AS v FROM lineitem UNION ALL
    SELECT 'l_partkey', unnest({list(_SHARES)}::DOUBLE[]), unnest(quantile_cont(CAST(l_partkey AS DOUBLE), {list(_SHARES)})) FROM lineitem)""")
def line_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of prices and part keys by selection."""
    lines = table(spark, sf_dir, "lineitem")
    found = [(name, p, round(v, 6)) for name in ("l_extendedprice", "l_partkey") for p, v in zip(_SHARES, selection.percentiles(lines, name, _SHARES), strict=True) if v is not None]
    return spark.createDataFrame(found, "column_name string, p double, v double")


_SKETCH_K = 256
#: Five standard errors.
_WITHIN = 5 / (_SKETCH_K - 2) ** 0.5


@query(f"""WITH w AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents WHERE text IS NOT NULL),
    h AS (SELECT DISTINCT source, CAST('0x' || left(md5(word), 13) AS BIGINT) AS h FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS i FROM h),
    k AS (SELECT source, count(*) AS kept, max(h) AS last FROM r WHERE i <= {_SKETCH_K} GROUP BY source),
    e AS (SELECT source, kept, CASE WHEN kept < {_SKETCH_K} THEN kept ELSE {_SKETCH_K - 1}::DOUBLE * {sketches.HASHES}::DOUBLE / last END AS estimate FROM k),
    t AS (SELECT source, count(*) AS words FROM w GROUP BY source)
    SELECT source, kept, round(estimate, 3) AS estimate, words, abs(estimate - words) <= {_WITHIN} * words AS within, true AS same_as_direct FROM e JOIN t USING (source)""")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different words by source: summaries by shard, source and language are stored, rolled up, and held against the summary of all rows and the true count."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.pmod("doc_id", F.lit(8)).alias("shard"), "source", "lang", F.regexp_extract_all(F.lower("text"), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)).alias("words"))
    path = new_folder(spark, "sketches")
    sketches.distinct_sketches(docs, ["shard", "source", "lang"], F.col("words"), _SKETCH_K).write.parquet(path)
    stored = spark.read.parquet(path)
    rolled = sketches.merged_distinct(stored, ["source"], _SKETCH_K)
    known = docs.select("source", F.explode(F.array_distinct("words")).alias("word")).distinct()  # dealt once for both uses
    direct = sketches.distinct_sketches(known, ["source"], F.array("word"), _SKETCH_K).withColumnRenamed("hashes", "all_hashes")
    words = known.groupBy("source").agg(F.count(F.lit(1)).alias("words"))
    found = rolled.join(direct, "source").join(words, "source").withColumn("estimate", sketches.distinct_estimate(F.col("hashes"), _SKETCH_K))
    within = F.abs(F.col("estimate") - F.col("words")) <= _WITHIN * F.col("words")
    return found.select("source", F.size("hashes").cast("bigint").alias("kept"), F.round("estimate", 3).alias("estimate"), "words", within.alias("within"), (F.col("hashes") == F.col("all_hashes")).alias("same_as_direct"))


@query("""SELECT source, count(*) AS n, true AS median_within, true AS upper_within FROM documents WHERE text IS NOT NULL GROUP BY source""")
def length_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the texts' bytes by source from stored sketches by shard, source and language; the ranks of what they say are counted in the rows."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.pmod("doc_id", F.lit(8)).alias("shard"), "source", "lang", F.octet_length("text").cast("bigint").alias("size"))
    path = new_folder(spark, "sketches")
    sketches.quantile_sketches(docs, ["shard", "source", "lang"], "size").write.parquet(path)
    rolled = sketches.merged_quantiles(spark.read.parquet(path), ["source"])
    said = rolled.select("source", "n", *(F.kll_sketch_get_quantile_bigint("kll", F.lit(p)).alias(name) for name, p in (("median", 0.5), ("upper", 0.95))))
    below = docs.select("source", "size").join(said, "source").groupBy("source", "n").agg(*(F.sum((F.col("size") < F.col(c)).cast("long")).alias(f"{c}_below") for c in ("median", "upper")), *(F.sum((F.col("size") <= F.col(c)).cast("long")).alias(f"{c}_upto") for c in ("median", "upper")))
    margin = 3 * sketches.KLL_ERROR
    within = lambda c, p: (F.col(f"{c}_below") / F.col("n") <= p + margin) & (F.col(f"{c}_upto") / F.col("n") >= p - margin)
    return below.select("source", "n", within("median", 0.5).alias("median_within"), within("upper", 0.95).alias("upper_within"))
