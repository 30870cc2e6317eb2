"""Queries through table functions, over workers, and through the log of a manifest."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import tables
from corpusmill.operators import balancing
from corpusmill.plans.corpus_queries import table
from corpusmill.plans.registry import query
from corpusmill.sources.manifest_log import ManifestLog
from corpusmill.sources.scratch import new_folder


@query("""WITH d AS (SELECT doc_id, source, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, source, w, unnest(range(0, greatest(len(w) - 16, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END), 112)) AS b FROM d)
    SELECT doc_id, source, CAST(b // 112 AS INTEGER) AS chunk, CAST(least(128, len(w) - b) AS INTEGER) AS n_words, md5(array_to_string(w[b + 1 : b + 128], ' ')) AS words_md5 FROM c""")
def chunked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 128 words that share 16, by a table function in SQL."""
    tables.register(spark)
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "source", "text")
    return spark.sql("SELECT doc_id, source, chunk, n_words, md5(words) AS words_md5 FROM text_chunks(TABLE({docs}), 'text', 128, 16)", docs=docs)


@query("""WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pair, turn, text AS question, answer FROM t WHERE role = 'user' AND next_role = 'assistant'""")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers of conversations, by a table function over partitioned input in SQL."""
    tables.register(spark)
    return spark.sql("SELECT * FROM turn_pairs(TABLE({turns}) PARTITION BY conv_id ORDER BY turn)", turns=table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


WORKERS = 12


@query(f"""WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n FROM documents),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, doc_id) AS i FROM d),
    h AS (SELECT doc_id, n, CAST(i - 1 AS INTEGER) AS worker FROM r WHERE i <= {WORKERS}), t AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM r WHERE i > {WORKERS}),
    s AS (SELECT row_number() OVER (ORDER BY n) AS k, sum(n) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS total FROM h),
    v AS (SELECT min(((SELECT sum(n) FROM t) + total + k - 1) // k) AS level FROM s),
    c AS (SELECT worker, greatest(0, level - n) AS room, sum(greatest(0, level - n)) OVER (ORDER BY worker) AS high FROM h, v)
    SELECT doc_id, n, worker FROM h UNION ALL SELECT t.doc_id, t.n, c.worker FROM t JOIN c ON least(t.at, (SELECT max(high) FROM c) - 1) >= c.high - c.room AND least(t.at, (SELECT max(high) FROM c) - 1) < c.high""")
def documents_over_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over workers by bytes; the largest one of each worker is given first, the others fill the room that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n"))
    return balancing.balanced(docs, "doc_id", "n", WORKERS, head=WORKERS)


@query("SELECT source AS name, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(doc_id) AS BIGINT) AS last_doc FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source")
def logged_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four writers add their documents to one manifest at the same time; none of their counts is lost."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND source IS NOT NULL")
    log = ManifestLog(spark, new_folder(spark, "manifest-log"), "name", "name string, docs bigint, bytes bigint, last_doc bigint")

    def add(writer: int) -> int:
        own = docs.filter(F.pmod("doc_id", F.lit(4)) == writer).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.max("doc_id").alias("last_doc"))
        merged = lambda before: own.unionByName(before).groupBy("name").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"), F.max("last_doc").alias("last_doc"))
        return log.update(merged)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(4)))
    return log.snapshot()
