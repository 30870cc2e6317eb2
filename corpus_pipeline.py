"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame,
which is written and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``; a text that a stage shortens gets a new ``n_chars``.
A ``docs`` table with further columns, or none of ``lang``, ``source`` and ``n_chars``, is
taken as it is: what isn't there is null.

Null and empty texts go through all stages but for the classifier, which scores them like any text: to line dedup they are one empty line, they are nobody's near copy and hold no passage, and
packing gives them their end id alone.  Very long texts are read whole by every stage, each by a task that holds one at a time.
Rows that share an id are told apart by their text; of rows with the same id and text one stays after near-dedup, but rows with a null id all stay.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import decontam, line_dedup, minhash, packing, quality, queries, store, tokens

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
#: A document goes when the classifier calls it bad, as in op7_quality.
QUALITY_FLOOR = quality.DECISION


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*((F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of its training fold."""
    docs = _documents(docs)
    return quality.keep_good(docs, queries.quality_network(spark, docs, sf_dir), QUALITY_FLOOR)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    docs = _documents(docs)
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), carry=("lang", "source", "n_chars"))
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows are told apart by id and text, so a document goes only for its own text.  Of rows with the
    same id and text one stays; rows with a null id all stay."""
    docs = _documents(docs).withColumn("_hash", F.xxhash64("text"))
    gone = minhash.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_gone")).distinct()
    left = docs.join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_gone")), "left_anti")
    again = Window.partitionBy("doc_id", "_hash").orderBy("n_chars")
    return left.withColumn("_n", F.when(F.col("doc_id").isNull(), 1).otherwise(F.row_number().over(again))).filter("_n = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    docs = _documents(docs)
    found = decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct().hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash"))
    return docs.join(found, same, "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their token ids."""
    pieces = packing.pack(_documents(docs), tokens.public_path("word_bpe_49k.json"), kind="word", end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained classifier, MinHash components and packing are not expressible in SQL; the tests hold
#: every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``.

    When a stage's table is written, the table before it and all that the stage's operator has left are deleted; the last table stays, as the result reads it."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = len(store.made)
        following, path = store.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        docs = following
        store.release(spark, *(p for p in [*store.made[mark:], before] if p and p != path))
        before = path
    return docs
