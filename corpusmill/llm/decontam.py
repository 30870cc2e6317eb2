"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Words are runs of characters outside \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F after A-Z are
lower-cased.  A window is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one window.

The corpus is split into words once, and its postings are stored: a posting is (term, document, position), a
term is the 64-bit hash of a word, and a document's postings lie together in the order of their positions, so
the index is sharded by document and never dealt anew.  Of each window only the postings of
its rarest term (by corpus frequency) are followed; a window with a term that no document holds is
out at once.  A posting of the rarest term, shifted back by the term's offset, is a candidate start, and
the other terms' shifted lists are intersected there by looking at the postings at their
offsets.  What is dealt to other tasks are matches alone, never postings of frequent terms, so a word or
passage in a third of the documents costs no more than its matches.

The windows' index is broadcast while its bytes are below ``broadcast_bytes``; beyond that,
postings of anchor terms are dealt by term, and candidates meet the postings again by document.

Null or empty texts have no words, and items without words have no windows.  A very long text is one list of postings.
Rows with a null ``doc_id`` are one document per text.  Repeated rows each give a row.  A null
``item_id`` is listed as an empty string.  Only ``doc_id``, ``item_id`` and ``text`` are read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

WINDOW = 10
BROADCAST_BYTES = 32 << 20
#: Between words; the words' own pattern is its complement.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands at the end of each document's postings; no word has it but by chance, and then its windows are compared whole all the same.
_END = -1


def words_of(text: str) -> Column:
    lowered = F.translate(F.col(text), _UPPER, _LOWER)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def terms_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def positional_index(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, terms): the postings of each row, term by position."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), terms_of(words_of("text")).alias("terms"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, terms, phrase): every window of every item once."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of("text").alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    rows = rows.select("item_id", "all", F.explode(starts).alias("at"))
    rows = rows.select("item_id", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words"))
    return rows.select("item_id", terms_of(F.col("words")).alias("terms"), F.array_join("words", " ").alias("phrase")).distinct()


def term_frequencies(index: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """(term, n): how many postings the wanted terms have; terms without any have no row."""
    found = index.select(F.explode("terms").alias("term"))
    return found.join(F.broadcast(wanted) if small else wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def anchors(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(term, offset, n, window, phrase): each window that can occur, by its rarest term."""
    phrases = windows.select("phrase", F.col("terms").alias("window")).distinct()
    places = phrases.select("phrase", "window", F.posexplode("window").alias("offset", "term"))
    rated = places.join(frequencies, "term", "left")
    best = rated.groupBy("phrase").agg(F.min_by(F.struct("term", "offset", "window"), F.struct("n", "term", "offset")).alias("x"), F.bool_and(F.col("n").isNotNull()).alias("possible"))
    return best.filter("possible").select("x.term", "x.offset", F.size("x.window").alias("n"), "x.window", "phrase")


def matches(index: DataFrame, anchored: DataFrame, small: bool) -> DataFrame:
    """(doc_id, text_hash, phrase, start, n) of every occurrence, and a row for each document
    with a null phrase whose ``start`` is its number of words."""
    keys = ("doc_id", "text_hash")
    stands = lambda: F.slice("terms", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n")) == F.col("window")
    if small:
        # The end of each document is a posting, too; it carries the number of words, so the index is read once.
        end = anchored.sparkSession.range(1).select(F.lit(_END).cast("bigint").alias("term"), F.lit(0).alias("offset"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("window"), F.lit(None).cast("string").alias("phrase"))
        postings = index.select(*keys, "terms", F.posexplode(F.array_append("terms", F.lit(_END).cast("bigint"))).alias("position", "term"))
        found = postings.join(F.broadcast(anchored.unionByName(end)), "term").withColumn("start", F.col("position") - F.col("offset"))
        inside = F.when(F.col("phrase").isNull(), F.col("position") == F.size("terms")).otherwise((F.col("start") >= 0) & stands())
        return found.filter(inside).select(*keys, "phrase", "start", "n")
    postings = index.select(*keys, F.posexplode("terms").alias("position", "term"))
    starts = postings.join(anchored, "term").select(*keys, (F.col("position") - F.col("offset")).alias("start"), "n", "window", "phrase").filter("start >= 0")
    lists = index.groupBy(*keys).agg(F.first("terms").alias("terms"))
    same = (lists["doc_id"].eqNullSafe(starts["doc_id"])) & (lists["text_hash"] == starts["text_hash"])
    found = starts.join(lists.select("terms", *keys), same).filter(stands()).select(starts["doc_id"], starts["text_hash"], "phrase", "start", "n")
    ends = index.select(*keys, F.lit(None).cast("string").alias("phrase"), F.size("terms").alias("start"), F.lit(0).alias("n"))
    return found.unionByName(ends)


def proximity_matches(docs: DataFrame, items: DataFrame, within: int, terms: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end): places where an item's ``terms`` rarest distinct words (all of them, if it has fewer) stand
    within ``within`` words of the rarest, in any order, reported by the place of the rarest.

    The rarest word's postings are followed and the others looked for around each.  An item with a word that no document holds,
    or without words, has no place."""
    index, _ = store.materialise(positional_index(docs), "postings")
    vocabulary = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.explode(F.array_distinct(terms_of(words_of("text")))).alias("term"))
    distinct, _ = store.materialise(vocabulary.select("term").distinct(), "terms")
    small = 64 * distinct.count() <= broadcast_bytes
    rated = vocabulary.join(term_frequencies(index, distinct, small), "term", "left")
    rare = rated.groupBy("item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))), 1, terms).alias("r"))  # an item's words
    rare = rare.filter(F.col("r")[0]["n"] > 0).select("item_id", F.col("r.term").alias("rare"), F.col("r")[0]["term"].alias("term"))
    postings = index.select("doc_id", F.col("terms").alias("doc_terms"), F.posexplode("terms").alias("position", "term"))
    found = postings.join(F.broadcast(rare) if small else rare, "term").withColumn("begin", F.greatest(F.col("position") - within, F.lit(0)))
    around = F.slice("doc_terms", F.col("begin") + 1, F.col("position") + within - F.col("begin") + 1)
    return found.filter(F.size(F.array_except("rare", around)) == 0).select("doc_id", "item_id", F.col("begin").alias("start"), (F.col("position") + within).alias("end"))


def _bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, item_ids) for every row of ``docs``;
    ``item_ids`` is sorted as strings."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    windows, _ = store.materialise(item_windows(items, window), "item-windows")
    small = 4 * _bytes(windows, "phrase") <= broadcast_bytes
    index, index_path = store.materialise(positional_index(docs), "postings")
    wanted = windows.select(F.explode("terms").alias("term")).distinct()
    anchored, anchored_path = store.materialise(anchors(windows, term_frequencies(index, wanted, small)), "anchors")
    found, _ = store.materialise(matches(index, anchored, small), "window-matches")
    del index, anchored
    store.release(spark, index_path, anchored_path)
    keys = ("doc_id", "text_hash")
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.when(F.col("phrase").isNotNull(), F.struct("start", "n"))), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    per_doc = found.groupBy(*keys).agg(F.max(F.when(F.col("phrase").isNull(), F.col("start"))).alias("n_words"), F.count(F.when(F.col("phrase").isNull(), 1)).alias("copies"), F.size(covered).alias("n_hit"))
    hit = found.filter("phrase is not null").select(*keys, "phrase").distinct()
    pairs = windows.select("phrase", "item_id")
    pairs = hit.join(F.broadcast(pairs) if small else pairs, "phrase").groupBy(*keys).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    joined = per_doc.join(pairs.withColumnsRenamed({k: f"hit_{k}" for k in keys}), F.col("doc_id").eqNullSafe(F.col("hit_doc_id")) & (F.col("text_hash") == F.col("hit_text_hash")), "left")
    items_of = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "text_hash", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("item_ids"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
