"""A bounded, repeatable sample of labelled texts for training on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


#: Keys kept for each one wanted before they are ranked; the hash decides, so what is ranked is bounded by the sample, not by the table.
SPARE = 4
#: More labels than this are taken for a mistake: each has its own sample on the driver.
MAX_LABELS = 1000


def _ranked(rows: DataFrame, label: str, key: str, per_label: int) -> tuple[DataFrame, dict]:
    """(label, key, n) of the ``per_label`` distinct keys of each label with the smallest hash, and the labels' counts of rows."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)), F.approx_count_distinct(key)).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    share = F.lit(0.0)
    for value, _, distinct in counts:
        share = F.when(F.col(label) == value, F.lit(min(1.0, SPARE * per_label / distinct))).otherwise(share)
    near = rows.filter(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) < share * (1 << 30))
    first = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    chosen = near.select(label, key).distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_label)
    return chosen, {value: total for value, total, _ in counts}


def labelled_texts(rows: DataFrame, label: str, per_label: int) -> list[Row]:
    """(label, text, n_rows): for each of a few labels ``per_label`` distinct whole texts chosen by their
    hash, and how many rows have the label in all.

    Only hashes are ranked; texts are fetched for the hashes chosen."""
    hashed = rows.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(label, F.xxhash64("text").alias("h"), "text")
    chosen, totals = _ranked(hashed, label, "h", per_label)
    picked = hashed.join(F.broadcast(chosen), [label, "h"])  # per_label rows a label
    texts = picked.groupBy(label, "n").agg(F.min("text").alias("text")).collect()
    return [Row(label=r[label], text=r.text, n_rows=totals[r[label]]) for r in sorted(texts, key=lambda r: (r[label], r.n))]


def texts_of_labels(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> list[Row]:
    """``labelled_texts`` for labels in a table of their own (doc_id, label): ids are chosen by their hash from the labels alone,
    and ``n_rows`` counts labels.  Only the chosen ids meet the documents, so no other text is moved."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    chosen, totals = _ranked(rows, label, "doc_id", per_label)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # per_label rows a label
    texts = picked.groupBy(label, "n").agg(F.min("text").alias("text")).collect()
    return [Row(label=r[label], text=r.text, n_rows=totals[r[label]]) for r in sorted(texts, key=lambda r: (r[label], r.n))]
