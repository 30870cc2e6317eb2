"""Question-answer pairs, conversations and their filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.sampling import head_by
from corpusmill.functions.scalar import first_non_empty, first_non_empty_array, non_empty, resolve_answer, with_options

#: Valid pairs that one image may give.
PAIRS_PER_IMAGE = 4


def _maybe(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def generic_pairs(rows: DataFrame, questions: tuple[str, ...] = ("question", "query"), answers: tuple[str, ...] = ("answer", "label"), choices: str = "choices") -> DataFrame:
    """Adds ``q`` (with its options) and ``a`` from the first fields that aren't empty; rows without both are out."""
    options = F.coalesce(_maybe(rows, choices, "array<string>"), F.array().cast("array<string>"))
    question = first_non_empty(*(_maybe(rows, q) for q in questions))
    answer = resolve_answer(first_non_empty(*(_maybe(rows, a) for a in answers)), options)
    return rows.withColumns({"q": with_options(F.trim(question), options), "a": non_empty(answer)}).filter(F.col("q").isNotNull() & (F.col("q") != "") & F.col("a").isNotNull())


def first_of_list(answers: Column) -> Column:
    """The first of a list of answers; null for an empty list."""
    return F.get(answers, F.lit(0))


def paired_lists(rows: DataFrame, pairs: str = "qa_pairs", per_image: int = PAIRS_PER_IMAGE) -> DataFrame:
    """A row for each of the first ``per_image`` valid pairs; pairs are a struct of two lists (the shorter one counts) or a list of structs."""
    kind = rows.schema[pairs].dataType.typeName()
    if kind == "struct":
        q, a = F.col(f"{pairs}.question"), F.col(f"{pairs}.answer")
        n = F.least(F.size(q), F.size(a))
        zipped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(q, i).alias("question"), F.get(a, i).alias("answer")))
        zipped = F.when(n > 0, zipped)
    else:
        zipped = F.col(pairs)
    valid = F.filter(zipped, lambda p: (F.trim(F.coalesce(p["question"], F.lit(""))) != "") & (F.trim(F.coalesce(p["answer"], F.lit(""))) != ""))
    rows = rows.select("*", F.posexplode(F.slice(valid, 1, per_image)).alias("pair", "p"))
    return rows.withColumns({"q": F.trim("p.question"), "a": F.trim("p.answer")}).drop("p")


def extract_pairs(rows: DataFrame, source: str = "source", prefix: str = "cosyn") -> DataFrame:
    """Pairs by the source's form: lists of pairs for sources with the prefix, single fields for all others."""
    keep = [c for c in rows.columns if c not in ("qa_pairs", "question", "query", "answer", "label", "choices")]
    listed = paired_lists(rows.filter(F.col(source).startswith(prefix))).select(*keep, "pair", "q", "a")
    single = generic_pairs(rows.filter(~F.coalesce(F.col(source).startswith(prefix), F.lit(False)))).select(*keep, F.lit(0).alias("pair"), "q", "a")
    return listed.unionByName(single)


def ingest_source(rows: DataFrame, order: str, cap: int, source: str = "source", image: str = "image") -> DataFrame:
    """Pairs of rows that have an image, the first ``cap`` of each source."""
    pairs = extract_pairs(rows.filter(F.col(image).isNotNull()), source)
    first = Window.partitionBy(source).orderBy(order, "pair")
    return pairs.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= cap).drop("_n")


def ingest_formatted(rows: DataFrame, formatter: Callable[[dict], list[list[str]] | None], cap: int, key: str = "id", source: str = "source") -> DataFrame:
    """(key, source, convos) of rows that an outside formatter (a row's fields to conversations, or None) gives a usable conversation for, the
    first ``cap`` of each source.  The formatter runs in workers; a row it fails on is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                try:
                    made.append(formatter(row))
                except (KeyError, ValueError, TypeError, IndexError):
                    made.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(source), pa.array(made, pa.list_(pa.list_(pa.string())))], names=[key, source, "convos"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = rows.mapInArrow(run, f"{key} {kinds[key]}, {source} {kinds[source]}, convos array<array<string>>")
    return head_by(made.filter(usable(F.col("convos"))), source, [key], cap)


def as_conversations(messages: Column, nested: bool) -> Column:
    """A list of conversations from one conversation or from a list of them."""
    return messages if nested else F.array(messages)


def as_images(image: Column, many: Column | None = None) -> Column:
    """A list of images from a single path and a list, either of which may be missing."""
    one = F.when(non_empty(image).isNotNull(), F.array(image))
    none = F.array().cast("array<string>")
    return F.coalesce(one, none) if many is None else F.coalesce(first_non_empty_array(many), one, none)


def usable(convos: Column) -> Column:
    """Whether at least one conversation has two turns or more."""
    return F.exists(convos, lambda c: F.size(c) >= 2)


def flattened(convos: Column) -> tuple[Column, Column]:
    """All turns, and the number of conversations (at least 1)."""
    return F.flatten(convos), F.greatest(F.size(convos), F.lit(1))


def turns_by_conversation(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, roles, texts) of messages in order; a conversation is bounded by its turns."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    return rows.groupBy(key).agg(ordered.alias("m")).select(key, F.col("m.role").alias("roles"), F.col("m.text").alias("texts"))


def unify_validation(full: DataFrame, simple: DataFrame) -> DataFrame:
    """Conversation rows and pair rows in one form: (source, split, images, convos_json, n_subsegments, message_weight, style)."""
    a = full.select("source", "split", "images", F.to_json("convos").alias("convos_json"), F.col("n_subsegments").cast("int").alias("n_subsegments"), F.col("message_weight").cast("float").alias("message_weight"), "style")
    b = simple.select("source", "split", F.array("image").alias("images"), F.to_json(F.array(F.array("q", "a"))).alias("convos_json"), F.lit(1).alias("n_subsegments"), F.lit(1.0).cast("float").alias("message_weight"), F.lit("simple").alias("style"))
    return a.unionByName(b)


def parse_validation(rows: DataFrame) -> DataFrame:
    """The other way: conversations from their JSON."""
    return rows.withColumn("convos", F.from_json("convos_json", "array<array<string>>")).drop("convos_json")


def source_split_counts(full: DataFrame, simple: DataFrame) -> DataFrame:
    """(source, split, n_full, n_simple) of all sources in either; missing ones count 0."""
    count = lambda df, name: df.groupBy("source", "split").agg(F.count(F.lit(1)).alias(name))
    both = count(full, "n_full").join(count(simple, "n_simple"), ["source", "split"], "full_outer")
    return both.fillna(0, ["n_full", "n_simple"])


def first_split(rows: DataFrame, priority: tuple[str, ...] = ("validation", "val", "test")) -> DataFrame:
    """(source, split): of each source the first split in order of priority that has rows."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("split"))
    return rows.filter(place > 0).groupBy("source").agg(F.min_by("split", place).alias("split"))


def existing_images(rows: DataFrame, files: DataFrame, image: str = "image") -> DataFrame:
    """Rows whose image is among the files listed."""
    return rows.join(files.select(F.col("path").alias(image)).distinct(), image, "left_semi")
