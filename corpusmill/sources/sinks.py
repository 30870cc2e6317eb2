"""Writers: manifests, upserts, result tables, partitioned pushes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "append", compression: str = "none") -> None:
    """JSON lines; Spark's commit protocol makes each write all or nothing."""
    df.write.mode(mode).option("compression", compression).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def push_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("source", "split"), fmt: str = "parquet") -> None:
    """One folder for each source and split; rows are dealt by a salted key first, so a large source has many files."""
    df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode("overwrite").partitionBy(*by).format(fmt).save(path)


def upsert(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones without a new row of the same key."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def manifest(docs: DataFrame, name: str, tokens: str, shard_tokens: int, target: int) -> DataFrame:
    """(name, docs, tokens, shards, target, done) for each name."""
    total = F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint")
    out = docs.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("docs"), total.alias("tokens"))
    return out.withColumn("shards", F.ceil(F.col("tokens") / shard_tokens).cast("bigint")).withColumn("target", F.lit(target).cast("bigint")).withColumn("done", F.col("tokens") >= F.col("target"))


def mixture_json(spec: DataFrame, counts: DataFrame, weighting: str) -> DataFrame:
    """One row of JSON: groups of the sources that have rows, with their sizes.

    ``spec``: (grp, grp_weight, name, source, size, message_weight); ``counts``: (source, n)."""
    rows = spec.join(counts.filter("n > 0"), "source").withColumn("size", F.coalesce("size", F.col("n").cast("double")))
    sets = F.array_sort(F.collect_list(F.struct("name", "source", "size", "message_weight")))
    groups = rows.groupBy("grp").agg(F.first("grp_weight").alias("weight"), sets.alias("datasets"))
    whole = groups.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", F.struct("weight", "datasets"))))).alias("groups"))
    return whole.select(F.to_json(F.struct(F.lit(weighting).alias("loss_token_weighting"), "groups")).alias("value"))


def metadata_json(docs: DataFrame, source: str, vocab: int) -> DataFrame:
    counts = docs.groupBy(F.col(source).alias("s"), "split").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "s", "split"), "n")))).alias("counts"), F.lit(vocab).alias("vocab"))).alias("value"))


def export_validation(rows: DataFrame, path: str) -> None:
    """A validation set as JSON lines, a folder for each source (see ``answers.unify_validation``)."""
    rows.write.mode("overwrite").partitionBy("source").json(path)


def import_validation(spark: SparkSession, path: str) -> DataFrame:
    """What ``export_validation`` has written, with conversations parsed."""
    schema = "split string, images array<string>, convos_json string, n_subsegments int, message_weight float, style string, source string"
    return spark.read.schema(schema).json(path).withColumn("convos", F.from_json("convos_json", "array<array<string>>")).drop("convos_json")
