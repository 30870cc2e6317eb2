"""JSON lines, Parquet text columns, listings, logs and small tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.scalar import first_non_empty, glob_to_regex


def read_jsonl(spark: SparkSession, path: str, text_field: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts of JSON lines (plain, gzip or zstd), and what was refused.

    The text is ``text_field``, or ``text`` where that is missing.  Blank lines are skipped; lines that aren't
    JSON objects, and rows without text, are in the second table with the reason."""
    fields = list(dict.fromkeys([text_field, "text"]))
    schema = ", ".join(f"`{f}` string" for f in fields) + ", _corrupt string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_text", first_non_empty(*fields))
    good = rows.filter(F.col("_corrupt").isNull() & F.col("_text").isNotNull()).select(F.col("_text").alias("text"), F.col("_file").alias("file"))
    reason = F.when(F.col("_corrupt").isNotNull(), "not JSON").otherwise("no text")
    bad = rows.filter((F.col("_corrupt").isNotNull() & (F.trim("_corrupt") != "")) | (F.col("_corrupt").isNull() & F.col("_text").isNull()))
    return good, bad.select(F.col("_file").alias("file"), reason.alias("reason"), F.col("_corrupt").alias("line"))


def text_column(schema: T.StructType, wanted: str = "text") -> str | None:
    """The wanted column, else ``text``, else the first string column, else none."""
    names = schema.fieldNames()
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return wanted if wanted in names else "text" if "text" in names else strings[0] if strings else None


def read_parquet_texts(spark: SparkSession, path: str, wanted: str = "text", filter_field: str | None = None, filter_value: str | None = None) -> DataFrame:
    """(text) of non-empty rows; the nested equality filter reaches the files."""
    rows = spark.read.parquet(path)
    name = text_column(rows.schema, wanted)
    if name is None:
        return spark.createDataFrame([], "text string")
    if filter_field:
        rows = rows.filter(F.col(filter_field) == filter_value)
    return rows.select(F.col(name).alias("text")).filter(F.length("text") > 0)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size) of files below a folder, without their content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", "modified").alias("path"))


def match_patterns(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (name, path) of files matched by any of a name's shell patterns; * spans folders."""
    rules = F.broadcast(patterns.select("name", glob_to_regex("pattern").alias("rule")))  # a listing's rules: a hand-written table
    return files.join(rules, F.expr("path rlike rule")).select("name", "path").distinct()


def folders_with_prefix(files: DataFrame, prefix: str, root: str = "data") -> DataFrame:
    """Distinct second parts, starting with ``prefix``, of paths of three parts or more below ``root``."""
    parts = F.split("path", "/")
    return files.filter((F.size(parts) >= 3) & (parts[0] == root) & parts[1].startswith(prefix)).select(parts[1].alias("folder")).distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, place): lines with a place that follows their order in each file."""
    rows = spark.read.text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_block_start").alias("_from")).select("value", "file", F.struct("_from", "_id").alias("place"))


def read_spans(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """(text, begin, spans) of JSON lines for perplexity: rows without text are out, ``begin`` is the first span's start (0 without
    spans), and the first ``max_docs`` rows in the lines' order are taken."""
    rows = read_lines(spark, path).select("file", "place", F.from_json("value", "text string, spans array<array<int>>").alias("r"))
    rows = rows.filter(F.length("r.text") > 0).select("file", "place", "r.text", "r.spans", F.coalesce(F.get(F.get("r.spans", F.lit(0)), F.lit(0)), F.lit(0)).alias("begin"))
    if max_docs:
        rows = rows.orderBy("file", "place").limit(max_docs)
    return rows.select("text", "begin", "spans")


def read_pairs(spark: SparkSession, folder: str, split: str, seed: int) -> DataFrame:
    """(image, question, answer, place) of <folder>/<split>.jsonl; ``place`` orders the rows at random, the same way for the same
    seed, and reading goes round and round in it.  No rows are an error."""
    rows = spark.read.schema("image string, question string, answer string").json(f"{folder}/{split}.jsonl")
    if rows.isEmpty():
        raise ValueError(f"{folder}/{split}.jsonl is empty")
    return rows.withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), "image", "question", "answer")))


def shards_to_fetch(spark: SparkSession, shards: int, present: DataFrame, train: str = "train_%06d.bin", val: str = "val_%06d.bin") -> DataFrame:
    """(name) of the validation shard and of the first ``shards`` training shards that aren't in ``present`` (name)."""
    first = spark.range(1).select(F.format_string(val, F.lit(0)).alias("name"))
    wanted = first.unionByName(spark.range(1, shards + 1).select(F.format_string(train, "id").alias("name")))
    return wanted.join(present.select("name").distinct(), "name", "left_anti")


def cached_listing(spark: SparkSession, path: str, cache: str, pattern: str = "*") -> DataFrame:
    """``list_files``, kept as a table at ``cache``: listed once, committed as a whole, and read from then on."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        list_files(spark, path, pattern).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def source_of_file(path: Column, separator: str = "__") -> tuple[Column, Column]:
    """Source and split of a file named ``<source>__<split>.jsonl``."""
    name = F.regexp_extract(path, r"([^/]+)\.jsonl(\.zst|\.gz)?$", 1)
    return F.split_part(name, F.lit(separator), F.lit(1)), F.split_part(name, F.lit(separator), F.lit(2))


def set_name(path: Column, suffix: str = "_span_ppl") -> Column:
    """Name of an evaluation set's file, without the suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.jsonl$", 1), f"{suffix}$", "")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result records, one JSON file each; unreadable files give no row."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)


# The forms of a log line.
LOG_LINE = r"step:(\d+)/(\d+) val_loss:([0-9.]+) train_time:([0-9.]+)(ms|s) step_avg:([0-9.]+|nan)ms"
OLD_LOG_LINE = r"s:(\d+) tel:([0-9.]+)"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines in their order.

    A log is one small file, so it is read whole and its lines are numbered within."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def parse_log(lines: DataFrame) -> DataFrame:
    """(file, line_no, step, steps, val_loss, train_ms) of the lines that hold a validation loss."""
    g = lambda k: F.regexp_extract("value", LOG_LINE, k)
    seconds = F.when(g(5) == "s", 1000.0).otherwise(1.0)
    found = lines.filter(F.col("value").rlike(LOG_LINE)).select("file", "line_no", g(1).cast("int").alias("step"), g(2).cast("int").alias("steps"), g(3).cast("double").alias("val_loss"), (g(4).cast("double") * seconds).alias("train_ms"))
    old = lines.filter(F.col("value").rlike("^" + OLD_LOG_LINE)).select("file", "line_no", F.regexp_extract("value", OLD_LOG_LINE, 1).cast("int").alias("step"), F.lit(None).cast("int").alias("steps"), F.regexp_extract("value", OLD_LOG_LINE, 2).cast("double").alias("val_loss"), F.lit(None).cast("double").alias("train_ms"))
    return found.unionByName(old)


def key_values(lines: DataFrame, keys: list[str]) -> DataFrame:
    """key=value lines of each file as columns."""
    pair = F.split("value", "=", 2)
    rows = lines.filter(F.col("value").rlike(r"^\w+=")).select("file", pair[0].alias("key"), F.trim(pair[1]).alias("v"))
    return rows.groupBy("file").pivot("key", keys).agg(F.last("v"))


def markdown_rows(lines: DataFrame, columns: int = 7) -> DataFrame:
    """Cells of the result rows (number first) of a Markdown table; a row with another number of cells, or
    without a link in its last cell, is an error."""
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace("value", r"^\s*\|", ""), r"\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.filter(F.col("value").rlike(r"^\s*\|\s*\d+\s*\|")).withColumn("cells", cells)
    fits = (F.size("cells") == columns) & F.element_at("cells", -1).contains("](")
    return rows.select("file", "line_no", F.when(fits, F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("bad table row: "), F.col("value")))).alias("cells"))
