"""Scratch tables in the folder that driver and executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs at most the stage that is running.  Where that
setting is absent (tests, notebooks) a temporary folder is used and recorded in
the session; on a cluster the setting has to be there.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in a session with a local master."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


#: Scratch paths of this process, in the order they were given out.
made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return made[-1]


def materialise(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a scratch table; returns the table and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table, path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables nobody reads any more, and let Spark drop the shuffle
    files of plans that are out of scope (its cleaner waits for a JVM collection)."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    trim()
    jvm.System.gc()


def trim() -> None:
    """Give free memory of this process back to the system (the C library keeps it otherwise)."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the one knob that is sized to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
