"""Folders for tables that a query writes and reads back, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a session with a local master may have a temporary folder instead."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set(SETTING, found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
