"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir or the context's checkpoint folder; a temporary one only with a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
