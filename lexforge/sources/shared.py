"""Folders that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stream_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset, as in tests, below the local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{(base or 'file://' + os.path.join(tempfile.gettempdir(), 'checkpoints')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new shared folder and reread: computed once, and there for any executor."""
    folder = stream_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
