"""Tables in the folder that all executors share: lineage ends there, and lost executors take nothing with them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a url, under the one the cluster names for checkpoints (one of our own where it names none)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "voxelarium-shared")
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The table written out and read back."""
    path = path or folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
