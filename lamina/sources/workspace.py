"""Folders for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; below a folder of our own only if the session names none.
    It goes when the application ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    path = f"{top.rstrip('/')}/lamina-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` as Parquet in a workspace, read back."""
    path = f"{workspace(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
