"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine, a temporary folder that is set
    for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors on other machines need a folder that all share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyrook-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows; unlike createDataFrame([]), without a job of Python workers."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: it is computed once, its lineage is cut, and
    a lost executor costs nothing of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
