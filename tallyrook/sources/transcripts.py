"""Transcripts: newline-delimited JSON values, read without inferring a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_parts


def read_transcripts(spark: SparkSession, glob: str) -> DataFrame:
    """(value, filename) of each line; ** in the glob descends into all folders. Lines are
    split by Spark's text reader, so a large file is read by many tasks."""
    reader = spark.read
    if "**" in glob.split("/"):
        root, pattern = glob_parts(glob)
        reader, path = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern), root
    else:
        path = glob
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("filename"))
