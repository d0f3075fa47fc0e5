"""Whole-file sources: ledger entries, proposals, plans, artifacts, editor results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import outcome, pr_url, strip_fence
from .shared import empty


def _whole(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files of a folder; a folder that is not there has none."""
    none = empty(spark, T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType())]))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return none
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("content"))


def parse_ledger(files: DataFrame) -> DataFrame:
    """(path, content) as ledger entries: schemas.LEDGER."""
    field = lambda name: F.trim(F.regexp_extract("content", rf"(?m)^\*\*{name}:\*\* (.+?)\s*$", 1))
    found = outcome("content")
    return files.select(
        "path", F.trim(F.regexp_extract("content", r"(?m)^# (.+)$", 1)).alias("id"), field("Artifact").alias("artifact"), field("Signal").alias("signal_type"),
        found.alias("outcome_raw"), F.when(found == "", "open").otherwise(found).alias("outcome_or_open"), pr_url("content").alias("pr_url"), "content",
    )


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return parse_ledger(_whole(spark, folder, "*.md"))


def read_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """(path, proposal) of each *.json; null where a file, without its code fence, is none."""
    inside = strip_fence("content")
    parsed = F.when(F.try_parse_json(inside).isNotNull(), F.from_json(inside, schemas.PROPOSAL))
    return _whole(spark, folder, "*.json").select("path", parsed.alias("proposal"))


def read_artifacts(artifacts: DataFrame, limit: int) -> DataFrame:
    """(artifact, content) of the distinct artifacts (paths or URIs) that exist; the tasks that have
    the paths open them. Of a file, no more is read than decides how `limit` bytes of it look.
    One that is not there, or is a folder, is left out; any other error ends the job. Paths
    without a scheme are local to the executors; others are opened by pyarrow.fs."""
    wanted = artifacts.select("artifact").where("artifact is not null").distinct()
    # few paths are not many tasks' work, but opening files in a far store waits long
    wanted = wanted.repartition(F.col("artifact"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                if store.get_file_info(at).type != fs.FileType.File:
                    continue
                with store.open_input_stream(at) as f:
                    content = f.read(limit + 1)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], names=["artifact", "content"])

    found = wanted.mapInArrow(read, "artifact string, content binary")
    # a longer file goes on behind a byte that is cut off anyway
    return found.select("artifact", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON array (a plan, proposals, pull requests)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_editor_results(spark: SparkSession, folder: str) -> DataFrame:
    """(id, applied, files_changed, summary, reason) of editor-result-<id>.json files."""
    rows = _whole(spark, folder, "editor-result-*.json")
    name = F.regexp_extract("path", r"editor-result-([^/]*)\.json$", 1)
    return rows.select(name.alias("id"), F.from_json(strip_fence("content"), schemas.EDITOR_RESULT).alias("r")).select("id", "r.*")
