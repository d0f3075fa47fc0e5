"""The record store: parsed records in buckets by session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..config import MineConfig
from ..operators.normalize import Tables, numbered, parsed, tables
from .shared import remove, scratch
from .table import PARTS, LogTable

#: Rows that lie by session can be joined by session and more, as they lie; what little is moved
#: goes to as many tasks as there are buckets.
CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Plans made inside join what lies by session without an exchange."""
    before = {k: spark.conf.get(k) for k in CO_LOCATED}
    for k, v in CO_LOCATED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def stored(raw: DataFrame, config: MineConfig, buckets: int = 0) -> Iterator[Tables]:
    """The tables of the lines' records, numbered, written to the shared folder in buckets by session_id and read
    again. The one exchange by session serves numbering and the buckets: there are as many tasks as
    buckets, and each writes one file. Detectors read the columns that they need alone, also those
    inside blocks, and none of their joins, windows and sums by session moves rows again."""
    spark = raw.sparkSession
    name, path = f"records_{uuid.uuid4().hex[:12]}", scratch(spark, "records")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with co_located(spark):
        try:
            rec = numbered(parsed(raw, config).repartition(n, "session_id"), config)
            rec.write.bucketBy(n, "session_id").option("path", path).saveAsTable(name)
            yield tables(spark.table(name), config, n)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(spark, path)


def record_table(spark: SparkSession, path: str, parts: int = PARTS) -> LogTable:
    """Parsed records that are kept, in parts by session: what a stream has read so far."""
    return LogTable(spark, path, schemas.RECORD, "uuid", parts)
