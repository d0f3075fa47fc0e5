"""Incremental mining: a stream of transcript lines into the incident table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import MineConfig
from ..operators.detectors import detect
from ..operators.normalize import numbered, parsed, tables
from ..sources.sinks import incident_table
from ..sources.store import record_table
from ..sources.table import PARTS


def mine_batch(lines: DataFrame, mark: str, store: str, out: str, config: MineConfig, parts: int = PARTS) -> dict[str, int]:
    """Mine some new lines (value, filename): `mark` is the batch's own, so that one that runs again
    stores its lines once. The state is a table of parsed records in parts by session: of it a
    batch reads the parts of the sessions that its lines belong to, and of transcripts nothing but
    these lines. Afterwards the incident table has of these sessions just what mining all their
    lines gives: windows that new turns complete and turns that late lines renumber are put right
    in the same commit that adds what is new."""
    spark = lines.sparkSession
    kept, incidents = record_table(spark, store, parts), incident_table(spark, out, parts)
    new = parsed(lines, config).persist()
    touched = new.select("session_id").distinct().persist()
    try:
        n = new.count()
        if not n:
            return {"lines": 0, "sessions": 0, "added": 0, "taken_out": 0}
        kept.append(new, mark)
        rec = kept.read(kept.parts_of(touched)).join(touched, "session_id", "left_semi")
        rec = numbered(rec.repartition("session_id"), config).persist()
        try:
            added, out_of = incidents.replace(touched, detect(tables(rec, config), config))
        finally:
            rec.unpersist()
        return {"lines": n, "sessions": touched.count(), "added": added, "taken_out": out_of}
    finally:
        touched.unpersist()
        new.unpersist()


def follow(spark: SparkSession, root: str, out: str, checkpoint: str, config: MineConfig, pattern: str = "*.jsonl", once: bool = True, parts: int = PARTS, files: int = 0) -> StreamingQuery:
    """Follow a folder: each file is read once, at most `files` a batch. After any batch the
    incident table equals that of mining all lines so far at once. Records are kept below the
    checkpoint, whose place in the files they belong to."""
    source = spark.readStream.format("text").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    lines = (source.option("maxFilesPerTrigger", files) if files else source).load(root).select("value", F.col("_metadata.file_path").alias("filename"))

    def batch(new: DataFrame, number: int) -> None:
        mine_batch(new, str(number), f"{checkpoint.rstrip('/')}/records", out, config, parts)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
    return (writer.trigger(availableNow=True) if once else writer).start()
